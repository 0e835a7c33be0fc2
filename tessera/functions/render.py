"""Documents, notes and names as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_text(block: Column) -> Column:
    """A block in Markdown, with the blank lines that its kind has around it."""
    text, kind = F.trim(block["text"]), block["kind"]
    level = F.greatest(F.lit(1), F.least(F.lit(6), block["level"].cast("int")))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = (
        F.when(kind == "heading", join("\n", F.repeat(F.lit("#"), level), " ", text, "\n"))
        .when(kind == "list_item", join("- ", text))
        .when(kind == "quote", join("> ", text))
        .when(kind == "code", join("```\n", text, "\n```"))
        .when(kind == "table", join(text, "\n"))
        .when(kind == "caption", join("_", text, "_"))
        .otherwise(join("\n", text, "\n"))
    )
    return F.when(text != "", made)


def document_text(blocks: Column) -> Column:
    """A document's blocks as Markdown, without blank lines at its end."""
    return F.regexp_replace(F.array_join(F.transform(blocks, block_text), "\n"), "\\s+$", "")


def file_name(name: Column) -> Column:
    """A name without characters that file systems refuse, eighty at most."""
    cleaned = F.trim(F.regexp_replace(name, '[/\\\\:*?"<>|]', "-"))
    return F.when(cleaned == "", F.lit("untitled")).otherwise(F.left(cleaned, F.lit(80)))


def counted(n: Column, name: str) -> Column:
    """A number with its word, which is plural but for one."""
    return F.concat(F.format_number(n, 0), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise("s"))


def subtitle(kind: Column, site: Column, pages: Column, words: Column) -> Column:
    """A source's second line: its kind, its site where there is one, and its pages or else its words."""
    size = F.when(pages > 0, counted(pages, "page")).when(words > 0, counted(words, "word"))
    return F.concat_ws(" · ", kind, F.nullif(site, F.lit("")), size)


def file_name_with_id(name: Column, ident: Column) -> Column:
    """A file name that ends in an id, which is never cut, so that no two rows share one."""
    end = F.concat(F.lit("-"), F.regexp_replace(ident, '[/\\\\:*?"<>|]', "-"))
    start = file_name(name)
    return F.concat(F.left(start, F.greatest(F.lit(0), F.lit(80) - F.length(end))), end)


def location(page: Column, url: Column, kind: Column) -> Column:
    """Where a passage stands: its page, else its address, else its kind."""
    return F.coalesce(F.concat(F.lit("page "), page.cast("string")), F.nullif(url, F.lit("")), kind)


def front_matter(fields: dict[str, Column]) -> Column:
    """Fields that aren't null as lines between rules."""
    lines = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def note_of_answer(question: Column, answer: Column, cited: Column) -> Column:
    """A note's body: the question, the answer and the sources that it cites."""
    sources = F.when(F.size(cited) > 0, F.concat(F.lit("\n\n## Sources\n\n"), F.array_join(F.transform(cited, lambda c: F.concat(F.lit("- "), c)), "\n")))
    return F.concat(F.lit("# "), question, F.lit("\n\n"), answer, F.coalesce(sources, F.lit("")))
