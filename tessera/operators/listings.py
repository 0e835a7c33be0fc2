"""Filters and orders of the listings: notebooks, sources, sessions, notes, messages, models.

All are expressions or sorts over whole tables; a sort is range-partitioned, and
nothing is cut off. Ties go to the least id, so an order is the same every time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A source's states while it is worked on, and the filters by state.
BUSY = ("queued", "fetching", "extracting", "chunking", "embedding")
FILTERS = {"ready": ("ready", "partial"), "issues": ("failed", "partial", *BUSY)}


def source_filter(name: str) -> Column:
    """Whether a source (status, included) is in a filter: all, ready, issues or excluded."""
    if name == "all":
        return F.lit(True)
    if name == "excluded":
        return ~F.col("included")
    return F.col("status").isin(*FILTERS[name])


def contains_any(needle: str, *columns: str) -> Column:
    """Whether one of the columns holds the text, whatever its case; an empty text is held by all."""
    low = needle.strip().lower()
    if not low:
        return F.lit(True)
    return reduce(Column.__or__, [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in columns])


def notebooks(rows: DataFrame, with_archived: bool = False) -> DataFrame:
    """Latest first; archived ones only where asked for."""
    kept = rows if with_archived else rows.where(~F.coalesce("is_archived", F.lit(False)))
    return kept.orderBy(F.desc("updated_at"), "id")


def notebook_sections(rows: DataFrame, needle: str = "") -> DataFrame:
    """Notebooks with a text in title or summary, and whether each stands among the favourites."""
    return rows.where(contains_any(needle, "title", "summary")).withColumn("section", F.when(F.coalesce("is_favorite", F.lit(False)), F.lit("favourites")).otherwise(F.lit("notebooks")))


def eligible(sources: DataFrame, scope: DataFrame | list | None = None, key: str = "source_id") -> DataFrame:
    """(source_id) of the sources that retrieval may use: included and, where there is a ``scope`` of ids, in it.

    A scope of many ids is a table; a short list becomes a literal. A source without a flag is included."""
    kept = sources.where(F.coalesce("included", F.lit(True)))
    if isinstance(scope, DataFrame):
        kept = kept.join(scope.select(key), key, "left_semi")
    elif scope is not None:
        kept = kept.where(F.col(key).isin(*scope) if scope else F.lit(False))
    return kept.select(key)


def usable(sources: DataFrame, ids: list | None = None, key: str = "source_id") -> DataFrame:
    """The sources that an answer or study tool may name: eligible and not failed."""
    return sources.where(F.col("status") != "failed").join(eligible(sources, ids, key), key, "left_semi")


def natural(title: Column) -> Column:
    """A key that puts numbers within titles in order of their value, however long: a run of digits as its length without
    leading zeros, then the digits."""
    parts = F.regexp_extract_all(F.lower(title), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "")


def sort_sources(rows: DataFrame, by: str = "added", key: str = "doc_id") -> DataFrame:
    """Every source by time added, title, size or number of passages."""
    order = {"added": lambda: F.desc("added_at"), "title": lambda: natural(F.col("title")), "size": lambda: F.desc("bytes"), "passages": lambda: F.desc("chunk_count")}
    return rows.orderBy(order[by](), key)


def recents(items: DataFrame, key: str = "id") -> DataFrame:
    """Every item by the time it was opened, or else updated, latest first."""
    return items.withColumn("used_at", F.coalesce("last_opened_at", "updated_at")).orderBy(F.desc("used_at"), key)


def pinned_first(rows: DataFrame, key: str = "id") -> DataFrame:
    """Sessions or notes: pinned ones, then the rest, each latest first."""
    return rows.orderBy(F.desc("is_pinned"), F.desc("updated_at"), key)


def filter_notes(rows: DataFrame, kind: str | None = None, needle: str = "") -> DataFrame:
    """Notes of a kind with a text in title or body."""
    return rows.where((F.col("kind") == kind) if kind else F.lit(True)).where(contains_any(needle, "title", "body"))


def providers(rows: DataFrame) -> DataFrame:
    """Local ones first, then by name."""
    return rows.orderBy(F.desc("is_local"), F.lower("display_name"), "display_name")


def last_said(messages: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """Of each conversation the last user text and the last answer without an error: partial maxima, no window."""
    said = lambda role, also: F.max_by(F.when((F.col("role") == role) & also, F.col("text")), F.when((F.col("role") == role) & also, F.col(at)))
    fine = ~F.coalesce("is_error", F.lit(False)) if "is_error" in messages.columns else F.lit(True)
    return messages.groupBy(by).agg(said("user", F.lit(True)).alias("last_question"), said("assistant", fine).alias("last_answer"))
