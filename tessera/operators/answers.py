"""Answers from retrieved passages: providers, prompts, study tools, discovery picks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.lexicon import REFUSALS
from tessera.functions.text import preview
from tessera.operators import prompts, replies
from tessera.operators.retrieval import Settings, assemble, assemble_web, context_text, resolve_citations, search

#: Results of one search that discovery looks at.
MOST_RESULTS = 24

# What each study tool looks for and how widely.
TOOL_QUERIES = {
    "timeline": "date year month period chronology sequence then after before",
    "quotations": "argue claim conclude state found reported evidence",
    "keyPoints": "key point finding result important significant evidence",
    "summary": "overview purpose main argument conclusion findings",
    "faq": "question why how what cause reason effect",
    "quiz": "definition concept term process cause effect mechanism",
    "flashcards": "definition concept term process cause effect mechanism",
    "studyGuide": "definition concept term process cause effect mechanism",
    "outline": "section chapter introduction background method results conclusion",
    "briefing": "summary status risk decision recommendation finding",
}
BROAD = ("summary", "studyGuide", "outline", "briefing")


class Provider(ABC):
    """A language model: the only step of an answer outside the plan."""

    local = True

    @abstractmethod
    def stream(self, system: str, user: str) -> Iterator[str]:
        """Pieces of the reply in order."""

    def generate(self, system: str, user: str) -> str:
        return "".join(self.stream(system, user))


class SearchProvider(ABC):
    """A web search: rows (title, url, snippet, content, score)."""

    @abstractmethod
    def search(self, query: str, limit: int) -> list[dict]:
        """Results in the provider's order."""


def reply_of_lines(lines: Iterator[bytes], pick: Callable[[str], str | None]) -> Iterator[str]:
    """Texts of a reply streamed as lines (``data:`` marks are passed over), however its bytes are cut."""
    rest = b""
    for piece in lines:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            text = line.decode().strip().removeprefix("data:").strip()
            if text and text != "[DONE]" and (part := pick(text)):
                yield part
    text = rest.decode().strip().removeprefix("data:").strip()
    if text and text != "[DONE]" and (part := pick(text)):
        yield part


def tool_settings(tool: str, base: Settings, sources: int) -> Settings:
    """A study tool's retrieval: whole-document tools want breadth, a comparison every source."""
    if tool in BROAD:
        return replace(base, results=max(base.results, 16), per_source=max(base.per_source, 10), floor=0.0)
    if tool == "comparison":
        results = max(base.results, 14)
        return replace(base, results=results, per_source=max(4, results // max(1, sources)), floor=0.0)
    return base if tool == "manual" else replace(base, floor=0.0)


def tool_query(tool: str, titles: list[str], focus: str | None = None) -> str:
    return focus or TOOL_QUERIES.get(tool) or " ".join(titles[:4])


@dataclass
class Answer:
    text: str
    cited: list[str]
    invented: list[str]
    insufficient: bool
    passages: int
    notices: list[str] = field(default_factory=list)


def model_scores(provider: Provider, question: str):
    """A function for ``search(model=)``: scores 0 to 1 of passages by the model's reply, None where it can't be read."""

    def score(rows: list[Row]) -> list[float] | None:
        if not rows:
            return []
        spark = SparkSession.active()
        flat = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "i long, t string").select("i", preview(F.col("t"), 700).alias("t")).collect()
        try:
            reply = provider.generate(*prompts.rerank(question, [r.t for r in sorted(flat)]))
        except Exception:
            return None
        return spark.createDataFrame([(reply,)], "r string").select(replies.rerank_scores(F.col("r"), len(rows))).first()[0]

    return score


def answer(
    provider: Provider, question: str, chunks: DataFrame, titles: DataFrame, vectors: DataFrame | None = None, query_vector=None, settings: Settings = Settings(), *,
    eligible: DataFrame | None = None, index=None, web: DataFrame | None = None, history: str | None = None, system: str | None = None, model_rerank: bool = False,
) -> Answer:
    """Search, assemble, ask, resolve. ``web`` (position, title, url, content) follows the sources within the
    budget. A reply that breaks off keeps the text so far."""
    model = model_scores(provider, question) if model_rerank else None
    found = search(chunks, vectors, question, query_vector, settings, eligible=eligible, index=index, model=model)
    budget = settings.clamped().budget
    blocks = assemble(found.rows, chunks, titles, budget)
    rows = blocks.orderBy("n").select("n", "marker", "body", "estimate").collect()
    blocks = chunks.sparkSession.createDataFrame(rows, blocks.select("n", "marker", "body", "estimate").schema)
    more = assemble_web(web, blocks, budget) if web is not None else None
    given = [r.marker for r in rows] + ([r.marker for r in more.select("marker").collect()] if more is not None else [])
    context = context_text(blocks, more).first().context
    said = ""
    try:
        for part in provider.stream(system or prompts.answer_system(bool(rows), len(given) > len(rows)), prompts.answer_user(question, context, history)):
            said += part
    except Exception:
        if not said:
            raise
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(0, said)], "answer_id long, answer string")
    r = resolve_citations(asked, spark.createDataFrame([(0, m) for m in given], "answer_id long, marker string")).first()
    return Answer(r.cleaned, list(r.cited), list(r.invented), r.insufficient, len(rows), found.notices)


def study(provider: Provider, tool: str, chunks: DataFrame, titles: DataFrame, settings: Settings = Settings(), focus: str | None = None, **how):
    """A study tool's reply: cards or quiz items where the tool has them, else the answer. The first four titles
    in order make the question of a tool without one of its own; the number of sources is that of all."""
    n = titles.count()
    names = [r.title for r in titles.select("title").orderBy("title").limit(4).collect()]
    out = answer(provider, tool_query(tool, names, focus), chunks, titles, settings=tool_settings(tool, settings, n), system=prompts.study_system(tool), **how)
    return replies.flashcards(out.text) if tool == "flashcards" else replies.quiz(out.text) if tool == "quiz" else out


def suggested_query(provider: Provider, question: str) -> str:
    """A query that the model suggests, or the question where what it says doesn't look like one."""
    try:
        said = provider.generate(*prompts.suggest_query(question)).strip().strip('"')
    except Exception:
        return question
    fits = said and "\n" not in said and len(said) <= max(80, 3 * len(question)) and not any(r in said.lower() for r in REFUSALS)
    return said if fits else question


def discover(provider: Provider | None, search_provider: SearchProvider, topic: str, spark: SparkSession, keep: int = 8) -> DataFrame:
    """The results (position, title, url, snippet, reason) worth reading on a topic: searched with a suggested query,
    one for each address key, chosen by the model or, without a readable reply, by navigation penalty.

    The model is shown the merged list, and its numbers are places there. A search without results has none worth reading."""
    query = suggested_query(provider, topic) if provider else topic
    found = search_provider.search(query, MOST_RESULTS)
    rows = [(i, r.get("title") or r["url"], r["url"], r.get("snippet")) for i, r in enumerate(found, 1) if r.get("url")]
    results = merged_results(spark.createDataFrame(rows, "position int, title string, url string, snippet string"))
    shown = [tuple(r) for r in results.orderBy("position").select("position", "title", "url", preview(F.coalesce("snippet", F.lit("")), 200)).collect()]
    # Held as a list of MOST_RESULTS rows at most, so that the numbers shown are those picked from.
    results = spark.createDataFrame(results.collect(), results.schema)
    picks = None
    if provider and shown:
        try:
            picks = replies.choices(provider.generate(*prompts.pick(topic, shown, keep)), len(shown), keep)
        except Exception:
            picks = None
    return pick_results(results, picks, keep)


def merged_results(results: DataFrame) -> DataFrame:
    """A search's results (position, title, url, snippet), the first of each address key, numbered from 1 as they stand."""
    from tessera.functions.urls import dedupe_key

    keyed = results.withColumn("key", dedupe_key(F.col("url")))
    first = keyed.groupBy("key").agg(F.min(F.struct("position", "title", "url", "snippet")).alias("r")).select("r.*")
    # One search's page of results.
    return first.withColumn("position", F.row_number().over(Window.orderBy("position")))


def pick_results(results: DataFrame, picks: list[tuple[int, str | None]] | None, keep: int) -> DataFrame:
    """The results (position from 1) that a model picked; without a readable reply those with the least navigation penalty."""
    from tessera.functions.urls import navigation_penalty

    if picks is None:
        ranked = results.withColumn("penalty", navigation_penalty(F.col("url"))).orderBy("penalty", "position").limit(keep)
        return ranked.drop("penalty").withColumn("reason", F.lit(None).cast("string"))
    chosen = results.sparkSession.createDataFrame(picks[:keep], "position int, reason string")
    return results.join(F.broadcast(chosen), "position")


def enrich(results: DataFrame, pages: DataFrame, top: int = 4) -> DataFrame:
    """Web results with the text of their pages (url, text), for the first ``top`` where it is 200 characters longer than
    the snippet; the others of these have the snippet as their content.

    Only these results' pages are joined; of several pages of one url the text that sorts first is taken."""
    first = results.where(F.col("position") <= top).select("url").distinct()
    texts = pages.join(F.broadcast(first), "url", "left_semi").groupBy("url").agg(F.min("text").alias("text"))
    richer = (F.col("position") <= top) & (F.length("p.text") > F.length(F.coalesce("snippet", F.lit(""))) + 200)
    # At most ``top`` pages.
    joined = results.join(F.broadcast(texts).alias("p"), "url", "left")
    return joined.withColumn("content", F.when(richer, preview(F.col("p.text"), 3000)).when(F.col("position") <= top, F.col("snippet")).otherwise(F.col("content"))).drop("text")


def enrich_notice(results: DataFrame, pages: DataFrame, top: int = 4) -> str | None:
    """What to say where a page (url, text, problem) of the first ``top`` results couldn't be read: the first one's reason."""
    first = results.where(F.col("position") <= top).select("position", "url")
    known = pages.join(F.broadcast(first.select("url").distinct()), "url", "left_semi").groupBy("url").agg(F.min(F.struct(F.col("text").isNull().alias("lost"), "problem")).alias("p"))
    lost = first.join(F.broadcast(known), "url", "left").where(F.coalesce("p.lost", F.lit(True)))
    row = lost.agg(F.min(F.struct("position", F.coalesce("p.problem", F.lit("not fetched")).alias("reason"))).alias("r")).first()
    return f"Some pages could not be read in full ({row.r.reason}), so snippets were used for those results." if row.r else None
