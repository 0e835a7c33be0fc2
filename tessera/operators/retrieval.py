"""Hybrid retrieval: keyword and vector channels, fusion, rerank, caps, budget.

Relations: ``chunks(chunk_id, source_id, text, heading, token_count)`` and
``vectors(chunk_id, vector)``. Each channel is a scan that ends in a top list of
at most ``Settings.candidates`` rows (400 by its own limit); these short lists
meet on the driver, and the passages behind them are then looked up by their
ids, which the scan takes as a pushed filter. With a stored ``index`` the
keyword channel reads the postings of the question's terms and no text.

Keyword statistics are over the whole table; scope and inclusion come after."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import lexicon as L
from tessera.functions import text as T
from tessera.functions.vectors import doubles

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, BOTH_CHANNELS = 60.0, 1.15
WINDOW, STRIDE = 40, 20
ROW_OVERHEAD = 24


@dataclass(frozen=True)
class Settings:
    """Result counts and limits of one retrieval."""

    results: int = 8
    candidates: int = 40
    budget: int = 4000
    per_source: int = 3
    floor: float = 0.08

    def clamped(self) -> Settings:
        results = min(max(self.results, 1), 60)
        return replace(self, results=results, candidates=min(max(self.candidates, results), 400), budget=min(max(self.budget, 500), 200_000), per_source=min(max(self.per_source, 1), 50))


def settings_for_context(tokens: int) -> Settings:
    """Budget and result count by the size of a model's context window."""
    for limit, budget, results in ((6_000, 2_000, 5), (16_000, 4_000, 8), (64_000, 10_000, 12)):
        if tokens < limit:
            return Settings(results=results, budget=budget)
    return Settings(results=18, budget=24_000)


def _any_accent(term: str) -> str:
    """A pattern of the term in which a letter stands for its accented forms too, so that texts need no folding."""
    accents = {u: [a for a, v in zip(L.ACCENTED, L.UNACCENTED, strict=True) if v == u] for u in set(L.UNACCENTED)}
    return "".join(f"[{c}{''.join(accents[c])}]" if c in accents else re.escape(c) for c in term)


def term_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, other columns, dl and an array of each distinct term's frequency.

    A passage's words are counted without being made, and only those that are terms come out of it."""
    distinct, letter = list(dict.fromkeys(terms)), "[\\p{L}\\p{N}]"
    known = [c for c in ("source_id",) if c in chunks.columns]
    dl = F.size(F.split("text", f"{letter}+")) - 1
    pattern = f"(?<!{letter})(?:{'|'.join(map(_any_accent, distinct))})(?!{letter})"
    hits = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)), T.fold) if distinct else F.array().cast("array<string>")
    counted = chunks.select("chunk_id", *known, dl.alias("dl"), hits.alias("hits"))
    is_term = lambda t: lambda w: w == F.lit(t)
    return counted.select("chunk_id", *known, "dl", F.array(*[F.size(F.filter("hits", is_term(t))) for t in distinct]).alias("tf"))


def idf(n_all: Column, n_with: Column) -> Column:
    raw = F.log((n_all - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term frequency's share of its idf, by the passage's length."""
    return tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))


def _statistics(counted: DataFrame, distinct: list[str]) -> DataFrame:
    holds = [F.sum((F.get("tf", F.lit(i)) > 0).cast("long")).alias(f"n{i}") for i in range(len(distinct))]
    return counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *holds)


def _score(terms: list[str], of: Callable[[str], Column]) -> Column:
    """BM25 of a row with dl and tf; ``of`` gives a statistic by its name. Terms in order, each as often as it was asked for."""
    score = F.lit(0.0)
    for i, t in enumerate(dict.fromkeys(terms)):
        part = saturation(F.get("tf", F.lit(i)).cast("double"), F.col("dl"), of("avgdl"))
        score = score + F.lit(float(terms.count(t))) * idf(of("n"), of(f"n{i}")) * part
    return score


def keyword_scores(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, source_id where there is one, keyword): BM25 of every chunk with a term, statistics over the whole table.

    A repeated term counts as often. One pass gathers the statistics as partial
    sums (a single row, broadcast), another scores; nothing is shuffled."""
    distinct = list(dict.fromkeys(terms))
    counted = term_counts(chunks, terms)
    known = [c for c in counted.columns if c not in ("dl", "tf")]
    if not distinct:
        return counted.select(*known, F.lit(0.0).alias("keyword")).where("false")
    # A score is above 0 where a term is held: asked of the score, as a filter on the
    # frequencies would move below their projection and have the words split twice.
    return counted.crossJoin(F.broadcast(_statistics(counted, distinct))).select(*known, _score(terms, F.col).alias("keyword")).where("keyword > 0")


def keyword_top(chunks: DataFrame, terms: list[str], n: int, eligible: DataFrame | None = None) -> list[Row]:
    """The best ``n`` (chunk_id, keyword) by ``keyword_scores``, of ``eligible`` sources where given.

    Texts are read once: the few numbers of each passage are kept, on disk beyond
    memory, while the statistics are summed and the list is made; what is lost with
    an executor is counted again."""
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return []
    counted = term_counts(chunks, terms).persist()
    try:
        stats = _statistics(counted, distinct).first()
        scored = counted.where(F.exists("tf", lambda f: f > 0)).withColumn("keyword", _score(terms, lambda name: F.lit(float(stats[name]))))
        return top(scored if eligible is None else scored.join(eligible, "source_id", "left_semi"), "keyword", n)
    finally:
        counted.unpersist()


def semantic_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(chunk_id, semantic): cosine with the query, where above 0; the query is a literal, so there is no join."""
    length = sum(x * x for x in query) ** 0.5
    # One expression of text: built of columns, its lambdas alone take the driver longer than a small scan.
    numbers = ", ".join(f"{float(x)!r}D" for x in query)
    products = f"zip_with(vector, cast(array({numbers}) AS array<double>), (x, y) -> coalesce(double(x) * y, 0D))"
    both = f"(sqrt(aggregate(vector, 0D, (s, x) -> s + double(x) * double(x))) * {length!r}D)"
    score = F.expr(f"CASE WHEN {both} = 0 THEN 0D ELSE aggregate({products}, 0D, (s, x) -> s + x) / {both} END")
    return vectors.select("chunk_id", score.alias("semantic")).where("semantic > 0")


def _ranked(scores: DataFrame, score: str, name: str) -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "chunk_id")))


def top(scores: DataFrame, score: str, n: int) -> list[Row]:
    """The best ``n`` rows, ties to the least chunk_id: a top list kept by each task and merged."""
    return scores.select("chunk_id", score).orderBy(F.desc(score), "chunk_id").limit(n).collect()


def ranks_of(scores: DataFrame, score: str, rows: list[Row]) -> list[int]:
    """Each row's rank among all scores. The rows, best first, part the scores into as many ranges
    and one; the counts of these are all that leaves a task."""
    return ranks_from(scores.select(rows_before(score, rows).alias("at"), F.lit(1).cast("long").alias("n")), len(rows)) if rows else []


def rows_before(score: str, rows: list[Row]) -> Column:
    """How many of some rows, best first, stand before a row: where it is put, so the rows themselves count in their own range or before."""
    ids = F.lit([r.chunk_id for r in rows]) if rows else F.array()
    limits = F.arrays_zip(doubles(r[score] for r in rows).alias("score"), ids.alias("id"))
    before = lambda x: (x["score"] > F.col(score)) | ((x["score"] == F.col(score)) & (x["id"] < F.col("chunk_id")))
    return F.size(F.filter(limits, before))


def ranks_from(counts: DataFrame, n: int) -> list[int]:
    """The ranks of ``n`` rows from how many rows stand in each range (at, n) that they part all into."""
    held = {r.at: r.n for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    return list(accumulate(held.get(i, 0) for i in range(n)))


@dataclass
class Scan:
    """The vector channel by a scan of all vectors: scores (chunk_id, semantic) and what fusion asks of them."""

    scores: DataFrame

    def top(self, n: int) -> list[Row]:
        return top(self.scores, "semantic", n)

    def scores_of(self, ids: list) -> list[Row]:
        return self.scores.where(F.col("chunk_id").isin(*ids)).select("chunk_id", "semantic").collect()

    def ranks_of(self, rows: list[Row]) -> list[int]:
        return ranks_of(self.scores, "semantic", rows)

    def count(self) -> int:
        return self.scores.count()


@dataclass
class Fused:
    """What the channels found: the best rows, whether there are any, and how many there were before the cut (a count of its own)."""

    rows: DataFrame
    ids: list
    count: Callable[[], int]


def fuse(semantic, keyword: list[Row], candidates: int, id_type: StructField) -> Fused:
    """(chunk_id, semantic, keyword, rrf, fused): the best ``candidates`` by reciprocal ranks; ``keyword`` is the top list of its channel,
    ``semantic`` the scores of the other, a ``Scan`` of them or an index's ``Channel``, or None.

    Only the first ``candidates`` of a channel can be among the best by rank in
    it alone. A keyword hit beyond the vector channel's list has its exact rank
    there counted. All lists here have ``candidates`` rows at most."""
    words = {r.chunk_id: (n, r.keyword) for n, r in enumerate(keyword[:candidates], 1)}
    near, hits = {}, []
    semantic = Scan(semantic) if isinstance(semantic, DataFrame) else semantic
    if semantic is not None:
        near = {r.chunk_id: (n, r.semantic) for n, r in enumerate(semantic.top(candidates), 1)}
        far = [i for i in words if i not in near]
        # A list that isn't full holds all rows above 0, so there are no others.
        if far and len(near) == candidates:
            hits = sorted(semantic.scores_of(far), key=lambda r: (-r.semantic, r.chunk_id))
        near |= {r.chunk_id: (n, r.semantic) for r, n in zip(hits, semantic.ranks_of(hits), strict=True)}
    rrf = {i: sum(1.0 / (RRF_K + c[i][0]) for c in (near, words) if i in c) * (BOTH_CHANNELS if i in near and i in words else 1.0) for i in {**near, **words}}
    best = sorted(rrf, key=lambda i: (-rrf[i], i))[:candidates]
    rows = [(i, near.get(i, (0, None))[1], words.get(i, (0, None))[1], rrf[i], rrf[i] / rrf[best[0]]) for i in best]
    schema = StructType([StructField("chunk_id", id_type.dataType), *(StructField(c, DoubleType()) for c in ("semantic", "keyword", "rrf", "fused"))])
    every = lambda: len(words) if semantic is None else semantic.count() + len([i for i in words if i not in near])
    return Fused(SparkSession.active().createDataFrame(rows, schema), best, every)


def passages_of(chunks: DataFrame, found: DataFrame, ids: list | None = None) -> DataFrame:
    """The chunks of a short list, with its columns: their ids, given or collected, reach the scan as a filter."""
    ids = [r.chunk_id for r in found.select("chunk_id").collect()] if ids is None else ids
    return chunks.where(F.col("chunk_id").isin(*ids) if ids else F.lit(False)).join(F.broadcast(found), "chunk_id")


def lexical_score(query: str, text: Column, heading: Column, token_count: Column, fused: Column) -> Column:
    """How well a passage answers the query: coverage, proximity, heading, frequency, density, blended with ``fused``."""
    wanted = sorted({T.stem_word(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in L.STOP_WORDS})
    if not wanted:
        return fused
    q, k = T.strings(wanted), F.lit(float(len(wanted)))
    # All but a stem's last letter begins its words, so other words need no stemming.
    begins = sorted({w[: max(1, min(3, len(w) - 1))] for w in wanted})
    maybe = lambda w: reduce(Column.__or__, [w.startswith(p) for p in begins])
    reduced = F.transform(T.tokens(text), lambda w: F.when(maybe(w), T.stem(w)).otherwise(w))

    def scored(words: Column) -> Column:
        n = F.size(words)
        share = lambda part: F.size(F.array_intersect(q, part)) / k
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STRIDE))
        proximity = F.coalesce(F.array_max(F.transform(starts, lambda i: share(F.slice(words, i + 1, F.lit(WINDOW))))), F.lit(0.0))
        matches = F.size(F.filter(words, lambda w: w.isin(*wanted))).cast("double")
        density = matches / F.greatest(F.lit(20), n)
        title = share(T.stems(T.tokens(F.coalesce(heading, F.lit("")))))
        frequency = F.least(F.lit(1.0), F.log(F.lit(1.0) + matches) / F.lit(3.0))
        score = share(words) * 0.44 + proximity * 0.24 + title * 0.16 + frequency * 0.10 + F.least(F.lit(1.0), density * 12.0) * 0.06
        return score * F.when(token_count < 40, F.lit(0.85)).otherwise(F.lit(1.0))

    return F.least(F.lit(1.0), T.let(reduced, scored) * 0.75 + fused * 0.25)


def select_rows(scored: DataFrame, settings: Settings, eligible_sources: int) -> DataFrame:
    """Cap for each source, floor, result count and token budget over (chunk_id, source_id, effective, token_count).

    The input is a candidate list of bounded size. Ties go to the least chunk_id."""
    s = settings.clamped()
    cap = max(s.per_source, s.results) if eligible_sources <= 1 else s.per_source
    order = [F.desc("effective"), F.asc("chunk_id")]
    capped = scored.withColumn("in_source", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).where(F.col("in_source") <= cap)
    few = F.count("*").over(Window.partitionBy()) <= 2
    above = capped.withColumn("few", few).where(F.col("few") | (F.col("effective") >= s.floor))
    ranked = above.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= s.results)
    used = F.sum(F.col("token_count") + ROW_OVERHEAD).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used_tokens", used).where((F.col("used_tokens") <= s.budget) | (F.col("rank") == 1)).drop("in_source", "few")


def held(picked: DataFrame) -> DataFrame:
    """Selected rows (60 at most, by ``Settings``) taken once, so that what follows reads no table again for them."""
    return picked.sparkSession.createDataFrame(picked.collect(), picked.schema)


class NoSources(ValueError):
    """No source is included and in scope."""


#: How many of the best candidates a model may score anew.
MODEL_RERANK = 20
NOTICE_NO_VECTORS = "Meaning search was unavailable, so only keywords were used."
NOTICE_NO_RERANK = "The model's ranking could not be read, so the built-in one was used."


@dataclass
class Outcome:
    """The selected rows, what went less than well, and the number of candidates before the cut, counted when asked for."""

    rows: DataFrame
    notices: list[str]
    candidates: Callable[[], int]


def with_model_scores(scored: DataFrame, score: Callable[[list[Row]], list[float] | None], notices: list[str], most: int = MODEL_RERANK) -> DataFrame:
    """``effective`` of the best ``most`` replaced by a model's scores (0 to 1); others stay, as all do without a readable reply."""
    first = scored.orderBy(F.desc("effective"), "chunk_id").limit(most).select("chunk_id", "heading", "text").collect()
    given = score(first) if first else []
    if given is None or len(given) != len(first):
        notices.append(NOTICE_NO_RERANK)
        return scored
    if not first:
        return scored
    schema = StructType([scored.schema["chunk_id"], StructField("given", DoubleType())])
    new = scored.sparkSession.createDataFrame([(r.chunk_id, float(v)) for r, v in zip(first, given, strict=True)], schema)
    return scored.join(F.broadcast(new), "chunk_id", "left").withColumn("effective", F.coalesce("given", "effective")).drop("given")


def search(
    chunks: DataFrame, vectors, query: str, query_vector: list[float] | Callable[[str], list[float]] | None = None, settings: Settings = Settings(),
    rerank=None, eligible: DataFrame | None = None, index=None, model: Callable[[list[Row]], list[float] | None] | None = None,
) -> Outcome:
    """Rows (chunk_id, source_id, semantic, keyword, fused, effective, rank, used_tokens) of the selected passages.

    ``eligible`` (source_id) keeps both channels to sources that are included and in
    scope; it comes after the keyword statistics, and where it has no row NoSources
    is raised. ``index`` (``keyword_index.Index`` or ``BlockIndex``) saves the keyword channel
    from reading texts; ``vectors`` (chunk_id, vector) may be a ``VectorIndex`` instead. ``query_vector`` may be an embedder; where it fails, the keyword channel
    stands alone, with a notice. An empty query finds nothing. With no candidate
    at all and no floor, the first passages in reading order are taken. ``rerank``
    replaces the lexical score: a function of (candidates) that returns them with
    a column ``effective``; ``model`` scores the best ``MODEL_RERANK`` after that."""
    s, notices = settings.clamped(), []
    several = None
    if eligible is not None:
        eligible = eligible.select("source_id").distinct()
        several = len(eligible.limit(2).collect())
        if not several:
            raise NoSources("no source is included and in scope")
    terms = T.keyword_terms(query)
    within = lambda rows: rows if eligible is None else rows.join(eligible, "source_id", "left_semi")
    if callable(query_vector):
        try:
            query_vector = query_vector(query) if query.strip() else None
        except Exception:
            query_vector = None
            notices.append(NOTICE_NO_VECTORS)
    semantic = None
    if hasattr(vectors, "channel"):
        semantic = vectors.channel(query_vector, eligible) if query_vector and query.strip() else None
    elif vectors is not None and query_vector and query.strip():
        semantic = semantic_scores(vectors, query_vector)
        if eligible is not None:
            owned = vectors.select("chunk_id", "source_id") if "source_id" in vectors.columns else chunks.select("chunk_id", "source_id")
            semantic = semantic.join(within(owned).select("chunk_id"), "chunk_id", "left_semi")
    keyword = keyword_top(chunks, terms, s.candidates, eligible) if index is None else index.top(terms, s.candidates, eligible)
    found = fuse(semantic, keyword, s.candidates, chunks.schema["chunk_id"])
    fused, ids = found.rows, found.ids
    if s.floor <= 0 and query.strip() and not ids:
        ids = [r.chunk_id for r in within(chunks).orderBy("chunk_id").limit(s.candidates).select("chunk_id").collect()]
        fused = chunks.sparkSession.createDataFrame([(i, None, None, 1.0, 1.0) for i in ids], fused.schema)
    rows = passages_of(chunks, fused, ids)
    if rerank is None:
        rows = rows.withColumn("effective", lexical_score(query, F.col("text"), F.col("heading"), F.col("token_count"), F.col("fused")))
    else:
        rows = rerank(rows)
    if model is not None:
        rows = with_model_scores(rows, model, notices)
    # The candidates, without their texts, are one short list, so nothing is shuffled to select from them.
    scored = rows.select("chunk_id", "source_id", "semantic", "keyword", "fused", "effective", "token_count")
    short = scored.collect()
    if several is None:
        several = 2 if len({r.source_id for r in short}) > 1 else _sources(chunks)
    picked = select_rows(chunks.sparkSession.createDataFrame(short, scored.schema).coalesce(1), s, several)
    return Outcome(held(picked), notices, found.count)


def _sources(chunks: DataFrame) -> int:
    """1 where all passages are of one source, else 2."""
    ends = chunks.agg(F.min("source_id").alias("a"), F.max("source_id").alias("b")).first()
    return 1 if ends.a == ends.b else 2


def trace(found: Outcome, chunks: DataFrame) -> DataFrame:
    """What was found and why, a row for each passage: its scores, a preview of 180 characters, whether it went into the
    context, and the whole retrieval's figures: candidates before the cut, tokens used, and a word where nothing matched."""
    rows = passages_of(chunks.select("chunk_id", "text", "heading"), found.rows.drop("heading"))
    shown = rows.select("rank", "chunk_id", "source_id", "semantic", "keyword", "fused", "effective", "heading", T.preview(F.col("text"), 180).alias("preview"), F.lit(True).alias("in_context"))
    used = found.rows.agg(F.coalesce(F.max("used_tokens"), F.lit(0)).alias("tokens_used"), F.count("*").alias("hits"))
    said = F.when(F.col("hits") == 0, F.lit(NOTHING_MATCHED))
    figures = used.select("tokens_used", F.lit(found.candidates()).alias("candidates"), F.concat_ws(" ", *[F.lit(n) for n in found.notices], said).alias("notes"))
    return figures.join(shown, how="left")


NOTHING_MATCHED = "No passage matched the question."


def retrieve(chunks: DataFrame, vectors, query: str, query_vector=None, settings: Settings = Settings(), rerank=None, eligible: DataFrame | None = None, index=None) -> DataFrame:
    """The selected passages of ``search``."""
    return search(chunks, vectors, query, query_vector, settings, rerank, eligible, index).rows


def assemble(selected: DataFrame, chunks: DataFrame, titles: DataFrame, budget: int) -> DataFrame:
    """(n, chunk_id, marker, body, estimate): context blocks in rank order while the budget lasts, the first always.

    ``selected`` (chunk_id, rank, source_id where it is known) has 60 rows at most; of ``titles`` (a row for each
    source) only theirs are taken."""
    rows = passages_of(chunks, selected.select("chunk_id", "rank"))
    owners = (selected if "source_id" in selected.columns else rows).select("source_id").distinct()
    rows = rows.join(F.broadcast(titles.join(F.broadcast(owners), "source_id", "left_semi")), "source_id", "left")
    number = F.row_number().over(Window.orderBy("rank"))
    marker = F.concat(F.lit("[Source "), F.col("n").cast("string"), F.lit("]"))
    section = F.when(F.col("heading").isNotNull() & (F.col("heading") != ""), F.concat(F.lit("\nSection: "), "heading")).otherwise("")
    place = F.when(F.col("location").isNotNull() & (F.col("location") != ""), F.concat(F.lit(" — "), "location")).otherwise("")
    body = F.concat(F.col("marker"), F.lit(" "), F.col("title"), place, section, F.lit("\n"), F.col("text"))
    blocks = rows.withColumn("n", number).withColumn("marker", marker).withColumn("body", body).withColumn("estimate", T.token_estimate(F.col("body")))
    total = F.sum("estimate").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("total", total).where((F.col("total") <= budget) | (F.col("n") == 1)).select("n", "chunk_id", "marker", "body", "estimate")


WEB_ALLOWANCE = 1200
# Headings of the context's two parts.
SOURCES_HEADING = "NOTEBOOK SOURCES (the user's own collected material):"
WEB_HEADING = "WEB RESULTS (live search; NOT part of the user's notebook):"
BETWEEN = "\n\n---\n\n"


def assemble_web(web: DataFrame, blocks: DataFrame, budget: int) -> DataFrame:
    """(n, marker, body, estimate) of web results (position, title, url, content): they go on with the
    count of the source ``blocks``, up to ``WEB_ALLOWANCE`` beyond the budget; the first block of all stays."""
    used = blocks.agg(F.coalesce(F.sum("estimate"), F.lit(0)).alias("used"))
    numbered = web.withColumn("n", F.row_number().over(Window.orderBy("position")))
    marker = F.concat(F.lit("[Web "), F.col("n").cast("string"), F.lit("]"))
    body = F.concat(F.col("marker"), F.lit(" "), "title", F.lit(" — "), "url", F.lit("\n"), T.preview(F.col("content"), 1200))
    rows = numbered.withColumn("marker", marker).withColumn("body", body).withColumn("estimate", T.token_estimate(F.col("body"))).crossJoin(F.broadcast(used))
    total = F.col("used") + F.sum("estimate").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("total", total).where((F.col("total") <= budget + WEB_ALLOWANCE) | ((F.col("n") == 1) & (F.col("used") == 0)))
    return kept.select("n", "marker", "body", "estimate")


def context_text(blocks: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """One row (context): the blocks under their headings, which a part without blocks lacks."""
    rows = blocks.select(F.lit(0).alias("part"), "n", "body")
    rows = rows if web is None else rows.unionByName(web.select(F.lit(1).alias("part"), "n", "body"))
    # Blocks are as few as the budget allows.
    one = rows.agg(F.sort_array(F.collect_list(F.struct("part", "n", "body"))).alias("all"))
    part = lambda i, head: F.filter("all", lambda x: x["part"] == i) if head is None else F.concat(F.lit(f"{head}\n\n"), F.array_join(F.transform(F.filter("all", lambda x: x["part"] == i), lambda x: x["body"]), BETWEEN))
    shown = [F.when(F.size(part(i, None)) > 0, part(i, head)) for i, head in ((0, SOURCES_HEADING), (1, WEB_HEADING))]
    return one.select(F.array_join(F.array_compact(F.array(*shown)), "\n\n").alias("context"))


def resolve_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, cited, invented, cleaned, insufficient) of (answer_id, answer), citations being (answer_id, marker).

    Cited markers in order of appearance; markers without a citation are taken
    out of the text, which is touched only then."""
    known = citations.groupBy("answer_id").agg(F.collect_set("marker").alias("known"))
    found = answers.join(known, "answer_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))).withColumn("written", T.markers(F.col("answer")))
    cited = F.array_distinct(F.filter(F.transform("written", T.normal_marker), lambda m: F.array_contains("known", m)))
    invented = F.array_distinct(F.filter("written", lambda m: ~F.array_contains("known", T.normal_marker(m))))
    gone = F.aggregate("invented", F.col("answer"), lambda a, m: F.replace(a, m, F.lit("")))
    cleaned = F.when(F.size("invented") == 0, F.col("answer")).otherwise(T.tidy(gone))
    return found.withColumn("cited", cited).withColumn("invented", invented).select("answer_id", "cited", "invented", cleaned.alias("cleaned"), T.reports_insufficiency(F.col("answer")).alias("insufficient"))
