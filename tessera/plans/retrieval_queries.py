"""Queries of the retrieval operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import sql as S
from tessera.functions import text as T
from tessera.operators import keyword_index, listings, store
from tessera.operators import retrieval as R
from tessera.plans.views import PASSAGES_SQL, documents, messages, passages, table, vectors

QUESTION = "What are the inspections of inand heand and thedge erthat?"
TERMS = T.keyword_terms("inand thth eaer ingand thed")
PROBE_ID = 7


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_scores(passages(spark, sf_dir), TERMS)


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.round("keyword", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyword retrieval with markers and previews."""
    best = R.keyword_top(passages(spark, sf_dir), TERMS, 20)
    ranked = spark.createDataFrame([(r.chunk_id, r.keyword, n) for n, r in enumerate(best, 1)], "chunk_id long, keyword double, rank int")
    rows = R.passages_of(passages(spark, sf_dir), ranked)
    marker = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]"))
    return rows.select("chunk_id", "source_id", F.round("keyword", 6).alias("score"), marker.alias("marker"), T.preview(F.col("text"), 80).alias("preview"))


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites that are included (the hash of their name is even) and in scope (all but src1)."""
    sites = documents(spark, sf_dir).select(F.col("source").alias("source_id")).distinct().withColumn("included", F.ascii(F.md5(F.col("source_id").cast("binary"))) % 2 == 0)
    return listings.eligible(sites, sites.where("source_id <> 'src1'"))


def scoped_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores within a scope; their statistics are over all passages."""
    return _ids(_terms(spark, sf_dir).join(_scope(spark, sf_dir), "source_id", "left_semi"))


def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of ``bm25_all``, from postings."""
    return _ids(keyword_index.Index.of(passages(spark, sf_dir)).scores(TERMS))


def scoped_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels within a scope, fused."""
    question = " ".join(TERMS)
    found = R.search(passages(spark, sf_dir), vectors(spark, sf_dir), question, _probe(spark, sf_dir), R.Settings(results=40, per_source=50, floor=0.0, budget=200_000), lambda c: c.withColumn("effective", F.round("fused", 9)), _scope(spark, sf_dir))
    return found.rows.select("chunk_id", "source_id", F.round("fused", 6).alias("fused"), "rank")


def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from an index whose postings of one language were replaced by those of changed texts."""
    whole = passages(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    changed = whole.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" inand the inand")))
    owned = lambda df: df.select("chunk_id", F.col("chunk_id").alias("source_id"), "text")
    rows = store.replace_children(keyword_index.postings(owned(whole)), keyword_index.postings(owned(changed)), owned(changed), "source_id", None)
    counts = keyword_index.statistics(rows.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(8))))
    return _ids(keyword_index.Index(rows, counts).scores(TERMS))


def no_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search says where no source is in scope."""
    try:
        R.search(passages(spark, sf_dir), None, "inand", eligible=_scope(spark, sf_dir).where("false"))
        said = None
    except R.NoSources as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "problem string")


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("chunk_id", F.round("keyword", 6).alias("score"))


def fts_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms of every benchmark question as words over two letters without stop words."""
    words = F.filter(T.content(T.tokens(F.col("text"))), lambda w: F.length(w) > 2)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(words).cast("long").alias("n_terms"), F.array_join(T.stems(words), " ").alias("stems"))


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = vectors(spark, sf_dir).where(F.col("chunk_id") == PROBE_ID).first()
    return [float(x) for x in row.vector] if row else []


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of documents with the same number stand for their passages' vectors."""
    chunks = passages(spark, sf_dir)
    return R.fuse(R.semantic_scores(vectors(spark, sf_dir), _probe(spark, sf_dir)), R.keyword_top(chunks, TERMS, 40), 40, chunks.schema["chunk_id"]).rows


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("chunk_id", F.round("semantic", 6).alias("semantic"), F.round("keyword", 6).alias("keyword"), F.round("fused", 6).alias("fused"))


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.lexical_score(" ".join(TERMS), F.col("text"), F.col("heading"), F.col("token_count"), F.lit(0.5))
    return passages(spark, sf_dir).select("chunk_id", F.round(score, 6).alias("rerank"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.passages_of(passages(spark, sf_dir), _fused(spark, sf_dir))
    score = R.lexical_score(" ".join(TERMS), F.col("text"), F.col("heading"), F.col("token_count"), F.col("fused"))
    return found.select("chunk_id", "source_id", F.round(score, 9).alias("effective"), "token_count")


def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.select_rows(_scored(spark, sf_dir), R.Settings(results=60, per_source=2, floor=0.0, budget=200_000), 20)
    return out.select("chunk_id", "source_id", F.round("effective", 6).alias("effective"), "rank")


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.select_rows(_scored(spark, sf_dir), R.Settings(results=60, per_source=50, floor=0.4, budget=200_000), 20)
    return out.select("chunk_id", F.round("effective", 6).alias("effective"), "rank")


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.select_rows(_scored(spark, sf_dir), R.Settings(results=60, per_source=50, floor=0.0, budget=3000), 20)
    return out.select("chunk_id", "rank", F.col("used_tokens").cast("long").alias("used_tokens"))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels, fusion, rerank, cap, floor and budget: a few jobs that end in short lists, then one over these."""
    question = " ".join(TERMS)
    out = R.retrieve(passages(spark, sf_dir), vectors(spark, sf_dir), question, _probe(spark, sf_dir), R.Settings(budget=12_000), lambda c: c.withColumn("effective", F.round(R.lexical_score(question, F.col("text"), F.col("heading"), F.col("token_count"), F.col("fused")), 9)))
    return out.select("chunk_id", "source_id", F.round("fused", 6).alias("fused"), F.round("effective", 6).alias("effective"), "rank", F.col("used_tokens").cast("long").alias("used_tokens"))


def whole_document_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that no passage answers, without a floor: the first passages in reading order."""
    out = R.retrieve(passages(spark, sf_dir), None, "zzzzqq xxxxqq", None, R.Settings(floor=0.0, per_source=50, budget=200_000), lambda c: c.withColumn("effective", F.col("fused")))
    return out.select("chunk_id", "source_id", "rank")


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = passages(spark, sf_dir)
    picked = R.held(R.select_rows(_scored(spark, sf_dir), R.Settings(results=12, per_source=3, floor=0.0, budget=200_000), 20))
    titles = documents(spark, sf_dir).select(F.col("source").alias("source_id")).distinct().select("source_id", F.upper("source_id").alias("title"), F.lit("page 1").alias("location"))
    blocks = R.assemble(picked, chunks, titles, 6000)
    return blocks.select("n", "chunk_id", "marker", F.sha2("body", 256).alias("body_sha256"), "estimate")


def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of conversation texts with markers, some of them invented."""
    said = messages(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    n = F.col("conv_id") % 5
    answer = F.concat("text", F.lit(" as shown [Source "), n.cast("string"), F.lit("] and [web"), (n + 1).cast("string"), F.lit("] , with [source 2]."), F.when(n == 0, " The context does not say.").otherwise(""))
    answers = said.select(F.col("conv_id").alias("answer_id"), answer.alias("answer"))
    known = answers.select("answer_id", F.explode(F.array(F.lit("[Source 1]"), F.lit("[Source 2]"), F.lit("[Web 2]"))).alias("marker"))
    out = R.resolve_citations(answers, known)
    return out.select("answer_id", F.array_join("cited", "|").alias("cited"), F.array_join("invented", "|").alias("invented"), "cleaned", "insufficient")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_all, scoped_bm25, indexed_bm25, scoped_retrieve, index_replace, no_source, fts_terms, rrf_fusion, lexical_rerank, per_source_cap, score_floor, budget_prefix, hybrid_retrieve, whole_document_fallback, context_assembly, citation_resolve)}

_DISTINCT = list(dict.fromkeys(TERMS))
_WANTED = S.texts(sorted({T.stem_word(t) for t in TERMS if t not in L.STOP_WORDS}))


def _bm25_sql() -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x = {S.text(t)}))::DOUBLE AS f{i}" for i, t in enumerate(_DISTINCT))
    held = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(_DISTINCT)))
    part = lambda i, t: f"{float(TERMS.count(t))} * greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 0.000001) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    some = " OR ".join(f"f{i} > 0" for i in range(len(_DISTINCT)))
    return f"""words AS (SELECT chunk_id, {S.tokens(S.fold("lower(text)"))} AS w FROM passages),
counts AS (SELECT chunk_id, len(w)::DOUBLE AS dl, {counts} FROM words),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {held} FROM counts),
bm AS (SELECT chunk_id, {" + ".join(part(i, t) for i, t in enumerate(_DISTINCT))} AS keyword FROM counts, stats WHERE {some})"""


_BASE = f"WITH {PASSAGES_SQL}, {_bm25_sql()}"
_SCOPE = "scope AS (SELECT DISTINCT source AS source_id FROM documents WHERE ascii(md5(source)) % 2 = 0 AND source <> 'src1')"
_CHANGED = PASSAGES_SQL.replace("source AS source_id, text,", "source AS source_id, CASE WHEN lang = 'de' THEN text || ' inand the inand' ELSE text END AS text,")
_FUSED = f""",
probe AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = {PROBE_ID} LIMIT 1),
sem0 AS (SELECT vec_id AS chunk_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) AS semantic FROM embeddings, probe),
sem AS (SELECT *, row_number() OVER (ORDER BY semantic DESC, chunk_id) AS sr FROM sem0 WHERE semantic > 0),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY keyword DESC, chunk_id) AS kr FROM bm) WHERE kr <= 40),
rrf AS (SELECT coalesce(sem.chunk_id, kw.chunk_id) AS chunk_id, semantic, keyword,
  (coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + kr), 0)) * CASE WHEN sr IS NOT NULL AND kr IS NOT NULL THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS rrf
  FROM sem FULL JOIN kw ON sem.chunk_id = kw.chunk_id),
best AS (SELECT * FROM rrf ORDER BY rrf DESC, chunk_id LIMIT 40),
fused AS (SELECT *, rrf / max(rrf) OVER () AS fused FROM best)"""


def _lexical_sql(source: str, fused: str) -> str:
    k = f"len({_WANTED})::DOUBLE"
    share = lambda part: f"len(list_intersect({_WANTED}, {part})) / {k}"
    return f"""stemmed AS (SELECT chunk_id, source_id, token_count, {fused} AS fused, {S.stems(S.tokens("text"))} AS st, {S.stems(S.tokens("heading"))} AS hs FROM {source}),
feat AS (SELECT *, {share("st")} AS cov, coalesce(list_max(list_transform(range(0, greatest(len(st), 1), {R.STRIDE}), lambda i: {share(f"st[i+1:i+{R.WINDOW}]")})), 0) AS prox,
  {share("hs")} AS head, len(list_filter(st, lambda x: list_contains({_WANTED}, x)))::DOUBLE AS m FROM stemmed),
lex AS (SELECT *, least(1.0::DOUBLE, (cov * 0.44::DOUBLE + prox * 0.24::DOUBLE + head * 0.16::DOUBLE + least(1.0::DOUBLE, ln(1.0::DOUBLE + m) / 3.0::DOUBLE) * 0.10::DOUBLE
  + least(1.0::DOUBLE, m / greatest(20, len(st)) * 12.0::DOUBLE) * 0.06::DOUBLE) * CASE WHEN token_count < 40 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END * 0.75::DOUBLE + fused * 0.25::DOUBLE) AS effective FROM feat)"""


_LEX = _BASE + _FUSED + f""",
cand AS (SELECT p.*, f.fused AS fu FROM passages p JOIN fused f USING (chunk_id)), {_lexical_sql("cand", "fu")},
scored AS (SELECT chunk_id, source_id, token_count, fused, round(effective, 9) AS effective FROM lex)"""


def _select_sql(cap: int, floor: float, results: int, budget: int) -> str:
    return f""",
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY effective DESC, chunk_id) AS i FROM scored) WHERE i <= {cap}),
above AS (SELECT * FROM (SELECT *, count(*) OVER () <= 2 AS few FROM capped) WHERE few OR effective >= {floor}::DOUBLE),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY effective DESC, chunk_id)::INT AS rank FROM above) WHERE rank <= {results}),
picked AS (SELECT * FROM (SELECT *, (sum(token_count + 24) OVER (ORDER BY rank))::BIGINT AS used_tokens FROM ranked) WHERE used_tokens <= {budget} OR rank = 1)"""


_ANSWER = "text || ' as shown [Source ' || (conv_id % 5) || '] and [web' || (conv_id % 5 + 1) || '] , with [source 2].' || CASE WHEN conv_id % 5 = 0 THEN ' The context does not say.' ELSE '' END"

SQL = {
    "bm25_topk": _BASE + f""", top AS (SELECT chunk_id, keyword, row_number() OVER (ORDER BY keyword DESC, chunk_id) AS r FROM bm)
SELECT chunk_id, source_id, round(keyword, 6) AS score, '[Source ' || r || ']' AS marker, {S.preview("text", 80)} AS preview FROM top JOIN passages USING (chunk_id) WHERE r <= 20""",
    "scoped_bm25": _BASE + f", {_SCOPE} SELECT chunk_id, round(keyword, 6) AS score FROM bm JOIN passages USING (chunk_id) WHERE source_id IN (SELECT source_id FROM scope)",
    "indexed_bm25": _BASE + " SELECT chunk_id, round(keyword, 6) AS score FROM bm",
    "index_replace": f"WITH {_CHANGED}, {_bm25_sql()} SELECT chunk_id, round(keyword, 6) AS score FROM bm",
    "scoped_retrieve": _BASE + f", {_SCOPE}, owned AS (SELECT chunk_id, source_id, token_count FROM passages WHERE source_id IN (SELECT source_id FROM scope))" + _FUSED.replace("FROM embeddings, probe)", "FROM embeddings JOIN owned ON vec_id = chunk_id, probe)").replace("FROM bm)", "FROM bm JOIN owned USING (chunk_id))") + """,
        scored AS (SELECT *, round(fused, 9) AS effective FROM fused JOIN owned USING (chunk_id)), n AS (SELECT count(*) AS n FROM scope),
        capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY effective DESC, chunk_id) AS i FROM scored) WHERE i <= 50)
        SELECT chunk_id, source_id, round(fused, 6) AS fused, row_number() OVER (ORDER BY effective DESC, chunk_id)::INT AS rank FROM capped""",
    "no_source": "SELECT 'no source is included and in scope' AS problem",
    "bm25_all": _BASE + " SELECT chunk_id, round(keyword, 6) AS score FROM bm",
    "fts_terms": f"SELECT item_id, len(w)::BIGINT AS n_terms, array_to_string({S.stems('w')}, ' ') AS stems FROM (SELECT item_id, list_filter({S.content(S.tokens('text'))}, lambda x: length(x) > 2) AS w FROM benchmark)",
    "rrf_fusion": _BASE + _FUSED + " SELECT chunk_id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(fused, 6) AS fused FROM fused",
    "lexical_rerank": f"WITH {PASSAGES_SQL}, {_lexical_sql('passages', '0.5::DOUBLE')} SELECT chunk_id, round(effective, 6) AS rerank FROM lex",
    "per_source_cap": _LEX + _select_sql(2, 0.0, 60, 200_000) + " SELECT chunk_id, source_id, round(effective, 6) AS effective, rank FROM picked",
    "score_floor": _LEX + _select_sql(50, 0.4, 60, 200_000) + " SELECT chunk_id, round(effective, 6) AS effective, rank FROM picked",
    "budget_prefix": _LEX + _select_sql(50, 0.0, 60, 3000) + " SELECT chunk_id, rank, used_tokens FROM picked",
    "hybrid_retrieve": _LEX + _select_sql(3, 0.08, 8, 12_000) + " SELECT chunk_id, source_id, round(fused, 6) AS fused, round(effective, 6) AS effective, rank, used_tokens FROM picked",
    "whole_document_fallback": f"""WITH {PASSAGES_SQL}, first AS (SELECT chunk_id, source_id, token_count FROM passages ORDER BY chunk_id LIMIT 40)
SELECT chunk_id, source_id, row_number() OVER (ORDER BY chunk_id)::INT AS rank FROM first QUALIFY rank <= 8""",
    "context_assembly": _LEX + _select_sql(3, 0.0, 12, 200_000) + f""",
blocks AS (SELECT rank AS n, k.chunk_id, '[Source ' || rank || ']' AS marker, '[Source ' || rank || '] ' || upper(k.source_id) || ' — page 1' || CASE WHEN heading <> '' THEN chr(10) || 'Section: ' || heading ELSE '' END || chr(10) || text AS body
  FROM picked k JOIN passages USING (chunk_id)),
est AS (SELECT *, {S.token_estimate("body")} AS estimate FROM blocks), tot AS (SELECT *, sum(estimate) OVER (ORDER BY n) AS total FROM est)
SELECT n, chunk_id, marker, sha256(body) AS body_sha256, estimate FROM tot WHERE total <= 6000 OR n = 1""",
    "citation_resolve": rf"""WITH said AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id AS answer_id, {_ANSWER} AS answer FROM said),
m AS (SELECT *, regexp_extract_all(answer, '(?i){L.MARKER}') AS ms FROM a),
n AS (SELECT *, list_transform(ms, lambda x: '[' || CASE WHEN starts_with(lower(x), '[web') THEN 'Web' ELSE 'Source' END || ' ' || regexp_replace(x, '[^0-9]', '', 'g') || ']') AS ns FROM m),
u AS (SELECT answer_id, answer, list_filter(ns, lambda x, i: list_contains(['[Source 1]', '[Source 2]', '[Web 2]'], x) AND list_position(ns, x) = i) AS cited,
  list_filter(ms, lambda x, i: NOT list_contains(['[Source 1]', '[Source 2]', '[Web 2]'], ns[i]) AND list_position(ms, x) = i) AS invented FROM n),
g AS (SELECT *, list_reduce(list_prepend(answer, invented), lambda t, x: replace(t, x, '')) AS gone FROM u)
SELECT answer_id, array_to_string(cited, '|') AS cited, array_to_string(invented, '|') AS invented,
  CASE WHEN len(invented) = 0 THEN answer ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(gone, ' {{2,}}', ' ', 'g'), ' ([.,;])', '\1', 'g'), chr(10) || ' ', chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS cleaned,
  {" OR ".join(f"contains(lower(answer), {S.text(p)})" for p in L.INSUFFICIENCY_PHRASES)} AS insufficient FROM g""",
}
