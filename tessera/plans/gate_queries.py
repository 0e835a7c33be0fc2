"""Queries of gates, failures, robots rules by origin, SQL over a store, the event log and traces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import gates, render
from tessera.functions import sql as S
from tessera.operators import retrieval as R
from tessera.operators.events import EventLog
from tessera.plans import retrieval_queries as Q
from tessera.plans.stored_queries import library, scratch
from tessera.plans.views import PASSAGES_SQL, SOURCES_SQL, pages, passages, sources, table, vectors
from tessera.sources import robots


def provider_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's provider may be asked, its flags being the bits of the order's number."""
    k = F.col("o_orderkey")
    flags = {name: (F.shiftright(k, i) % 2 == 1) for i, name in enumerate(gates.FLAGS)}
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.decision(flags).alias("d")).select("o_orderkey", "d.*")


def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page is no document: statuses, gates and lengths of text made of the page itself."""
    p, n = pages(spark, sf_dir), F.length("html")
    blocked = F.when(n % 11 == 0, "status 403").when(n % 11 == 1, "Sign in to read on").when(n % 11 == 2, "for subscribers")
    made = p.select("page_id", F.when(n % 13 == 0, 500).otherwise(200).alias("status"), blocked.alias("blocked"), (n % 3 * 100).alias("length"), F.col("html").contains("div").alias("client"))
    return made.select("page_id", gates.page_failure(F.col("status"), F.col("blocked"), F.col("length"), F.col("client")).alias("failure"))


_FILES = {"": "User-agent: *\nDisallow: /en/\nAllow: /en/1 # some\n", ":8080": "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /*7$\nDisallow: /e(n\n"}
_PORT = "CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':8080' ELSE ':9090' END"


def robots_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for pages on three ports of each host, two of which have rules of their own and one has no file."""
    at = pages(spark, sf_dir).select("page_id", F.expr(f"regexp_replace(url, '^([a-z]+://[^/]+)', concat('$1', {_PORT}))").alias("url"))
    known = at.select("page_id", robots.origin(F.col("url")).alias("origin"), robots.path_of(F.col("url")).alias("path"))
    port = F.regexp_extract("origin", "(:[0-9]+)$", 1)
    text = F.when(port == "", _FILES[""]).when(port == ":8080", _FILES[":8080"])
    files = known.select("origin").distinct().select("origin", F.when(text.isNull(), 404).otherwise(200).alias("status"), text.alias("text"))
    out = robots.decide(known.withColumnRenamed("page_id", "id"), robots.rule_rows(files))
    return out.select(F.col("id").alias("page_id"), "allowed", "rule")


_STORE_SQL = "SELECT source_id, count(*) AS passages, max(token_count) AS longest FROM chunks WHERE token_count > :least GROUP BY source_id"


def source_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second line of every source: some have pages, some no site, some neither pages nor words."""
    s, k = sources(spark, sf_dir), F.col("doc_id")
    site = F.when(k % 4 == 0, F.lit("")).when(k % 4 != 1, F.col("site"))
    pages_ = F.when(k % 3 == 0, F.col("chunk_count"))
    return s.select("doc_id", render.subtitle(F.col("notebook"), site, pages_, F.when(k % 5 == 0, 0).otherwise(F.col("words"))).alias("subtitle"))


def store_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a named parameter over the tables of a store."""
    return library(spark, sf_dir, index=False).sql(_STORE_SQL, {"least": 40})


def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 400 events of a log that keeps errors and what informs."""
    log = EventLog(spark, scratch(spark), "info")
    level = F.when(F.col("event_id") % 5 == 0, "error").when(F.col("event_id") % 5 < 3, "info").otherwise("debug")
    log.append(table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), level.alias("level"), F.lit("events").alias("category"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message")))
    return log.tail().select("number", "level", "message")


def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of ``hybrid_retrieve``: each passage's scores and preview, and the figures of the whole."""
    question, chunks = " ".join(Q.TERMS), passages(spark, sf_dir)
    score = lambda c: c.withColumn("effective", F.round(R.lexical_score(question, F.col("text"), F.col("heading"), F.col("token_count"), F.col("fused")), 9))
    found = R.search(chunks, vectors(spark, sf_dir), question, Q._probe(spark, sf_dir), R.Settings(budget=12_000), score)
    t = R.trace(found, chunks)
    return t.select("rank", "chunk_id", F.round("effective", 6).alias("effective"), "preview", F.col("tokens_used").cast("long").alias("tokens_used"), F.col("candidates").cast("long").alias("candidates"), "notes")


QUERIES = {f.__name__: f for f in (provider_gates, page_failures, robots_origins, source_subtitles, store_sql, event_tail, retrieval_trace)}


def _gates_sql() -> str:
    bit = lambda name: f"(o_orderkey >> {gates.FLAGS.index(name)}) % 2 = 1"
    holds = lambda wanted: " AND ".join(bit(k) if v else f"NOT ({bit(k)})" for k, v in wanted.items())
    pick = lambda of, rest: "CASE " + " ".join(f"WHEN {holds(w)} THEN {of(s, r, c)}" for s, w, r, c in gates.RULES) + f" ELSE {rest} END"
    null = lambda x: "NULL" if x is None else S.text(x)
    return f"SELECT o_orderkey, {pick(lambda s, r, c: S.text(s), S.text(gates.READY))} AS state, {pick(lambda s, r, c: null(r), 'NULL')} AS reason, {pick(lambda s, r, c: null(c), 'NULL')} AS recovery FROM orders"


_TRACED = Q.SQL["hybrid_retrieve"].split(" SELECT chunk_id, source_id, round(fused")[0]
SQL = {
    "provider_gates": _gates_sql(),
    "page_failures": """SELECT page_id, CASE WHEN n % 11 = 0 THEN 'download failed' WHEN n % 11 IN (1, 2) THEN 'sign-in required' WHEN n % 13 = 0 THEN 'download failed'
        WHEN n % 3 = 0 AND contains(html, 'div') THEN 'needs a browser' WHEN n % 3 = 0 THEN 'no readable text' END AS failure FROM (SELECT *, length(html) AS n FROM pages)""",
    "robots_origins": r"""WITH p AS (SELECT page_id, page_id % 3 AS port, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(port, rule, allow, regex) AS (VALUES (0, '/en/', false, '^/en/'), (0, '/en/1', true, '^/en/1'), (1, '/*7$', false, '^/.*7$'), (1, '/e(n', false, '^/e\(n')),
        h AS (SELECT page_id, max({'n': length(rule), 'allow': allow, 'rule': rule}) AS b FROM p JOIN r ON p.port = r.port AND regexp_matches(CASE path WHEN '' THEN '/' ELSE path END, regex) GROUP BY page_id)
        SELECT p.page_id, coalesce(b.allow, true) AS allowed, b.rule AS rule FROM p LEFT JOIN h ON p.page_id = h.page_id""",
    "source_subtitles": f"""WITH {SOURCES_SQL}, c AS (SELECT doc_id, notebook, CASE WHEN doc_id % 4 > 1 THEN site END AS home, CASE WHEN doc_id % 3 = 0 THEN chunk_count ELSE 0 END AS p, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE words END AS w FROM sources)
        SELECT doc_id, concat_ws(' · ', notebook, home, CASE WHEN p > 0 THEN format('{{:,}}', p) || CASE p WHEN 1 THEN ' page' ELSE ' pages' END WHEN w > 0 THEN format('{{:,}}', w) || CASE w WHEN 1 THEN ' word' ELSE ' words' END END) AS subtitle FROM c""",
    "store_sql": f"WITH {PASSAGES_SQL} {_STORE_SQL.replace('chunks', 'passages').replace(':least', '40')}",
    "event_tail": """SELECT event_id AS number, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'info' END AS level, 'event ' || event_id AS message FROM events WHERE event_id % 5 < 3 ORDER BY event_id DESC LIMIT 400""",
    "retrieval_trace": _TRACED + f""" SELECT k.rank, k.chunk_id, round(k.effective, 6) AS effective, {S.preview("text", 180)} AS preview, (SELECT max(used_tokens) FROM picked)::BIGINT AS tokens_used, (SELECT count(*) FROM rrf)::BIGINT AS candidates, '' AS notes
        FROM picked k JOIN passages p ON k.chunk_id = p.chunk_id""",
}
