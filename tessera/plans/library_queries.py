"""Queries of ingestion, labels, dates and the smaller library operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels, records
from tessera.functions import sql as S
from tessera.functions.dates import parse_date
from tessera.operators import answers, ingest, listings, store
from tessera.plans import text_queries
from tessera.plans.views import SOURCES_SQL, documents, messages, pages, sources, table


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six ways, read back."""
    o = table(spark, sf_dir, "orders")
    day, n = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 6
    ways = ("yyyy-MM-dd'T'00:00:00'Z'", "yyyy/MM/dd", "MMMM d, yyyy", "EEE, dd MMM yyyy 00:00:00 +0000", "yyyyMMdd", "yyyy-MM-dd' at noon'")
    text = F.lit(None).cast("string")
    for i, w in enumerate(ways):
        text = F.when(n == i, F.date_format(day, w.replace("00:00:00", "HH:mm:ss").replace("EEE, ", "").replace("+0000", "'+0000'"))).otherwise(text)
    text = F.when(n == 3, F.concat(F.lit("Mon, "), text)).otherwise(text)
    return o.select("o_orderkey", F.to_date(parse_date(text, F.lit("2000-01-01").cast("timestamp"))).alias("day"))


def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("minutes", "hours", "days", "weeks", "months", "years")]), (F.col("event_id") % 6 + 1).cast("int"))
    text = F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit(" "), unit, F.lit(" ago"))
    return e.select("event_id", F.unix_seconds(parse_date(text, F.lit("2024-06-01 00:00:00").cast("timestamp"))).alias("seconds"))


def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 10 == 0, "bge-").otherwise("llama-3:"), (F.col("p_size") * 3).cast("string"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("b"))
    size = labels.parameter_size(name)
    window = labels.context_window(size)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), window.alias("window"), labels.is_embedding_model(name).alias("embeds"), labels.budget_for(window)["tokens"].alias("budget"), labels.budget_for(window)["results"].alias("results"))


def http_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.col("event_id") % 400 + 200).cast("int")
    return table(spark, sf_dir, "events").groupBy(labels.failure_of(status).alias("failure")).agg(F.count("*").alias("n"))


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted texts as sources: counts, checksums and failed rows for those under twenty characters."""
    texts = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("title"), "text")
    rows, _ = ingest.build(ingest.from_texts(texts), vectors=False)
    return rows.select(F.col("title").cast("long").alias("doc_id"), "status", "error", "bytes", "words", "checksum")


def discovery_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select((F.col("page_id") + 1).cast("int").alias("position"), "url")
    return answers.pick_results(found, None, 12).select("position", "url")


def discovery_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import replies

    found = pages(spark, sf_dir).select((F.col("page_id") + 1).cast("int").alias("position"), "url")
    picks = replies.choices("3 | a primary source\n5 - news\n999999999 | none\n3 | again\n8", 1000, 4)
    return answers.pick_results(found, picks, 4).select("position", "url", "reason")


def web_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results with short snippets, the first four enriched by their text."""
    p = pages(spark, sf_dir)
    results = p.select((F.col("page_id") + 1).cast("int").alias("position"), "url", F.lit("snippet").alias("snippet"), F.lit(None).cast("string").alias("content"))
    texts = p.groupBy("url").agg(F.min("html").alias("text"))
    return answers.enrich(results, texts).select("position", F.length("content").cast("long").alias("n_chars"))


def quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right answers by conversation: items joined with what was answered."""
    items = messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", (F.length("text") % 4).alias("right"))
    given = messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), (F.length("text") % 4).alias("said"))
    return items.join(given, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count_if(F.col("right") == F.col("said")).alias("score"), F.count("*").alias("items"))


def settings_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value rows upserted and read as one map."""
    old = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("string").alias("value"))
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit("region").alias("value")).unionByName(old.where("value = '3'").select("id", F.lit("changed").alias("value")))
    rows = store.upsert(old, new, "id", store.IMMUTABLE["settings"])
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("m"))
    return whole.select(F.explode("m").alias("name", "value"))


def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).groupBy("notebook").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return s.select("notebook", labels.plural(F.col("n"), "source").alias("sources"), (F.col("bytes") >= 1000).alias("large"), labels.byte_size(F.lit(1_500_000)).alias("sample"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    c = messages(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.select("conv_id", F.array_join(labels.follow_ups(k % 2 == 0, k % 4 == 0, F.col("last"), k % 3 == 0), "|").alias("suggestions"))


def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its blank lines collapsed, commas having been made ends of lines."""
    made = records.collapse_blank(F.regexp_replace("text", "[,.] ", " \n \n\n"))
    return documents(spark, sf_dir).select("doc_id", F.md5(made.cast("binary")).alias("text_md5"), F.length(made).cast("long").alias("n_chars"))


def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as they are read, some of their fields empty, null or unknown."""
    s = sources(spark, sf_dir)
    odd = s.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("title")).alias("title"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("site")).alias("site"), F.when(F.col("doc_id") % 5 == 0, "odd").otherwise(F.col("status")).alias("status"), F.when(F.col("doc_id") % 2 == 0, F.col("included")).alias("included"))
    return records.with_defaults(odd, "sources")


def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the last question and the last answer."""
    return listings.last_said(messages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (blank_runs, record_defaults, last_messages, date_parse, relative_dates, model_sizes, http_failures, ingest_rows, discovery_fallback, discovery_picks, web_enrichment, quiz_score, settings_map, byte_sizes, follow_ups)}

_N = "(p_size * 3)"
SQL = {
    "blank_runs": r"""WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '[,.] ', ' ' || chr(10) || ' ' || chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+$', '')), chr(10)) AS t FROM documents),
        c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM l) SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM c""",
    "record_defaults": f"""WITH {SOURCES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title ELSE 'Untitled source' END AS title, CASE WHEN doc_id % 4 <> 0 THEN site END AS site,
        CASE WHEN doc_id % 5 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN doc_id % 2 = 0 THEN included ELSE true END AS included FROM sources""",
    "last_messages": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_question, arg_max(text, turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id",
    "date_parse": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "relative_dates": "SELECT event_id, epoch(TIMESTAMP '2024-06-01 00:00:00')::BIGINT - (event_id % 9 + 1) * [60, 3600, 86400, 604800, 2592000, 31536000][event_id % 6 + 1] AS seconds FROM events",
    "model_sizes": f"""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN {_N} || 'B' END AS size, CASE WHEN p_partkey % 4 = 0 THEN 8192 WHEN {_N} <= 4 THEN 8192 WHEN {_N} <= 9 THEN 32768 WHEN {_N} <= 200 THEN 131072 ELSE 262144 END AS w FROM part)
        SELECT p_partkey, size, w::INT AS window, p_partkey % 10 = 0 AS embeds, CASE WHEN w < 16000 THEN 4000 WHEN w < 64000 THEN 10000 ELSE 24000 END::INT AS budget, CASE WHEN w < 16000 THEN 8 WHEN w < 64000 THEN 12 ELSE 18 END::INT AS results FROM m""",
    "http_failures": "SELECT CASE WHEN s < 300 THEN NULL WHEN s IN (401, 403) THEN 'invalid key' WHEN s = 413 THEN 'context too large' WHEN s = 429 THEN 'rate limited' WHEN s >= 500 THEN 'unavailable' ELSE 'rejected' END AS failure, count(*)::BIGINT AS n FROM (SELECT event_id % 400 + 200 AS s FROM events) GROUP BY 1",
    "ingest_rows": f"""SELECT doc_id, CASE WHEN t IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN t IS NULL THEN 'too short' END AS error, strlen(t)::BIGINT AS bytes, len({S.tokens("coalesce(t, '')")})::BIGINT AS words, sha256(t) AS checksum
        FROM (SELECT doc_id, CASE WHEN length(trim(text)) >= 20 THEN text END AS t FROM documents)""",
    "discovery_fallback": f"SELECT (p.page_id + 1)::INT AS position, url FROM pages p JOIN ({text_queries.SQL['navigation_penalty']}) n ON p.page_id = n.page_id ORDER BY penalty, p.page_id LIMIT 12",
    "web_enrichment": f"""WITH t AS (SELECT url, min(html) AS text FROM pages GROUP BY url), f AS (SELECT p.page_id, text FROM pages p JOIN t ON p.url = t.url WHERE p.page_id < 4)
        SELECT (p.page_id + 1)::INT AS position, CASE WHEN p.page_id >= 4 THEN NULL WHEN length(text) > 207 THEN length({S.preview("text", 3000)}) ELSE length('snippet') END::BIGINT AS n_chars FROM pages p LEFT JOIN f ON p.page_id = f.page_id""",
    "discovery_picks": "SELECT (page_id + 1)::INT AS position, url, CASE page_id + 1 WHEN 3 THEN 'a primary source' WHEN 5 THEN 'news' END AS reason FROM pages WHERE page_id + 1 IN (3, 5, 8)",
    "quiz_score": "SELECT q.conv_id, count(*) FILTER (length(q.text) % 4 = length(a.text) % 4)::BIGINT AS score, count(*)::BIGINT AS items FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' GROUP BY q.conv_id",
    "settings_map": "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_nationkey::VARCHAR END AS value FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) UNION ALL SELECT r_name, 'region' FROM region",
    "byte_sizes": f"WITH {SOURCES_SQL} SELECT notebook, format('{{:,}}', count(*)) || CASE WHEN count(*) = 1 THEN ' source' ELSE ' sources' END AS sources, sum(bytes) >= 1000 AS large, '1.5 MB' AS sample FROM sources GROUP BY notebook",
    "follow_ups": """WITH c AS (SELECT conv_id AS k, max(turn) AS last FROM conversations GROUP BY conv_id),
        a AS (SELECT k, list_filter([CASE WHEN k % 2 = 0 THEN 'What do my sources cover?' END, CASE WHEN k % 4 = 0 THEN 'Add a website source' END, CASE WHEN k % 2 = 1 AND last > 0 THEN 'Summarise the sources behind that answer' END,
          CASE WHEN k % 2 = 1 AND last > 0 THEN 'What do the sources disagree about?' END, CASE WHEN k % 3 = 0 THEN 'Continue that answer in more detail' END], lambda x: x IS NOT NULL) AS s FROM c)
        SELECT k AS conv_id, array_to_string(CASE WHEN len(s) = 0 THEN ['What are the key points across my sources?'] ELSE s[1:3] END, '|') AS suggestions FROM a""",
}
