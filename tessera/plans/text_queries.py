"""Queries of the text, URL, hash and vector functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import sql as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.vectors import cosine, fnv1a_hex, norm, normalized
from tessera.plans.views import documents, messages, pages, table

QUERY_VECTOR_ID = 7


def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.content(T.tokens(F.col("text"))).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_terms"), F.md5(F.array_join("words", " ").cast("binary")).alias("terms_md5"))


def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences are counted by word before they are stemmed, so each word is stemmed once."""
    words = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(T.stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_words"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), F.length("text").cast("long").alias("n_chars"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, its full stops and commas turned into marks, without markup."""
    made = F.translate(F.concat(F.lit("**"), "source", F.lit("** [link](https://a.example/"), "lang", F.lit(") ~~"), "lang", F.lit("~~ "), "text"), ".,", "*`")
    return documents(spark, sf_dir).select("doc_id", T.strip_markup(made).alias("plain"))


def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.octet_length("text").cast("long").alias("bytes"))


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", fnv1a_hex("word").alias("fnv"))


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))


def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address key, by page_id: a partial minimum, no window over all pages."""
    keyed = pages(spark, sf_dir).select(U.dedupe_key(F.col("url")).alias("key"), "page_id")
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))


def navigation_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.navigation_penalty(F.col("url")).alias("penalty"))


def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as addresses of machines."""
    ids = table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array(*[(F.floor(F.col("c_custkey") * k) % m).cast("string") for k, m in ((7, 200), (13, 300), (3, 256), (1, 256))]), ".").alias("ip"))
    return ids.select("c_custkey", "ip", U.is_private(F.concat(F.lit("http://"), "ip", F.lit(":8080/v1"))).alias("is_private"))


def unwrap_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("//search.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=x"))
    return pages(spark, sf_dir).select("page_id", U.unwrap_redirect(wrapped).alias("target"), U.unwrap_redirect(F.lit("//a.example/b")).alias("plain"))


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    unit = norm(normalized(F.col("embedding")))
    return e.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(unit, 6).alias("unit_norm"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to one of them, an exact scan with a bounded top list."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.where(F.col("vec_id") == QUERY_VECTOR_ID).select(F.col("embedding").alias("q")).limit(1)
    scored = e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "vec_id").limit(10)


def access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in gates, client-rendered pages and script share of raw pages."""
    low = F.lower("html")
    gate = F.lit(None).cast("string")
    for needle, says in reversed(L.ACCESS_GATES):
        gate = F.when(F.contains(low, F.lit(needle)), F.lit(says)).otherwise(gate)
    framework = F.exists(T.strings(L.FRAMEWORK_MARKS), lambda m: F.contains(low, m))
    words = F.size(T.tokens(F.regexp_replace("html", "<[^>]+>", " ")))
    script = F.length("html") - F.length(F.substring_index("html", "<script", 1)) - F.lit(len("<script")) * (F.size(F.split("html", "<script")) - 1)
    client = F.when(framework, words < 120).otherwise((script > F.floor(F.length("html") / 2)) & (F.length("html") > 2000))
    return pages(spark, sf_dir).select("page_id", gate.alias("gate"), client.alias("client_rendered"))


def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = messages(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.session_title(F.col("text")).alias("title"))


QUERIES = {f.__name__: f for f in (tokens_count, stopword_filter, stem_vocab, token_estimate, preview, strip_markdown, sha256, fnv_hash, url_host, url_dedupe, navigation_penalty, private_hosts, unwrap_redirect, embedding_norms, cosine_topk, access_gate, session_titles)}

_HOST = r"lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_MADE = "translate('**' || source || '** [link](https://a.example/' || lang || ') ~~' || lang || '~~ ' || text, '.,', '*`')"
_SCRIPT = "(length(html) - length(string_split(html, '<script')[1]) - 7 * (len(string_split(html, '<script')) - 1))"
_VOCABULARY = f"words AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS word FROM documents) GROUP BY word)"
_THIN = " OR ".join(f"contains(p, {S.text(t)})" for t in L.THIN_PATHS)

#: The pages with the keys of their addresses.
KEYED = rf"""WITH parts AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '^http$', 'https') AS s, {_HOST} AS h, {_PATH} AS p,
          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:[0-9]+)(?:[/?#]|$)', 1) AS port,
          array_to_string(list_filter(string_split({_QUERY}, '&'), lambda q: q <> '' AND NOT list_contains({S.texts(L.TRACKING_PARAMETERS)}, lower(string_split(q, '=')[1]))), '&') AS q FROM pages),
        keyed AS (SELECT page_id, coalesce(s || '://' || regexp_replace(h, '^www\.', '') || port || CASE WHEN length(p) > 1 THEN regexp_replace(p, '(.)/+$', '\1') ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END, lower(trim(url))) AS key FROM parts)"""
SQL = {
    "tokens_count": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS w FROM documents)",
    "stopword_filter": f"SELECT doc_id, len(w)::BIGINT AS n_terms, md5(array_to_string(w, ' ')) AS terms_md5 FROM (SELECT doc_id, {S.content(S.tokens('text'))} AS w FROM documents)",
    "stem_vocab": f"WITH {_VOCABULARY} SELECT {S.stems('[word]')}[1] AS stem, sum(n)::BIGINT AS n_tokens, count(*)::BIGINT AS n_words FROM words GROUP BY 1",
    "token_estimate": f"SELECT doc_id, {S.token_estimate('text')} AS estimate, length(text)::BIGINT AS n_chars FROM documents",
    "preview": f"SELECT doc_id, {S.preview('text')} AS preview FROM documents",
    "strip_markdown": rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MADE}, '\[([^\]]*)\]\(([^)]*)\)', '\1 (\2)', 'g'),
        '[*_]{{1,3}}([^*_]+)[*_]{{1,3}}', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '~~([^~]+)~~', '\1', 'g') AS plain FROM documents""",
    "sha256": "SELECT doc_id, sha256(text) AS checksum, strlen(text)::BIGINT AS bytes FROM documents",
    "fnv_hash": f"""WITH {_VOCABULARY}, bytes AS (SELECT word, n, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2*i+1, 2))::HUGEINT) AS b FROM words)
        SELECT word, n::BIGINT AS n, lower(lpad(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS fnv FROM bytes""",
    "url_host": f"SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages",
    "url_dedupe": f"{KEYED} SELECT key, min(page_id) AS page_id, count(*)::BIGINT AS n_pages FROM keyed GROUP BY key",
    "navigation_penalty": f"SELECT page_id, (CASE WHEN h IS NULL THEN 1 WHEN q <> '' THEN 3 WHEN {_THIN} OR p IN ('', '/') THEN 2 ELSE 0 END)::INT AS penalty FROM (SELECT page_id, {_HOST} AS h, lower({_PATH}) AS p, {_QUERY} AS q FROM pages)",
    "private_hosts": """WITH o AS (SELECT c_custkey, (c_custkey*7)%200 AS a, (c_custkey*13)%300 AS b, (c_custkey*3)%256 AS c, c_custkey%256 AS d FROM customer)
        SELECT c_custkey, a||'.'||b||'.'||c||'.'||d AS ip, a||'.'||b||'.'||c||'.'||d IN ('127.0.0.1', '0.0.0.0') OR (a <= 255 AND b <= 255 AND (a = 10 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254))) AS is_private FROM o""",
    "unwrap_redirect": "SELECT page_id, url AS target, 'https://a.example/b' AS plain FROM pages",
    "embedding_norms": "SELECT vec_id, len(embedding)::BIGINT AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS unit_norm FROM embeddings",
    "cosine_topk": f"""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID} LIMIT 1),
        s AS (SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 6) AS score FROM embeddings, q)
        SELECT vec_id, score FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10""",
    "access_gate": f"""SELECT page_id, CASE {" ".join(f"WHEN contains(lower(html), {S.text(n)}) THEN {S.text(d)}" for n, d in L.ACCESS_GATES)} END AS gate,
        CASE WHEN {" OR ".join(f"contains(lower(html), {S.text(m)})" for m in L.FRAMEWORK_MARKS)} THEN len({S.tokens("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) < 120
             ELSE {_SCRIPT} > length(html) // 2 AND length(html) > 2000 END AS client_rendered FROM pages""",
    "session_titles": r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
        t AS (SELECT conv_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:7], ' ') AS t FROM f)
        SELECT conv_id, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS title FROM t""",
}
