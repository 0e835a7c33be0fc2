"""Queries of the parsers and of what runs in Arrow batches; those that SQL can express have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import sql as S
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import embedding, passages, replies
from tessera.plans.views import documents, lines, messages, pages, table
from tessera.sources import archive, html, robots

ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/12\nDisallow: /*9$\nAllow: /en\nUser-agent: other\nDisallow: /\n"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = passages.with_sentences(documents(spark, sf_dir))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).cast("long").alias("longest"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = passages.with_blocks(documents(spark, sf_dir))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "table").alias("n_tables"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.with_passages(documents(spark, sf_dir)).select("doc_id", "ordinal", "token_count", F.sha2("text", 256).alias("text_sha256"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.with_pages(pages(spark, sf_dir))
    return made.select("page_id", "problem", F.size("blocks").cast("long").alias("n_blocks"), F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").cast("binary")).alias("text_md5"))


def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_pages(pages(spark, sf_dir)).select("page_id", *html.META_FIELDS)


def builtin_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding.with_vectors(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", F.size("vector").cast("long").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("square"))


def embedding_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hashed features: how many buckets are filled, and a digest of all of them in whole hundredths."""
    made = documents(spark, sf_dir).select("doc_id", embedding.feature_sums(F.col("text")).alias("v"))
    filled = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    text = F.array_join(F.transform(filled, lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("string"))), ",")
    return made.select("doc_id", F.size(filled).cast("long").alias("buckets"), F.md5(text.cast("binary")).alias("sums_md5"))


def embedding_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector written as a line of JSON and read back from it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))
    back = archive.json_lines(e).select(F.from_json("value", e.schema).alias("r")).select("r.*")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("chunk_id", "model", F.col("dimensions").cast("long").alias("dimensions"), F.round(total, 4).alias("total"))


def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards out of made replies: user turns as questions, the next answers as answers."""
    said = messages(spark, sf_dir).where("role <> 'system'").withColumn("line", F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.translate("text", "\n", " ")))
    text = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("all")).select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))
    return replies.with_flashcards(text, "conv_id", "text").select("conv_id", "ordinal", "front", "back")


def quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made quiz items for each benchmark text, all of them read."""
    w = F.split(F.translate("text", "\n", " "), " ")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("none"))
    text = F.concat(F.lit("1. What of "), at(0), F.lit("?\nA. "), at(1), F.lit("\nB. "), at(2), F.lit("\nAnswer: B\nWhy: "), at(3), F.lit(" [Source 1]\n2. Which is "), at(0), F.lit("?\nA) first\nB) second\nC) third\nAnswer: 3\nWhy: see [Web 2]"))
    made = table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))
    return replies.with_quiz(made, "item_id", "text").select("item_id", "ordinal", "question", F.size("choices").cast("long").alias("n_choices"), F.col("answer").cast("int").alias("answer"), "marker")


def rerank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("1: "), (F.col("item_id") % 13).cast("string"), F.lit("\nnonsense\n[2]: 4.5\n9: 3"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(replies.rerank_scores(reply, 4), lambda x: F.round(x, 3).cast("string")), " ").alias("scores"))


def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = pages(spark, sf_dir).select(F.col("page_id").alias("id"), F.lit("*").alias("origin"), U.path(F.col("url")).alias("path"))
    rules = spark.createDataFrame([("*", r, a, robots.pattern(r)) for r, a in robots.parse(ROBOTS)], "origin string, rule string, allow boolean, regex string")
    return robots.decide(paths, rules).select(F.col("id").alias("page_id"), "allowed", "rule")


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation exported, loaded and given new ids: rows by role."""
    said = messages(spark, sf_dir)
    tables = {
        "sessions": said.select(F.col("conv_id").alias("id")).distinct(),
        "messages": said.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), "role", "text"),
    }
    back = archive.remap(archive.load(archive.export(tables, "Conversations"), {n: df.schema for n, df in tables.items()}), "import")
    joined = back["messages"].join(back["sessions"].withColumnRenamed("id", "session_id"), "session_id")
    return joined.groupBy("role").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksums"), F.countDistinct("session_id").alias("n_sessions"))


def first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of lines that begin alike, in each source: a partial minimum by key."""
    key = F.lower(F.left("text", F.lit(160)))
    return lines(spark, sf_dir).groupBy("source", key.alias("key")).agg(F.min(F.struct("doc_id", "ordinal")).alias("m")).select("source", "m.doc_id", F.col("m.ordinal").cast("long").alias("ordinal"))


def retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position scores of search results and their merged snippet, as web results give them."""
    p = pages(spark, sf_dir)
    text = F.regexp_replace("html", "<[^>]+>", " ")
    return p.select("page_id", F.round(T.position_score(F.col("page_id") % 10), 6).alias("score"), T.preview(text, 120).alias("snippet"))


QUERIES = {f.__name__: f for f in (sentences, markdown_blocks, chunks, html_extract, html_metadata, builtin_embedding, embedding_sums, embedding_jsonl, flashcards, quiz, rerank_parse, robots_decision, archive_roundtrip, first_blocks, retrieval_text)}

_RULES = [(r, a, robots.pattern(r)) for r, a in robots.parse(ROBOTS)]
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_W = "coalesce(string_split(translate(text, chr(10), ' '), ' ')[{}], 'none')"



def _neat(x: str) -> str:
    return S.squeeze(f"regexp_replace(regexp_replace({x}, '^[*_]{{1,3}}', ''), '[*_]{{1,3}}$', '')")


_STEMS = f"list_filter({S.stems(S.content(S.tokens('text')))}, lambda s: length(s) >= 2)"
# FNV-1a over the UTF-8 bytes of a feature's name, modulo 2^64.
_FNV = "list_reduce(list_transform(range(0, length(hex(encode(name))) // 2), lambda i: ('0x' || substr(hex(encode(name)), (2 * i + 1)::INT, 2))::INT::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, to in pairs:
        x = f"regexp_replace({x}, {S.text(pattern)}, {S.text(to)}, 'g')"
    return x


_UNMARKED = ((r"\[([^\]]*)\]\(([^)]*)\)", r"\1 (\2)"), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1"), (r"`([^`]+)`", r"\1"), (r"~~([^~]+)~~", r"\1"))
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CUT = lambda x: _replaced(x, (f"^{_SPACE}+|{_SPACE}+$", ""))
_ITEM = r"(?:[-*+•] |\d{1,3}[.)])(.*)"
#: A document's lines with their kinds; lines of code and fences apart. ``part`` is a run of lines of one kind.
_LINES = f"""raws AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS i FROM documents),
cut AS (SELECT *, {_CUT("raw")} AS line FROM raws),
fences AS (SELECT *, left(line, 3) IN ('```', '~~~') AS fence, sum((left(line, 3) IN ('```', '~~~'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS opened FROM cut),
kinds AS (SELECT *, CASE WHEN fence OR line = '' THEN 'blank' WHEN regexp_full_match(line, '#{{1,6}} +.*') AND trim(regexp_extract(line, '^#{{1,6}} +(.*)$', 1), '# ') <> '' THEN 'heading'
    WHEN length(line) > 2 AND left(line, 1) = '|' AND right(line, 1) = '|' THEN 'table' WHEN left(line, 1) = '>' THEN 'quote'
    WHEN regexp_full_match(line, '{_ITEM}') AND {_CUT(f"regexp_extract(line, '^{_ITEM}$', 1)")} <> '' THEN 'list_item' ELSE 'paragraph' END AS kind FROM fences WHERE fence OR opened % 2 = 0),
parts AS (SELECT *, sum((kind IN ('heading', 'quote') OR kind IS DISTINCT FROM before)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part
    FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM kinds))"""
_MARKDOWN = f"""WITH {_LINES},
runs AS (SELECT doc_id, kind, part, CASE kind WHEN 'heading' THEN 1 WHEN 'blank' THEN 0
    WHEN 'paragraph' THEN (length({_CUT("string_agg(" + _replaced("line", *_UNMARKED) + ", ' ' ORDER BY i)")}) >= 2)::INT
    WHEN 'list_item' THEN count(*) FILTER (length({_replaced(_CUT(f"regexp_extract(line, '^{_ITEM}$', 1)"), *_UNMARKED)}) >= 2)
    WHEN 'quote' THEN count(*) FILTER (length({_CUT("ltrim(line, '>')")}) >= 2)
    ELSE (count(*) >= 2 AND count(*) FILTER (NOT regexp_full_match(line, '[|:\\- ]*')) > 0)::INT END AS blocks FROM parts GROUP BY doc_id, kind, part),
code AS (SELECT doc_id, 'code' AS kind, opened AS part, (length(string_agg(rtrim(raw), chr(10) ORDER BY i)) > 8 OR opened = whole)::INT AS blocks
    FROM (SELECT *, max(opened) OVER (PARTITION BY doc_id) AS whole FROM fences) WHERE NOT fence AND opened % 2 = 1 GROUP BY doc_id, opened, whole)
SELECT doc_id, sum(blocks)::BIGINT AS n_blocks, (count(*) FILTER (kind = 'table' AND blocks > 0))::BIGINT AS n_tables FROM (SELECT * FROM runs UNION ALL SELECT * FROM code) GROUP BY doc_id HAVING sum(blocks) > 0"""
#: Pieces that stops with white space after them cut; those that end in an abbreviation or initial go on in the next.
_SENTENCES = f"""WITH marked AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?。！？]+["''”’)\\]】」]*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents),
pieces AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM marked),
ends AS (SELECT *, NOT regexp_matches(p, '[.]["''”’)\\]】」]*$') OR NOT (length(w) = 1 AND regexp_matches(w, '^\\p{{Lu}}$') OR list_contains({S.texts(sorted(L.ABBREVIATIONS))}, lower(w))) AS done
    FROM (SELECT *, replace(regexp_extract(p, '([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}.]*)[.]["''”’)\\]】」]*$', 1), '.', '') AS w FROM pieces)),
joined AS (SELECT doc_id, {_CUT("string_agg(p, '' ORDER BY i)")} AS s FROM (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ends) GROUP BY doc_id, g)
SELECT doc_id, count(*)::BIGINT AS n_sentences, max(length(s))::BIGINT AS longest FROM joined WHERE s <> '' GROUP BY doc_id"""

SQL = {
    "sentences": _SENTENCES,
    "markdown_blocks": _MARKDOWN,
    "embedding_sums": f"""WITH t AS (SELECT doc_id, {_STEMS} AS ws FROM documents),
        f AS (SELECT doc_id, 'w:' || s AS name, 100 AS weight FROM (SELECT doc_id, unnest(ws) AS s FROM t)
          UNION ALL SELECT doc_id, 'c:' || unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i::INT, 4))), 28 FROM (SELECT doc_id, unnest(ws) AS s FROM t)
          UNION ALL SELECT doc_id, 'b:' || unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])), 65 FROM t),
        n AS (SELECT name, {_FNV} AS h FROM (SELECT DISTINCT name FROM f)),
        b AS (SELECT doc_id, (h % 384)::INT AS i, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -weight ELSE weight END)::BIGINT AS x FROM f JOIN n USING (name) GROUP BY ALL)
        SELECT d.doc_id, count(x) AS buckets, md5(coalesce(string_agg(i || ':' || x, ',' ORDER BY i), '')) AS sums_md5 FROM documents d LEFT JOIN (SELECT * FROM b WHERE x <> 0) b ON d.doc_id = b.doc_id GROUP BY d.doc_id""",
    "embedding_jsonl": "SELECT vec_id AS chunk_id, 'm' AS model, len(embedding)::BIGINT AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings",
    "flashcards": f"""WITH m AS (SELECT conv_id, turn, role, trim(translate(text, chr(10), ' ')) AS t, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS card FROM conversations WHERE role <> 'system'),
        c AS (SELECT conv_id, card, arg_min(t, turn) FILTER (role = 'user') AS f, arg_max(t, turn) FILTER (role <> 'user') AS b FROM m WHERE card > 0 GROUP BY conv_id, card)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY card) - 1 AS ordinal, {_neat("f")} AS front, {_neat("b")} AS back FROM c WHERE f <> '' AND b <> ''""",
    "quiz": f"""SELECT item_id, 0::BIGINT AS ordinal, 'What of ' || {_W.format(1)} || '?' AS question, 2::BIGINT AS n_choices, 1::INT AS answer, '[Source 1]' AS marker FROM benchmark
        UNION ALL SELECT item_id, 1, 'Which is ' || {_W.format(1)} || '?', 3, 2, '[Web 2]' FROM benchmark""",
    "rerank_parse": "SELECT item_id, least(10.0, item_id % 13)::DOUBLE / 10 || ' 0.45 0.0 0.0' AS scores FROM benchmark",
    "robots_decision": f"""WITH r(rule, allow, regex) AS (VALUES {", ".join(f"({S.text(r)}, {a}, {S.text(x)})" for r, a, x in _RULES)}),
        h AS (SELECT page_id, rule, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, allow DESC, rule DESC) AS n FROM (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM pages) JOIN r ON regexp_matches(p, regex))
        SELECT p.page_id, coalesce(allow, true) AS allowed, rule FROM pages p LEFT JOIN h ON p.page_id = h.page_id AND n = 1""",
    "archive_roundtrip": "SELECT role, count(*)::BIGINT AS n_messages, sum(length(text))::BIGINT AS n_chars, sum(('0x' || left(md5(text), 8))::BIGINT)::BIGINT AS checksums, count(DISTINCT conv_id)::BIGINT AS n_sessions FROM conversations GROUP BY role",
    "first_blocks": """WITH l AS (SELECT doc_id, source, i - 1 AS ordinal, string_split(text, chr(10))[i] AS t FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
        SELECT source, doc_id, ordinal::BIGINT AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(left(t, 160)) ORDER BY doc_id, ordinal) AS n FROM l WHERE trim(t) <> '') WHERE n = 1""",
    "retrieval_text": f"SELECT page_id, round(greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.06::DOUBLE * (page_id % 10)), 6) AS score, {S.preview('plain', 120)} AS snippet FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages)",
}
SQL["builtin_embedding"] = f"SELECT doc_id, 384::BIGINT AS dims, CASE WHEN buckets > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS square FROM ({SQL['embedding_sums']})"
