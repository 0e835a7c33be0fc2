"""Queries of the store, its listings and the conversation functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import sql as S
from tessera.functions import text as T
from tessera.operators import listings, store
from tessera.plans import text_queries
from tessera.plans.views import SOURCES_SQL, documents, lines, messages, pages, sources, table

PHRASE = "the and"


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passages of a notebook by source, then place."""
    french = lines(spark, sf_dir).join(documents(spark, sf_dir).where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi")
    return french.orderBy("doc_id", "ordinal").limit(200).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), T.preview(F.col("text"), 60).alias("preview"))


def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in each of the listing's filters, with a text contained in title, address or notes."""
    s = sources(spark, sf_dir).withColumns({"url": F.concat(F.lit("https://"), "site", F.lit(".example/THE and")), "notes": F.when(F.col("doc_id") % 3 == 0, F.upper(F.lit(PHRASE))), "id": F.col("doc_id")})
    s = s.withColumn("url", F.when(F.col("doc_id") % 5 == 0, F.col("url"))).withColumn("status", F.when(F.col("doc_id") % 11 == 0, F.lit("chunking")).otherwise(F.col("status")))
    flags = [F.when(listings.source_filter(name), F.lit(name)) for name in ("all", "ready", "issues", "excluded")]
    return s.where(listings.contains_any(PHRASE, "title", "url", "notes")).select("doc_id", F.array_join(F.array_compact(F.array(*flags)), ",").alias("filters"))


def source_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, largest first: a range-partitioned sort."""
    return listings.sort_sources(sources(spark, sf_dir), "size").select("doc_id", "bytes", "chunk_count")


def recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an item, opened or else updated, latest first."""
    o = table(spark, sf_dir, "orders")
    opened = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))
    items = o.select("o_orderkey", opened.alias("last_opened_at"), F.date_sub("o_orderdate", 30).alias("updated_at"))
    return listings.recents(items, "o_orderkey").select("o_orderkey", F.col("used_at").cast("date").alias("used_at"))


def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all tables in one row."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    s = sources(spark, sf_dir)
    head = s.agg(F.countDistinct("notebook").alias("notebooks"), F.count("*").alias("sources"), F.sum("bytes").alias("bytes"), F.sum("chunk_count").alias("chunks"), F.count_if("included").alias("included"))
    m = messages(spark, sf_dir).agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"))
    return head.crossJoin(m).crossJoin(count(table(spark, sf_dir, "embeddings"), "embeddings"))


def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("model-"), (F.col("label") % 3).cast("string"))
    return table(spark, sf_dir, "embeddings").select(model.alias("model"), F.size("embedding").cast("long").alias("dims")).distinct()


def header_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    return s.groupBy("notebook").agg(F.sum("bytes").alias("bytes"), F.sum("chunk_count").alias("chunks"), F.sum("words").alias("words"), F.count_if(F.col("status") == "failed").alias("failed"))


def palette_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks, sources and notes under one query, best forty."""
    s = sources(spark, sf_dir)
    books = s.groupBy("notebook").count().select(F.concat(F.lit("nb-"), "notebook").alias("id"), T.match_score(F.col("notebook"), PHRASE, 100).alias("score"))
    files = s.select(F.concat(F.lit("src-"), F.col("doc_id").cast("string")).alias("id"), T.match_score(F.concat("title", F.lit(" "), "site"), PHRASE, 70).alias("score"))
    notes = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("note-"), F.col("item_id").cast("string")).alias("id"), T.match_score(F.col("text"), PHRASE, 60).alias("score"))
    return books.union(files).union(notes).where("score > 0").orderBy(F.desc("score"), "id").limit(40)


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sources(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("notebook").alias("notebook_id"), F.lit("file").alias("kind"), "title", "bytes", F.col("doc_id").alias("added_at"))
    return s, s.where("id % 7 = 0").select("id", F.lit("moved").alias("notebook_id"), F.lit("web").alias("kind"), F.concat(F.lit("> "), "title").alias("title"), (F.col("bytes") + 1).alias("bytes"), F.lit(-1).cast("long").alias("added_at"))


def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rows put in, immutable columns kept; and rows that are new."""
    old, changed = _library(spark, sf_dir)
    more = changed.withColumn("id", F.col("id") + 1_000_000_000)
    return store.upsert(old, changed.unionByName(more), "id", store.IMMUTABLE["sources"])


def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every fifth document replaced by one each; those of every tenth by none."""
    rows = lines(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.length("text").cast("long").alias("n_chars"))
    parents = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("doc_id").alias("source_id"))
    new = parents.where("source_id % 10 <> 0").select(F.concat_ws(":", F.col("source_id"), F.lit("new")).alias("chunk_id"), "source_id", F.lit(0).cast("long").alias("n_chars"))
    out = store.replace_children(rows, new, parents, "source_id", "chunk_id")
    return out.groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each table once a notebook is deleted."""
    s = sources(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("notebook").alias("notebook_id"))
    chunks = lines(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "ordinal").join(s.select(F.col("id").alias("source_id"), "notebook_id"), "source_id")
    tables = {"notebooks": s.select(F.col("notebook_id").alias("id")).distinct(), "sources": s, "chunks": chunks}
    left = store.delete_cascade(tables, "notebooks", spark.createDataFrame([("de",)], "id string"))
    return left["notebooks"].agg(F.count("*").alias("notebooks")).crossJoin(left["sources"].agg(F.count("*").alias("sources"))).crossJoin(left["chunks"].agg(F.count("*").alias("chunks")))


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document, and documents' numbers without a vector."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    a = store.orphans(table(spark, sf_dir, "labels"), docs, "doc_id").agg(F.count("*").alias("labels_without_document"))
    b = store.orphans(docs, table(spark, sf_dir, "embeddings"), "id", "vec_id").agg(F.count("*").alias("documents_without_vector"))
    return a.crossJoin(b)


def messages_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the messages after the first answer: a group's minimum joined back."""
    m = messages(spark, sf_dir)
    first = m.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("answered"))
    return m.join(first, "conv_id").where("turn > answered").select("conv_id", "turn", "role")


def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a search query, short or pronoun-heavy ones with words of the user turn before."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    asked = messages(spark, sf_dir).where("role = 'user'").withColumn("previous", F.lag("text").over(before))
    words = T.tokens(F.trim("text"))
    heavy = (F.size(words) <= 6) | F.exists(words, lambda w: w.isin(*L.PRONOUNS))
    last = F.filter(T.tokens(F.col("previous")), lambda w: (F.length(w) > 3) & ~w.isin(*L.STOP_WORDS))
    tail = F.array_join(F.slice(last, F.greatest(F.lit(1), F.size(last) - 5), F.lit(6)), " ")
    rewritten = F.when(heavy & F.col("previous").isNotNull() & (tail != ""), F.concat(F.trim("text"), F.lit(" "), tail)).otherwise(F.trim("text"))
    return asked.select("conv_id", "turn", rewritten.alias("query"))


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four user and assistant turns, oldest first, by a bounded top list for each conversation."""
    said = messages(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    line = F.concat(F.initcap("role"), F.lit(": "), T.preview(F.col("text"), 80))
    ranked = said.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 4")
    kept = ranked.select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    return kept.select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("summary"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("turn", F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text").alias("body"))
    kept = messages(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("all"))
    return kept.select("conv_id", F.md5(F.array_join(F.transform("all", lambda x: x["body"]), "\n\n").cast("binary")).alias("transcript_md5"), F.size("all").cast("long").alias("n_turns"))


def plausible_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer looks like a query for the question before it."""
    m = messages(spark, sf_dir).withColumn("asked", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and asked is not null")
    low = F.lower("text")
    refused = F.exists(T.strings(L.REFUSALS), lambda r: F.contains(low, r))
    fits = (F.length("text") > 0) & (F.length("text") <= F.greatest(F.lit(80), F.length("asked") * 3)) & ~F.contains("text", F.lit("\n"))
    return m.select("conv_id", "turn", (fits & ~refused).alias("plausible"))


def fallback_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen pages to read where no model chose: least navigation penalty, then position."""
    from tessera.functions.urls import navigation_penalty

    p = pages(spark, sf_dir).select("page_id", navigation_penalty(F.col("url")).alias("penalty"), F.round(T.position_score(F.col("page_id")), 6).alias("score"))
    return p.orderBy("penalty", "page_id").limit(15)


QUERIES = {f.__name__: f for f in (reading_order, source_filter, source_sort, recents, library_stats, distinct_models, header_totals, palette_search, upsert_sources, replace_chunks, cascade_delete, orphan_check, messages_after, query_rewrite, history_summary, transcript, plausible_query, fallback_ranking)}

_LINES = "lines AS (SELECT doc_id, source, i - 1 AS ordinal, l[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(l[i]) <> '')"


def _match(hay: str, base: int) -> str:
    words = " AND ".join(f"contains(lower({hay}), '{w}')" for w in PHRASE.split())
    return f"CASE WHEN starts_with(lower({hay}), '{PHRASE}') THEN {base + 60} WHEN contains(lower({hay}), ' {PHRASE}') THEN {base + 40} WHEN contains(lower({hay}), '{PHRASE}') THEN {base + 25} WHEN {words} THEN {base + 10} ELSE 0 END"


_ROLE = "upper(left(role, 1)) || lower(substr(role, 2))"
_PENALTY = text_queries.SQL["navigation_penalty"]

SQL = {
    "reading_order": f"WITH {_LINES} SELECT l.doc_id, ordinal::BIGINT AS ordinal, {S.preview('l.text', 60)} AS preview FROM lines l JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'fr' ORDER BY l.doc_id, ordinal LIMIT 200",
    "source_filter": f"""WITH {SOURCES_SQL}, s AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN 'chunking' ELSE status END AS status) FROM sources)
        SELECT doc_id, array_to_string(list_filter(['all', CASE WHEN status IN ('ready', 'partial') THEN 'ready' END, CASE WHEN status IN ('failed', 'partial', 'chunking') THEN 'issues' END, CASE WHEN NOT included THEN 'excluded' END], lambda x: x IS NOT NULL), ',') AS filters
        FROM s WHERE contains(lower(title), '{PHRASE}') OR doc_id % 5 = 0 OR doc_id % 3 = 0""",
    "source_sort": f"WITH {SOURCES_SQL} SELECT doc_id, bytes, chunk_count FROM sources ORDER BY bytes DESC, doc_id",
    "recents": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate - INTERVAL 30 DAY END AS DATE) AS used_at FROM orders ORDER BY used_at DESC, o_orderkey",
    "library_stats": f"""WITH {SOURCES_SQL} SELECT count(DISTINCT notebook)::BIGINT AS notebooks, count(*)::BIGINT AS sources, sum(bytes)::BIGINT AS bytes, sum(chunk_count)::BIGINT AS chunks, count(*) FILTER (included)::BIGINT AS included,
        (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS sessions, (SELECT count(*) FROM conversations)::BIGINT AS messages, (SELECT count(*) FROM embeddings)::BIGINT AS embeddings FROM sources""",
    "distinct_models": "SELECT DISTINCT 'model-' || (label % 3) AS model, len(embedding)::BIGINT AS dims FROM embeddings",
    "header_totals": f"WITH {SOURCES_SQL} SELECT notebook, sum(bytes)::BIGINT AS bytes, sum(chunk_count)::BIGINT AS chunks, sum(words)::BIGINT AS words, count(*) FILTER (status = 'failed')::BIGINT AS failed FROM sources GROUP BY notebook",
    "palette_search": f"""WITH {SOURCES_SQL}, a AS (SELECT DISTINCT 'nb-' || notebook AS id, {_match("notebook", 100)} AS score FROM sources UNION ALL SELECT 'src-' || doc_id, {_match("title || ' ' || site", 70)} FROM sources UNION ALL SELECT 'note-' || item_id, {_match("text", 60)} FROM benchmark)
        SELECT id, score::INT AS score FROM a WHERE score > 0 ORDER BY score DESC, id LIMIT 40""",
    "upsert_sources": f"""WITH {SOURCES_SQL}, o AS (SELECT doc_id AS id, notebook AS notebook_id, 'file' AS kind, title, bytes, doc_id AS added_at FROM sources)
        SELECT id, notebook_id, kind, CASE WHEN id % 7 = 0 THEN '> ' || title ELSE title END AS title, CASE WHEN id % 7 = 0 THEN bytes + 1 ELSE bytes END AS bytes, added_at FROM o
        UNION ALL SELECT id + 1000000000, 'moved', 'web', '> ' || title, bytes + 1, -1 FROM o WHERE id % 7 = 0""",
    "replace_chunks": f"WITH {_LINES}, kept AS (SELECT doc_id, length(text) AS n FROM lines WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0) SELECT doc_id AS source_id, count(*)::BIGINT AS n_chunks, sum(n)::BIGINT AS n_chars FROM kept GROUP BY doc_id",
    "cascade_delete": f"WITH {_LINES} SELECT (SELECT count(DISTINCT lang) FROM documents WHERE lang <> 'de')::BIGINT AS notebooks, (SELECT count(*) FROM documents WHERE lang <> 'de')::BIGINT AS sources, (SELECT count(*) FROM lines l JOIN documents d ON l.doc_id = d.doc_id WHERE lang <> 'de')::BIGINT AS chunks",
    "orphan_check": "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT AS labels_without_document, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))::BIGINT AS documents_without_vector",
    "messages_after": "SELECT c.conv_id, turn, role FROM conversations c JOIN (SELECT conv_id, min(turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id) f ON c.conv_id = f.conv_id AND turn > a",
    "query_rewrite": f"""WITH u AS (SELECT conv_id, turn, trim(text) AS t, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user'),
        w AS (SELECT *, {S.tokens("t")} AS w, list_filter({S.tokens("p")}, lambda x: length(x) > 3 AND NOT list_contains({S.texts(L.STOP_WORDS)}, x)) AS b FROM u),
        h AS (SELECT *, len(w) <= 6 OR len(list_filter(w, lambda x: list_contains({S.texts(L.PRONOUNS)}, x))) > 0 AS heavy, array_to_string(b[greatest(1, len(b) - 5):len(b)], ' ') AS tail FROM w)
        SELECT conv_id, turn, CASE WHEN heavy AND p IS NOT NULL AND tail <> '' THEN t || ' ' || tail ELSE t END AS query FROM h""",
    "history_summary": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id, string_agg({_ROLE} || ': ' || {S.preview("text", 80)}, chr(10) ORDER BY turn) AS summary FROM r WHERE b <= 4 GROUP BY conv_id""",
    "transcript": f"SELECT conv_id, md5(string_agg('## ' || {_ROLE} || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS transcript_md5, count(*)::BIGINT AS n_turns FROM conversations GROUP BY conv_id",
    "plausible_query": f"""WITH m AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
        SELECT conv_id, turn, length(text) > 0 AND length(text) <= greatest(80, length(q) * 3) AND NOT contains(text, chr(10)) AND NOT ({" OR ".join(f"contains(lower(text), {S.text(r)})" for r in L.REFUSALS)}) AS plausible
        FROM m WHERE role = 'assistant' AND q IS NOT NULL""",
    "fallback_ranking": f"SELECT page_id, penalty, round(greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.06::DOUBLE * page_id), 6) AS score FROM ({_PENALTY}) ORDER BY penalty, page_id LIMIT 15",
}
