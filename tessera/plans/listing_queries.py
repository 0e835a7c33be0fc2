"""Queries of the listings, of single rows and of what is shown of them, each with its SQL.

Listings return every row; the driver's tables stand for notebooks (orders),
sessions (conversations), notes (documents), providers and models (parts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels, records, render
from tessera.functions import sql as S
from tessera.functions import text as T
from tessera.operators import ingest, listings, store
from tessera.plans import text_queries
from tessera.plans.views import SOURCES_SQL, documents, messages, pages, sources, table
from tessera.sources import files, models, search

LOOKED_UP = 7
TOUCHED_AT = "2031-05-06"
KINDS = (*records.MIME_TYPES, "website")
BLOCK_KINDS = ("heading", "list_item", "quote", "code", "table", "caption", "paragraph")
ENDINGS = (".PDF", ".docx", ".rtf", ".epub", ".htm", ".md", ".bin", "", ".tar.gz")
HEADS = ("255044462D", "504B0304AA", "7B5C727466", "4D5A", "")
SCOPES = records.KEPT["default_scope"]


def _one_of(values, n: Column) -> Column:
    return F.element_at(T.strings(values), (n % len(values) + 1).cast("int"))


def _notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    flags = [F.when(k % 7 != 0, k % 5 == 0).alias("is_archived"), F.when(k % 6 != 0, k % 4 == 0).alias("is_favorite")]
    return o.select(k.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), F.to_date("o_orderdate").alias("updated_at"), *flags)


def notebook_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks that aren't archived, latest first."""
    return listings.notebooks(_notebooks(spark, sf_dir)).select("id", "updated_at")


def notebook_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks with a text in title or summary, by section."""
    return listings.notebook_sections(_notebooks(spark, sf_dir), " URGENT ").select("id", "section")


def pinned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions, pinned ones first, each part latest first."""
    s = messages(spark, sf_dir).groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at"))
    return listings.pinned_first(s.withColumn("is_pinned", F.col("id") % 3 == 0)).select("id", "is_pinned", "updated_at")


def note_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of one kind with a text in title or body."""
    notes = documents(spark, sf_dir).select("doc_id", F.col("source").alias("kind"), F.col("lang").alias("title"), F.col("text").alias("body"))
    return listings.filter_notes(notes, "src10", "The an").select("doc_id")


def provider_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("display_name"), (F.col("p_size") < 10).alias("is_local"))
    return listings.providers(p).select("p_partkey", "display_name", "is_local")


def natural_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by title, numbers in titles by their value: some with leading zeros, some of 25 digits."""
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("00"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("1"), F.lpad(k.cast("string"), 24, "0"))).otherwise(k.cast("string"))
    p = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat("p_brand", F.lit(" no "), number, F.lit("B")).alias("title"))
    return listings.sort_sources(p, "title").select("doc_id", listings.natural(F.col("title")).alias("sort_key"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).withColumn("included", F.when(F.col("doc_id") % 4 != 0, F.col("included")))


def eligible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that retrieval may use: included, or without a flag, and in a scope that is a table."""
    scope = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return listings.eligible(_flagged(spark, sf_dir), scope, "doc_id")


def usable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that an answer may name: eligible and not failed."""
    return listings.usable(_flagged(spark, sf_dir), None, "doc_id").select("doc_id", "status")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    row = records.lookup(d, LOOKED_UP, "doc_id")
    return spark.createDataFrame([row] if row else [], d.schema)


def scalar_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values of a table, and the default of one that isn't there."""
    o = table(spark, sf_dir, "orders")
    found = (records.scalar(o, F.max("o_orderkey")), records.scalar(o, F.count_distinct("o_custkey")), records.scalar(o.where("o_orderkey < 0"), F.sum("o_orderkey"), -1))
    return spark.createDataFrame([found], "last_key long, customers long, missing long")


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notebooks after one was opened."""
    rows = _notebooks(spark, sf_dir).select("id", "updated_at", F.when(F.col("id") % 2 == 0, F.col("updated_at")).alias("last_opened_at"))
    return store.touch(rows, LOOKED_UP, F.lit(TOUCHED_AT).cast("date"), True)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files made from the documents' first lines, some of them empty."""
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.concat("source", F.lit('/a:b*"'), F.substring_index("text", "\n", 1), F.lit("?")))
    return documents(spark, sf_dir).select("doc_id", render.file_name(name).alias("name"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    url = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://"), "source"))
    return documents(spark, sf_dir).select(k, render.location(F.when(k % 3 == 0, k % 7), url, F.col("lang")).alias("location"))


def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown, its lines having been made blocks of all kinds."""
    block = lambda x, i: F.struct(_one_of(BLOCK_KINDS, i).alias("kind"), (i % 9).alias("level"), x.alias("text"))
    made = render.document_text(F.transform(F.split("text", "\n"), block))
    return documents(spark, sf_dir).select("doc_id", F.md5(made.cast("binary")).alias("text_md5"), F.length(made).cast("long").alias("n_chars"))


def answer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes made of every question and its answer, under their fields."""
    m = messages(spark, sf_dir)
    asked = m.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    k = F.col("conv_id")
    cited = F.when(k % 2 == 0, F.array(F.lit("[Source 1]"), F.concat(F.lit("[Source "), k.cast("string"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    fields = {"session": k, "turn": F.col("turn"), "pinned": F.when(k % 3 == 0, F.lit(True))}
    note = F.concat(render.front_matter(fields), render.note_of_answer(F.col("question"), F.col("answer"), cited))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(note.cast("binary")).alias("note_md5"))


def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file type of each kind of source, and what each scope of an answer uses."""
    d = documents(spark, sf_dir).select("doc_id", _one_of(KINDS, F.col("doc_id")).alias("kind"), _one_of(SCOPES, F.col("doc_id")).alias("scope"))
    return d.select("doc_id", records.mime_type(F.col("kind")).alias("mime_type"), records.uses_sources(F.col("scope")).alias("uses_sources"), records.uses_web(F.col("scope")).alias("uses_web"))


def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each failed request is told to mean, and what to do."""
    failed = table(spark, sf_dir, "events").select("event_id", labels.failure_of((F.col("event_id") % 400 + 200).cast("int")).alias("failure")).where("failure is not null")
    return failed.select("event_id", records.failure_text(F.col("failure")).alias("f")).select("event_id", "f.message", "f.recovery")


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks approved for a remote service: one more, one less, and whether a question may be sent."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.sequence(F.lit(0).cast("long"), k % 4).alias("approved"), (k % 6).alias("notebook"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    a, n = F.col("approved"), F.col("notebook")
    return rows.select("o_orderkey", joined(records.approve(a, n)).alias("with_it"), joined(records.revoke(a, n)).alias("without_it"), records.is_approved(a, n, k % 5 != 0).alias("may_send"))


def settings_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether passages have to be made anew after each of three changes of settings."""
    old = table(spark, sf_dir, "region").select(_one_of(ingest.INDEX_SETTINGS, F.col("r_regionkey")).alias("name"), F.col("r_name").alias("value"))
    cases = {"none": old, "value": old.withColumn("value", F.when(F.col("value") == "ASIA", "other").otherwise(F.col("value"))), "another setting": old.union(spark.createDataFrame([("theme", "dark")], old.schema)), "gone": old.where("value <> 'ASIA'")}
    return spark.createDataFrame([(n, ingest.needs_reindex(old, new)) for n, new in cases.items()], "change string, reindex boolean")


def known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found anew, with the stored source (every other page) that each renews, by its canonical address or its own."""
    p, k = pages(spark, sf_dir), F.col("page_id")
    stored = p.where(k % 2 == 0).select(k.alias("id"), "url")
    moved = F.concat(F.lit("https://moved.example/"), k.cast("string"))
    found = p.select(k, F.when(k % 3 == 0, moved).otherwise(F.col("url")).alias("url"), F.when(k % 3 == 0, F.concat("url", F.lit("#part"))).alias("canonical"))
    return ingest.known_source(found, stored).select("page_id", "known_id")


def reply_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and token counts of every document as a model's reply, in the JSON of each kind of service."""
    k, text = F.col("doc_id"), F.col("text")
    bodies = {
        "local": F.struct(F.struct(text.alias("content")).alias("message"), k.alias("prompt_eval_count"), (k + 1).alias("eval_count")),
        "completions": F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"), F.struct(k.alias("prompt_tokens"), (k + 1).alias("completion_tokens")).alias("usage")),
        "messages": F.struct(F.array(F.struct(F.lit("note").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("text").alias("type"), F.lit(" end").alias("text"))).alias("content"), F.struct(k.alias("input_tokens"), (k + 1).alias("output_tokens")).alias("usage")),
    }
    d = documents(spark, sf_dir).select("doc_id", *[F.to_json(b).alias(kind) for kind, b in bodies.items()])
    said = [F.md5(models.reply_text(F.col(kind), kind).cast("binary")).alias(f"{kind}_md5") for kind in bodies]
    counts = [models.usage(F.col(kind), kind)[c].alias(f"{kind}_{c}") for kind in bodies for c in ("asked", "said")]
    return d.select("doc_id", *said, *counts)


def model_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of each provider (brand), sorted, from either form of listing."""
    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(":"), F.col("p_partkey").cast("string")))
    listed = p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct("name")).alias("models"))).alias("tags"), F.to_json(F.struct(F.collect_list(F.struct(F.col("name").alias("id"))).alias("data"))).alias("list"))
    return listed.select("p_brand", *[F.array_join(search.model_names(F.col(c), c), "|").alias(c) for c in ("tags", "list")])


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, counts, shares and sizes as they are shown, some of them not known."""
    k = F.col("event_id")
    known = lambda c: F.when(k % 10 != 0, c)
    shown = [labels.duration(known(k * 37)).alias("took"), labels.token_count(known(k * 1009)).alias("tokens"), labels.percent((k % 401) / F.lit(400.0)).alias("share"), labels.byte_size(k % 1200 - 200).alias("size")]
    return table(spark, sf_dir, "events").select("event_id", *shown)


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a file for each document, by its name's ending or its first bytes."""
    k = F.col("doc_id")
    path = F.concat(F.lit("/in.pdf/f"), k.cast("string"), _one_of(ENDINGS, k))
    return documents(spark, sf_dir).select("doc_id", files.kind_of(path, F.unhex(_one_of(HEADS, k))).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        notebook_list, notebook_search, pinned_sessions, note_filter, provider_order, natural_titles, eligible_sources, usable_sources, point_lookup, scalar_reads, touched,
        file_names, locations, rendered_documents, answer_notes, mime_types, failure_texts, approvals, settings_changed, known_sources, reply_values, model_listing,
        display_formats, file_kinds,
    )
}


def _case(values: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in values.items()) + " END"


_BLOCK = """CASE WHEN trim(x) = '' THEN NULL ELSE CASE (i - 1) % 7 WHEN 0 THEN chr(10) || repeat('#', greatest(1, least(6, (i - 1) % 9))::INT) || ' ' || trim(x) || chr(10) WHEN 1 THEN '- ' || trim(x) WHEN 2 THEN '> ' || trim(x)
  WHEN 3 THEN '```' || chr(10) || trim(x) || chr(10) || '```' WHEN 4 THEN trim(x) || chr(10) WHEN 5 THEN '_' || trim(x) || '_' ELSE chr(10) || trim(x) || chr(10) END END"""
_FLAGGED = f"{SOURCES_SQL}, flagged AS (SELECT * REPLACE (CASE WHEN doc_id % 4 <> 0 THEN included END AS included) FROM sources)"
_MESSAGES = {k: v[0] for k, v in records.FAILURES.items()}
_RECOVERIES = {k: v[1] for k, v in records.FAILURES.items()}
SQL = {
    "notebook_list": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS updated_at FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 <> 0 ORDER BY updated_at DESC, id",
    "notebook_search": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 4 = 0 THEN 'favourites' ELSE 'notebooks' END AS section FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%'",
    "pinned_sessions": "SELECT conv_id AS id, conv_id % 3 = 0 AS is_pinned, max(turn) AS updated_at FROM conversations GROUP BY conv_id ORDER BY is_pinned DESC, updated_at DESC, id",
    "note_filter": "SELECT doc_id FROM documents WHERE source = 'src10' AND (contains(lower(lang), 'the an') OR contains(lower(text), 'the an'))",
    "provider_order": "SELECT p_partkey, p_name AS display_name, p_size < 10 AS is_local FROM part ORDER BY is_local DESC, lower(p_name), p_name",
    "natural_titles": "SELECT p_partkey AS doc_id, array_to_string(list_transform(regexp_extract_all(lower(p_brand || ' no ' || CASE p_partkey % 3 WHEN 0 THEN '00' || p_partkey WHEN 1 THEN '1' || lpad(p_partkey::VARCHAR, 24, '0') ELSE p_partkey::VARCHAR END || 'B'), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(coalesce(nullif(ltrim(x, '0'), ''), '0'))::VARCHAR, 10, '0') || coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END), '') AS sort_key FROM part ORDER BY sort_key, doc_id",
    "eligible_sources": f"WITH {_FLAGGED} SELECT doc_id FROM flagged WHERE coalesce(included, true) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "usable_sources": f"WITH {_FLAGGED} SELECT doc_id, status FROM flagged WHERE coalesce(included, true) AND status <> 'failed'",
    "point_lookup": f"SELECT doc_id, lang, source, text FROM documents WHERE doc_id = {LOOKED_UP}",
    "scalar_reads": "SELECT max(o_orderkey) AS last_key, count(DISTINCT o_custkey)::BIGINT AS customers, -1::BIGINT AS missing FROM orders",
    "touched": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey = {LOOKED_UP} THEN DATE '{TOUCHED_AT}' ELSE CAST(o_orderdate AS DATE) END AS updated_at,
        CASE WHEN o_orderkey = {LOOKED_UP} THEN DATE '{TOUCHED_AT}' WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS last_opened_at FROM orders""",
    "file_names": r"""SELECT doc_id, CASE WHEN n = '' THEN 'untitled' ELSE left(n, 80) END AS name FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE source || '/a:b*"' || string_split(text, chr(10))[1] || '?' END, '[/\\:*?"<>|]', '-', 'g')) AS n FROM documents)""",
    "locations": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'page ' || doc_id % 7 WHEN doc_id % 4 <> 0 THEN 'https://' || source ELSE lang END AS location FROM documents",
    "rendered_documents": rf"SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {_BLOCK}), lambda x: x IS NOT NULL), chr(10)), '\s+$', '') AS t FROM documents)",
    "answer_notes": """SELECT q.conv_id, q.turn, md5('---' || chr(10) || 'session: ' || q.conv_id || chr(10) || 'turn: ' || q.turn || CASE WHEN q.conv_id % 3 = 0 THEN chr(10) || 'pinned: true' ELSE '' END || chr(10) || '---' || chr(10)
          || '# ' || q.text || chr(10) || chr(10) || a.text || CASE WHEN q.conv_id % 2 = 0 THEN chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '- [Source 1]' || chr(10) || '- [Source ' || q.conv_id || ']' ELSE '' END) AS note_md5
        FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""",
    "mime_types": f"SELECT doc_id, {_case(records.MIME_TYPES, f'{S.texts(KINDS)}[doc_id % {len(KINDS)} + 1]')} AS mime_type, doc_id % 3 <> {SCOPES.index('webOnly')} AS uses_sources, doc_id % 3 <> {SCOPES.index('notebookSources')} AS uses_web FROM documents",
    "failure_texts": f"""WITH f AS (SELECT event_id, CASE WHEN s < 300 THEN NULL WHEN s IN (401, 403) THEN 'invalid key' WHEN s = 413 THEN 'context too large' WHEN s = 429 THEN 'rate limited' WHEN s >= 500 THEN 'unavailable' ELSE 'rejected' END AS failure FROM (SELECT event_id, event_id % 400 + 200 AS s FROM events))
        SELECT event_id, {_case(_MESSAGES, "failure")} AS message, {_case(_RECOVERIES, "failure")} AS recovery FROM f WHERE failure IS NOT NULL""",
    "approvals": """WITH o AS (SELECT o_orderkey, range(0, o_orderkey % 4 + 1) AS a, o_orderkey % 6 AS n FROM orders)
        SELECT o_orderkey, array_to_string(CASE WHEN list_contains(a, n) THEN a ELSE list_append(a, n) END, ',') AS with_it, array_to_string(list_filter(a, lambda x: x <> n), ',') AS without_it, o_orderkey % 5 = 0 OR list_contains(a, n) AS may_send FROM o""",
    "settings_changed": f"""WITH old AS (SELECT {S.texts(ingest.INDEX_SETTINGS)}[r_regionkey % {len(ingest.INDEX_SETTINGS)} + 1] AS name, r_name AS value FROM region),
        new AS (SELECT c AS change, name, CASE WHEN c = 'value' AND value = 'ASIA' THEN 'other' ELSE value END AS value FROM old, (VALUES ('none'), ('value'), ('another setting'), ('gone')) t(c) WHERE c <> 'gone' OR value <> 'ASIA'
          UNION ALL SELECT 'another setting', 'theme', 'dark')
        SELECT d.change, EXISTS (SELECT name, value FROM old EXCEPT SELECT name, value FROM new n WHERE n.change = d.change) OR EXISTS (SELECT name, value FROM new n WHERE n.change = d.change AND list_contains({S.texts(ingest.INDEX_SETTINGS)}, name) EXCEPT SELECT name, value FROM old) AS reindex
        FROM (SELECT DISTINCT change FROM new) d""",
    "known_sources": f"""{text_queries.KEYED}, known AS (SELECT key, min(page_id) AS id FROM keyed WHERE page_id % 2 = 0 GROUP BY key) SELECT page_id, id AS known_id FROM keyed LEFT JOIN known ON keyed.key = known.key""",
    "reply_values": "SELECT doc_id, md5(text) AS local_md5, md5(text) AS completions_md5, md5(text || ' end') AS messages_md5, doc_id AS local_asked, doc_id + 1 AS local_said, doc_id AS completions_asked, doc_id + 1 AS completions_said, doc_id AS messages_asked, doc_id + 1 AS messages_said FROM documents",
    "model_listing": "SELECT p_brand, string_agg(p_name || ':' || p_partkey, '|' ORDER BY p_name || ':' || p_partkey) AS tags, string_agg(p_name || ':' || p_partkey, '|' ORDER BY p_name || ':' || p_partkey) AS list FROM part GROUP BY p_brand",
    "display_formats": """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id * 37 END AS ms, CASE WHEN event_id % 10 <> 0 THEN event_id * 1009 END AS n, event_id % 1200 - 200 AS b FROM events)
        SELECT event_id, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || ' ms' ELSE ((ms + 50) // 100) // 10 || '.' || ((ms + 50) // 100) % 10 || ' s' END AS took, coalesce(format('{:,}', n), '—') AS tokens,
          printf('%.0f%%', (event_id % 401) / 400.0::DOUBLE * 100) AS share, greatest(b, 0) || ' bytes' AS size FROM e""",
    "file_kinds": f"""WITH d AS (SELECT doc_id, {S.texts(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS e, doc_id % {len(HEADS)} AS h FROM documents)
        SELECT doc_id, CASE e WHEN '.PDF' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.rtf' THEN 'rtf' WHEN '.epub' THEN 'epub' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'text' ELSE CASE h WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'rtf' END END AS kind FROM d""",
}
