import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.vectors import fnv1a, fnv1a_hex
from tessera.operators import embedding
from tessera.operators import retrieval as R


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column).collect()]


def test_text_values(spark):
    x = F.col("x")
    assert one(spark, T.tokens(x), "The Industrial Revolution, 1760–1840!", "don't stop-believing") == [["the", "industrial", "revolution", "1760", "1840"], ["don", "t", "stop", "believing"]]
    words = ["declining", "declines", "decline", "inspections", "inspection", "policies", "policy", "organizations"]
    stems = ["declin", "declin", "decline", "inspect", "inspect", "policy", "policy", "organ"]
    assert one(spark, T.stem(x), *words) == stems == [T.stem_word(w) for w in words]
    assert one(spark, T.token_estimate(x), "", "abcd", "abcde", "日本語ab") == [0, 2, 3, 5]
    assert one(spark, T.preview(x, 10), "short", "a  b\n c", "some words here", "unbroken-long-word") == ["short", "a b c", "some…", "unbroken-l…"]
    assert one(spark, T.strip_markup(x), "**b** [l](u) `c` ~~s~~ _e_") == ["b l (u) c s e"]
    assert one(spark, T.session_title(x), "one two  three four five six seven eight") == ["one two three four five six seven"]


def test_fnv(spark):
    values = ["", "a", "foobar", "é"]
    assert one(spark, fnv1a_hex("x"), *values, None) == [f"{fnv1a(v):016x}" for v in values] + [None] and fnv1a("a") == 0xAF63DC4C8601EC8C


def test_urls(spark):
    x = F.col("x")
    same = ["http://www.A.example/x/?utm_source=f#top", "https://a.example/x", "https://a.example/x//"]
    assert set(one(spark, U.dedupe_key(x), *same)) == {"https://a.example/x"}
    assert one(spark, U.dedupe_key(x), "https://a.example:8080/?b=1&ref=2", "not an address ") == ["https://a.example:8080/?b=1", "not an address"]
    assert one(spark, U.navigation_penalty(x), "https://a/story", "https://a/tag/x", "https://a/", "https://a/x?q", "words") == [0, 2, 2, 3, 1]
    assert one(spark, U.is_private(x), "http://10.1.2.3/", "http://172.32.0.1", "http://192.168.1.1:80", "http://me.local/x", "http://a.example", "x", "http://10.1.2.999") == [True, False, True, True, False, False, False]
    assert one(spark, U.unwrap_redirect(x), "//d/l/?uddg=https%3A%2F%2Fa%2Fb&z=1", "https://c") == ["https://a/b", "https://c"]


CORPUS = [
    ("Inspectorate Annual Report", "The inspectorate reorganisation slowed permits. Inspections declined after the reorganisation of the agency."),
    ("Inspectorate Annual Report", "Recommendations ask for more inspectors and for better records of each inspection."),
    ("News", "Permits slow to a crawl as the office reorganised its work and lost its staff."),
    ("Paper", "Administrative reform changes the cost of permits for small firms in the regions."),
    ("Museum", "Museum funding rose in spring, and the gallery opened a new wing to visitors."),
]


@pytest.fixture
def library(spark):
    chunks = spark.createDataFrame([(i, s, t, s, 60) for i, (s, t) in enumerate(CORPUS)], "chunk_id long, source_id string, text string, heading string, token_count long")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(embedding.embed([t for _, t in CORPUS]))], "chunk_id long, vector array<float>")
    return chunks, vectors


def found(library, query, settings=R.Settings(floor=0.0), vectors=True):
    chunks, vs = library
    q = embedding.embed([query])[0].tolist()
    return [r.chunk_id for r in R.retrieve(chunks, vs if vectors else None, query, q if vectors and any(q) else None, settings).orderBy("rank").collect()]


def test_relevance(library):
    assert found(library, "Why did permits slow down?")[0] in (0, 2) and 4 not in found(library, "Why did permits slow down?")[:3]
    assert found(library, "inspection inspectors")[0] == 1 or found(library, "inspection inspectors")[0] == 0
    assert found(library, "permits", vectors=False) and found(library, "museum gallery", R.Settings(), False) == [4]


def test_queries_of_no_use(library):
    assert found(library, "zzzz", R.Settings(), False) == []
    assert found(library, "zzzz", R.Settings(floor=0.0), False) == [0, 1, 2, 3, 4][:8]
    for q in ("", "   ", "\n", "a", "the of and", "x" * 5000, "it's (OR) NEAR* \"quoted"):
        found(library, q)


def test_caps_budget_and_single_source(spark):
    rows = [(i, "A", 0.9 - i / 100, 50) for i in range(40)] + [(100 + i, "B", 0.5 - i / 10, 50) for i in range(2)]
    df = spark.createDataFrame(rows, "chunk_id long, source_id string, effective double, token_count long")
    out = R.select_rows(df, R.Settings(results=6, per_source=2, floor=0.0), 2).collect()
    assert sorted(r.chunk_id for r in out) == [0, 1, 100, 101]
    assert R.select_rows(df.where("source_id = 'A'"), R.Settings(results=6, per_source=2, floor=0.0), 1).count() == 6
    assert [r.used_tokens for r in R.select_rows(df, R.Settings(results=60, per_source=50, floor=0.0, budget=500), 2).orderBy("rank").collect()] == [74 * k for k in range(1, 7)]
    huge = df.withColumn("token_count", F.lit(10**6))
    assert R.select_rows(huge, R.Settings(), 2).count() == 1
    assert R.select_rows(df.where("chunk_id >= 100").withColumn("effective", F.lit(0.01)), R.Settings(), 2).count() == 2


def test_bm25_value(spark):
    chunks = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha alpha gamma épsilon")], "chunk_id long, text string")
    got = {r.chunk_id: r.keyword for r in R.keyword_scores(chunks, ["beta", "epsilon"]).collect()}
    idf, avg = math.log((3 - 1 + 0.5) / 1.5), 3.0
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))) and got[3] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / avg))) and 2 not in got
    assert R.keyword_scores(chunks, []).count() == 0


def test_citations(spark):
    answers = spark.createDataFrame([(1, "So it is [Source 1] and [source 9] , [Web 2]."), (2, "No mark at all."), (3, None)], "answer_id long, answer string")
    known = spark.createDataFrame([(1, "[Source 1]"), (1, "[Web 2]"), (2, "[Source 1]")], "answer_id long, marker string")
    got = {r.answer_id: r for r in R.resolve_citations(answers, known).collect()}
    assert (got[1].cited, got[1].invented, got[1].cleaned) == (["[Source 1]", "[Web 2]"], ["[source 9]"], "So it is [Source 1] and, [Web 2].")
    assert got[2].cleaned == "No mark at all." and got[2].cited == []


def test_settings():
    assert R.settings_for_context(5_000).budget == 2_000 and R.settings_for_context(100_000).results == 18
    s = R.Settings(results=500, candidates=1, budget=1, per_source=0).clamped()
    assert (s.results, s.candidates, s.budget, s.per_source) == (60, 60, 500, 1)
    assert T.keyword_terms("is it the") == ["is", "or", "it", "or", "the"]


def test_context_with_web_results(spark, library):
    chunks, _ = library
    picked = spark.createDataFrame([(0, 1), (2, 2)], "chunk_id long, rank int")
    titles = chunks.select("source_id").distinct().select("source_id", F.col("source_id").alias("title"), F.lit(None).cast("string").alias("location"))
    web = spark.createDataFrame([(i, f"W{i}", f"http://w/{i}", "words " * 300) for i in range(1, 9)], "position int, title string, url string, content string")
    blocks = R.assemble(picked, chunks, titles, 4000)
    found = R.assemble_web(web, blocks, 500)
    used = sum(r.estimate for r in blocks.collect())
    rows = found.orderBy("n").collect()
    assert 0 < len(rows) < 8 and used + sum(r.estimate for r in rows) <= 1700 < used + sum(r.estimate for r in rows) + rows[0].estimate
    text = R.context_text(blocks, found).first().context
    assert text.startswith(R.SOURCES_HEADING + "\n\n[Source 1] Inspectorate Annual Report\nSection: ") and "\n\n---\n\n[Source 2]" in text and R.WEB_HEADING + "\n\n[Web 1] W1 — http://w/1\n" in text
    assert R.WEB_HEADING not in R.context_text(blocks).first().context
    assert R.assemble_web(web, blocks.where("false"), -5000).count() == 1
