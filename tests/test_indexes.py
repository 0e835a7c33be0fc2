"""The stored indexes give what full scans give, and read less."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators import keyword_index as K
from tessera.operators import retrieval as R
from tessera.operators import vector_index as V
from tessera.operators.store import Store
from tessera.plans import stored_queries as S
from tessera.plans.retrieval_queries import TERMS
from tessera.plans.views import passages


def tops(rows, score):
    return [(r.chunk_id, round(r[score], 9)) for r in rows]


def library(spark, path, n=1200, seed=2):
    """Passages over a vocabulary in which some words are rare; a third of them belong to one source."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, f"s{0 if i % 3 == 0 else i % 40}", " ".join(rng.choices(words, weights, k=rng.choice((5, 30, 120))))) for i in range(n)]
    store = Store(spark, str(path))
    ingest.store_passages(store, spark.createDataFrame(rows, "id long, source_id string, text string"))
    ingest.build_index(store)
    return store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return library(spark, tmp_path_factory.mktemp("lib") / "s")


@pytest.mark.parametrize("terms", [["w300", "w5"], ["w0", "w1"], ["w390", "w390", "w2", "nowhere"], ["nowhere"], []])
def test_blocks_give_the_list_of_a_scan(spark, stored, monkeypatch, terms):
    store = stored
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
    index = ingest.index_of(store)
    assert isinstance(index, K.BlockIndex)
    assert tops(index.top(terms, 20), "keyword") == tops(R.keyword_top(chunks, terms, 20), "keyword")
    some = spark.createDataFrame([("s1",), ("s7",), ("s0",)], "source_id string")
    assert tops(index.top(terms, 5, some), "keyword") == tops(R.keyword_top(chunks, terms, 5, some), "keyword")
    if terms == ["w300", "w5"]:
        monkeypatch.setattr(K, "FIRST", 4)
        assert tops(index.top(terms, 3), "keyword") == tops(R.keyword_top(chunks, terms, 3), "keyword")
        assert index.share_read(terms) < 0.5  # the rare word's ranges alone


def test_bounds_hold_for_every_passage(spark, tmp_path):
    store = library(spark, tmp_path / "lib", 600)
    index = ingest.index_of(store)
    known = index.statistics(["w3", "w50"])
    bounds = {r.range: r.bound for r in index.bounds(["w3", "w50"], known).collect()}
    of = {(r.chunk_id): r.range for r in index.blocks.where("term in ('w3', 'w50')").select("range", F.inline("posts")).collect()}
    for r in index.scores(["w3", "w50"]).collect():
        assert r.keyword <= bounds[of[r.chunk_id]] + 1e-9


def test_many_ranges_are_read_in_waves(spark, tmp_path, monkeypatch):
    store = library(spark, tmp_path / "lib", 900)
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
    monkeypatch.setattr(K, "FIRST", 2)
    monkeypatch.setattr(K, "LISTED", 5)
    for terms in (["w0", "w1", "w2"], ["w200"]):
        assert tops(ingest.index_of(store).top(terms, 10), "keyword") == tops(R.keyword_top(chunks, terms, 10), "keyword")


def test_changes_are_read_beside_the_blocks(spark, tmp_path):
    store = library(spark, tmp_path / "lib", 500)
    new = spark.createDataFrame([(9001, "s1", "w300 w300 w5"), (9002, "new", "w5 " * 900), (9003, "s3", "")], "id long, source_id string, text string")
    ingest.store_passages(store, new)
    with store.change() as c:
        for name in ("chunks", "postings"):
            c.delete(name, spark.createDataFrame([("s2",)], "source_id string"), "source_id")
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
    index = ingest.index_of(store)
    assert index.put is not None and chunks.where("source_id in ('s1', 's2')").count() == 1
    for terms in (["w300", "w5"], ["w1"]):
        assert tops(index.top(terms, 20), "keyword") == tops(R.keyword_top(chunks, terms, 20), "keyword")
        scores = lambda df: {r.chunk_id: round(r.keyword, 9) for r in df.collect()}
        assert scores(index.scores(terms)) == scores(R.keyword_scores(chunks, terms))
    store.vacuum()  # leaves alone what the index follows
    chunks = store.read("chunks").withColumnRenamed("id", "chunk_id")
    assert tops(ingest.index_of(store).top(["w300", "w5"], 20), "keyword") == tops(R.keyword_top(chunks, ["w300", "w5"], 20), "keyword")
    with pytest.raises(ValueError, match="index follows"):
        store.fold("postings")
    ingest.build_index(store)
    again = ingest.index_of(store)
    assert again.put is None and tops(again.top(["w300", "w5"], 20), "keyword") == tops(R.keyword_top(chunks, ["w300", "w5"], 20), "keyword")


def clustered(n, dim=16, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, dim))
    x = centres[rng.integers(0, 24, n)] + spread * rng.normal(size=(n, dim))
    return np.vstack([x, np.tile(x[:1], (n // 3, 1)), np.zeros((3, dim))])


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, f"s{i % 11}", [float(v) for v in x]) for i, x in enumerate(clustered(3000))]
    return spark.createDataFrame(rows, "chunk_id long, source_id string, vector array<double>").cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("v") / "blocks")
    centres = V.fitted(clustered(3000)[:2000], 24)
    V.blocks(vectors, centres, size=64).write.parquet(path)
    return V.VectorIndex(spark.read.parquet(path), centres)


def test_the_best_vectors_from_a_third_of_the_blocks(spark, vectors, index):
    for probe in (5, 77, 2999):
        query = [float(v) for v in clustered(3000)[probe]]
        channel = index.channel(query)
        scan = R.Scan(R.semantic_scores(vectors, query))
        assert tops(channel.top(40), "semantic") == tops(scan.top(40), "semantic")
        assert channel.share_read() <= 1 / 3 or probe == 0
        assert channel.count() == scan.count()
        hits = sorted(scan.scores_of([1, 50, 999, 2500, 3001, 3999]), key=lambda r: (-r.semantic, r.chunk_id))
        assert hits and channel.ranks_of(hits) == scan.ranks_of(hits)
        assert sorted(map(tuple, channel.scores_of([1, 50, 999, 2500]))) == sorted(map(tuple, scan.scores_of([1, 50, 999, 2500])))


def test_equal_vectors_go_by_id(spark, vectors, index):
    query = [float(v) for v in clustered(3000)[0]]
    assert [r.chunk_id for r in index.channel(query).top(30)] == [0, *range(3000, 3029)]


def test_scope_and_changes(spark, vectors, index):
    query = [float(v) for v in clustered(3000)[9]]
    some = spark.createDataFrame([("s1",), ("s4",)], "source_id string")
    scoped = R.Scan(R.semantic_scores(vectors.join(some, "source_id", "left_semi"), query))
    channel = index.channel(query, some)
    hits = scoped.top(25)
    assert tops(channel.top(25), "semantic") == tops(hits, "semantic") and channel.ranks_of(hits) == list(range(1, 26)) and channel.count() == scoped.count()
    put = spark.createDataFrame([(90_000, "s1", query), (90_001, "x", [-v for v in query])], vectors.schema)
    gone = spark.createDataFrame([("s1",), ("s9",)], "source_id string")
    now = vectors.join(gone, "source_id", "left_anti").select(*vectors.columns).unionByName(put)
    scan, channel = R.Scan(R.semantic_scores(now, query)), V.VectorIndex(index.blocks, index.centres, put, gone).channel(query)
    assert tops(channel.top(40), "semantic") == tops(scan.top(40), "semantic") and channel.count() == scan.count()
    assert channel.ranks_of(scan.top(40)) == list(range(1, 41))


def test_no_vectors_and_zero_vectors(spark, vectors):
    none = vectors.where("false")
    centres = V.centres_of(none)
    channel = V.VectorIndex(V.blocks(none, centres), centres).channel([1.0] * 16)
    assert channel.top(5) == [] and channel.count() == 0
    zeros = vectors.where("chunk_id >= 4000")
    assert zeros.count() == 3 and V.centres_of(zeros).size == 0


def test_a_library_of_the_tables(spark, sf):
    store = S.library(spark, sf)
    chunks = passages(spark, sf)
    assert tops(ingest.index_of(store).top(TERMS, 20), "keyword") == tops(R.keyword_top(chunks, TERMS, 20), "keyword")
    assert "PushedFilters: [In(term" in ingest.index_of(store)._of({"inand": 1, "thth": 1})._jdf.queryExecution().executedPlan().toString()
    assert store.read("chunks").count() == chunks.count() and math.isclose(sum(r.n for r in store.read("posting_totals").collect()), chunks.count())


def test_postings_are_counted_within_their_rows(spark):
    """F1 to F4: what a passage holds is in its row, so counting it shuffles nothing, and blocks shuffle packed rows once."""
    texts = ["Été ete ÉTÉ b b1 b", "", None, "_ . -", "straße b " * 3, "x"]
    chunks = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts)], "chunk_id long, source_id string, text string")
    rows = K.postings(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term): (r.tf, r.dl) for r in rows.collect()}
    assert got == {(0, "ete"): (3, 6), (0, "b"): (2, 6), (0, "b1"): (1, 6), (4, "straße"): (3, 6), (4, "b"): (3, 6), (5, "x"): (1, 1)} | {(i, ""): (1, n) for i, n in enumerate((6, 0, 0, 0, 6, 1))}
    packed = K.packed(chunks)
    made = K.blocks(packed, 6, 13)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "rangepartitioning" not in plan
    found = made.collect()
    assert [r.term for r in found] == sorted(r.term for r in found) and all(r.n == len(r.posts) and r.most == max(p.tf for p in r.posts) and r.least == min(p.dl for p in r.posts) for r in found)
    assert {(p.chunk_id, r.term): (p.tf, p.dl) for r in found for p in r.posts} == {k: v for k, v in got.items() if k[1]}


def test_what_is_gone_is_counted_in_the_blocks(spark, tmp_path):
    """a change's lost postings are those of the terms' blocks; of the passages only lengths are read."""
    store = library(spark, tmp_path / "lib", 200)
    ingest.store_passages(store, spark.createDataFrame([(9001, "s1", "w3 w3 w5"), (9002, "s2", "")], "id long, source_id string, text string"))
    index, chunks = ingest.index_of(store), store.read("chunks").withColumnRenamed("id", "chunk_id")
    assert "term" not in index.passages.columns
    known, fresh = index.statistics(["w3", "w5", "nowhere"]), K.postings(chunks)
    whole = fresh.where("term = ''").selectExpr("count(*) n", "avg(dl) a").first()
    assert known.n == whole.n and math.isclose(known.avgdl, whole.a)
    assert {t: known.df.get(t, 0) for t in ("w3", "w5", "nowhere")} == {t: fresh.where(F.col("term") == t).count() for t in ("w3", "w5", "nowhere")}
