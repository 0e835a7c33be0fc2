"""The store's changes: read over the table, folded, taken once; streams and reindexing that go on where they stopped."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators.store import Store, replace_children, upsert, with_changes
from tessera.streaming import incremental
from tessera.streaming.incremental import changed_files, ingest_folder, ingest_stream, rescan


def rows(spark, *x):
    return spark.createDataFrame(list(x), "id string, v long")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_go_on_after_a_manifest_that_was_cut_short(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"))
    store.write("a", rows(spark, ("k", 1)), "id")
    number, _ = store._manifest()
    fs, where = store._fs(f"_manifests/{number + 1:012d}.json")
    out = fs.create(where, False)
    out.write(bytearray(b'{"schema'))
    out.close()
    store.upsert("a", rows(spark, ("k", 2)))
    store.upsert("a", rows(spark, ("l", 3)))
    assert values(store.read("a")) == [("k", 2), ("l", 3)] and store._manifest()[0] == number + 3
    store.vacuum()
    assert values(Store(spark, str(tmp_path / "lib")).read("a")) == [("k", 2), ("l", 3)]


def bytes_under(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_change_writes_what_it_brings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"))
    wide = lambda df: df.select(F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store.write("a", wide(spark.range(40_000)), "id")
    whole = bytes_under(tmp_path)
    changed = wide(spark.range(200).withColumn("id", F.col("id") * 199)).withColumn("text", F.lit("x"))
    store.upsert("a", changed)
    assert bytes_under(tmp_path) - whole < whole / 50
    got = store.read("a")
    assert got.count() == 40_000 and got.where("text = 'x'").count() == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "AdaptiveSparkPlan" in plan


def test_any_sequence_of_changes_is_what_the_plain_functions_give(spark, tmp_path):
    rng = random.Random(4)
    store = Store(spark, str(tmp_path / "lib"), buckets=4)
    schema = "id string, notebook_id string, kind string, added_at long, v long"
    make = lambda ids: spark.createDataFrame([(f"k{i}", f"n{rng.randrange(9)}", f"kind{rng.randrange(9)}", rng.randrange(99), rng.randrange(99)) for i in ids], schema)
    first = make(range(12))
    store.write("sources", first, "id")
    want = {r.id: tuple(r) for r in first.collect()}
    for step in range(5):
        if step % 3 == 2:
            gone = [f"k{i}" for i in rng.sample(range(16), 4)]
            with store.change() as c:
                c.delete("sources", spark.createDataFrame([(g,) for g in gone], "id string"), "id")
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            new = make(rng.sample(range(16), 6)).collect()
            frame = spark.createDataFrame(new, schema)
            plain = upsert(spark.createDataFrame(list(want.values()), schema), frame, "id", ("notebook_id", "kind", "added_at"))
            store.upsert("sources", frame)
            want = {r.id: tuple(r) for r in plain.collect()}
        assert values(store.read("sources")) == sorted(want.values())
        if step == 3:
            store.fold("sources")
            assert values(store.read("sources")) == sorted(want.values()) and not store._manifest()[1]["tables"]["sources"]["changes"]


def test_replaced_children(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"), buckets=4)
    kids = lambda *x: spark.createDataFrame(list(x), "id string, source_id string")
    old, new = kids(("a1", "a"), ("a2", "a"), ("b1", "b"), ("c1", "c")), kids(("a3", "a"))
    parents = spark.createDataFrame([("a",), ("b",)], "source_id string")
    store.write("chunks", old, "source_id")
    with store.change() as c:
        c.replace("chunks", new, parents, "source_id", "id")
    assert values(store.read("chunks")) == values(replace_children(old, new, parents, "source_id", "id")) == [("a3", "a"), ("c1", "c")]
    with pytest.raises(ValueError, match="repeated"), store.change() as c:
        c.replace("chunks", kids(("x", "a"), ("x", "a")), parents, "source_id", "id")
    with pytest.raises(ValueError, match="kept by"), store.change() as c:
        c.delete("chunks", parents.withColumnRenamed("source_id", "id"), "id")
    assert store.read("chunks").count() == 2
    assert with_changes(old, None, None, "id") is old


def test_large_tables_get_more_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"), buckets=2)
    store.write("a", rows(spark, *[(f"k{i}", i) for i in range(300)]), "id")
    store.upsert("a", rows(spark, ("k5", -5)))
    store.fold("a", bucket_bytes=400)
    table = store._manifest()[1]["tables"]["a"]
    assert table["buckets"] > 4 and len(table["folders"]) == table["buckets"] and store.read("a").count() == 300
    store.upsert("a", rows(spark, ("k6", -6)))
    store.fold("a")
    assert dict(values(store.read("a")))["k6"] == -6 and store.read("a").count() == 300


TEXT = "# Topic\n" + " ".join(f"Sentence {i} speaks of the permits and how they were delayed in the office." for i in range(60))


def test_a_batch_killed_after_its_commit_counts_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"title": "a", "text": TEXT}) + "\n")
    store = Store(spark, str(tmp_path / "lib"))
    real, calls = incremental.store_batch, []

    def dies(*a, **k):
        calls.append(1)
        real(*a, **k)
        if len(calls) == 1:
            raise RuntimeError("the driver is lost after the commit")

    monkeypatch.setattr(incremental, "store_batch", dies)
    start = lambda: ingest_stream(spark.readStream.schema("title string, text string").json(str(tmp_path / "in")), store, str(tmp_path / "cp"), vectors=False)
    with pytest.raises(Exception, match="lost after"):
        start().awaitTermination()
    manifest, n = store._manifest(), store.read("chunks").count()
    start().awaitTermination()
    assert len(calls) == 1 and store._manifest() == manifest and store.read("chunks").count() == n > 1
    (tmp_path / "in" / "b.json").write_text(json.dumps({"title": "b", "text": TEXT + "b"}) + "\n")
    start().awaitTermination()
    assert len(calls) == 2 and store.read("sources").count() == 2 and store.read("chunks").groupBy("id").count().where("count > 1").count() == 0


def test_a_stream_of_files_and_what_changed_in_them(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(TEXT)
    (folder / "e.md").write_text("  ")
    store = Store(spark, str(tmp_path / "lib"))
    for _ in range(2):
        ingest_folder(spark, str(folder), store, str(tmp_path / "cp"), vectors=False).awaitTermination()
    assert {(r.title, r.status) for r in store.read("sources").collect()} == {("a.txt", "ready"), ("e.md", "failed")}
    assert changed_files(spark, str(folder), store).count() == 0
    (folder / "a.txt").write_text(TEXT + " More of it, at the very end.")
    assert [r.path.rsplit("/", 1)[1] for r in changed_files(spark, str(folder), store).collect()] == ["a.txt"]
    words = {r.title: r.words for r in store.read("sources").collect()}["a.txt"]
    rescan(spark, str(folder), store, vectors=False)
    assert {r.title: r.words for r in store.read("sources").collect()}["a.txt"] == words + 7 and store.read("sources").count() == 2
    assert changed_files(spark, str(folder), store).count() == 0


def test_reindexing_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "lib"))
    texts = spark.createDataFrame([(f"t{i}", TEXT + str(i)) for i in range(6)], "title string, text string")
    ingest.store_batch(store, ingest.from_texts(texts), vectors=False)
    n, real, done = store.read("chunks").count(), ingest.store_batch, []

    def stops(*a, **k):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(k["batch"])
        return real(*a, **k, vectors=False)

    monkeypatch.setattr(ingest, "store_batch", stops)
    with pytest.raises(RuntimeError):
        ingest.reindex(store, parts=4, token="x")
    done.clear()
    ingest.reindex(store, parts=4, token="x")
    assert [b[1] for b in done] == [2, 3] and store.read("chunks").count() == n
    done.clear()
    assert ingest.reindex(store, parts=4, token="x").count() == 0 and not done
