import zlib
from collections import Counter

from tessera.llm.sharding import external_shuffle, op9_sharding, with_shards, write_shards


def laws(rows, shards=8):
    count = Counter(r.shard for r in rows)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count.get(s, 0)))


def test_query(spark, sf):
    rows = op9_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) == len({r.doc_id for r in rows})
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    laws(rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)


def test_odd_rows(docs):
    texts = [None, "", "a", "a", "x" * 200_000] + ["same"] * 40
    rows = with_shards(external_shuffle(docs(texts), bucket_bytes=1000)).collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == [(i, t or "") for i, t in enumerate(texts)]
    laws(rows)


def test_repeated_rows_and_null_keys_spread(spark):
    df = spark.createDataFrame([(1, "t")] * 500 + [(None, "n")] * 20, "doc_id long, text string")
    rows = with_shards(external_shuffle(df, bucket_bytes=40)).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == {(1, "t"): 500, (None, "n"): 20}
    laws(rows)
    assert max(Counter(r.bucket for r in rows).values()) < 60


def test_same_seed_same_order(docs):
    df = docs([f"t{i}" for i in range(300)])
    a, b, c = ([(r.doc_id, r.bucket, r.place) for r in sorted(external_shuffle(df, seed=s, bucket_bytes=300).collect())] for s in (5, 5, 6))
    assert a == b != c


def test_empty_and_written(docs, spark, tmp_path):
    assert with_shards(external_shuffle(docs(["a"]).where("false"))).count() == 0
    write_shards(with_shards(external_shuffle(docs(["a", "b", "c"])), 2), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_more_buckets_than_tasks(docs):
    """The same records in the same buckets, in an order that the layout's seeds give each time."""
    df = docs([f"t{i}" * (i % 7) for i in range(400)])
    one, few, again = (sorted((r.bucket, r.place, r.doc_id) for r in external_shuffle(df, bucket_bytes=200, tasks=n).collect()) for n in (99, 3, 3))
    assert few == again and sorted((b, d) for b, _, d in one) == sorted((b, d) for b, _, d in few) and len({b for b, *_ in one}) > 20
    laws(with_shards(external_shuffle(df, bucket_bytes=40, tasks=3)).collect())
