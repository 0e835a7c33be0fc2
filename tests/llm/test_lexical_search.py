import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical_search as L

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def plain(docs, items, most=50):
    """The contract, row by row."""
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_all, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in terms.items():
        rows = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:most])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(L.op12_lexical_search(spark, sf)) == plain(docs, items)


ODD = [None, "", " .,;", "Straße ÄB äb KK", "a" * 5_000_000 + " tail", "x y z " * 400_000, "one two", "One TWO", "one-two_three", "\x00one\x7f", "長い　文 \U0001f600", "one"]
ASKED = [(1, "one two"), (2, None), (3, ""), (4, "tail X ÄB"), (4, "three"), (None, "y \U0001f600 one one"), (5, "nowhere"), (6, "k K kK 長い　文")]


def test_odd_rows_ties_and_slices(spark, docs):
    df = docs(ODD + ["one two"] * 70)
    df = df.unionByName(df.where("doc_id in (7, 8)")).unionByName(df.where("doc_id = 9").withColumn("doc_id", df.n_chars * 0 + None))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    items = spark.createDataFrame([(*a, "w", 1) for a in ASKED], ITEMS + ", term string, rank int")
    want = plain(rows, ASKED)
    assert len([r for r in want if r[0] == 1]) == 50
    assert found(L.search(df.repartition(3), items)) == want
    assert found(L.search(df, items, slice_bytes=150)) == want
    assert found(L.search(df, items, most=3)) == plain(rows, ASKED, 3)


def test_empty_tables(spark, docs):
    some, none = docs(["a b"]), docs(["a"]).where("false")
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert found(L.search(none, items)) == found(L.search(some, items.where("false"))) == found(L.search(docs([None, " "]), items)) == []


def test_long_texts_in_stretches(monkeypatch):
    text = " ".join(random.Random(5).choice("ab cde é長 fgh ..".split()) for _ in range(3000)).encode()
    whole = L.frequencies(text, {b"ab": 0, b"cde": 1}.get)
    for n in (1, 7, 100):
        monkeypatch.setattr(L, "STRETCH", n)
        assert L.frequencies(text, {b"ab": 0, b"cde": 1}.get) == whole


def test_small_sorts(monkeypatch, spark, docs):
    """A document at a time gives what all at once do."""
    df, items = docs(["a b c", "b c", "c"] * 20), spark.createDataFrame([(1, "a b"), (2, "c a")], ITEMS)
    want = found(L.search(df, items))
    monkeypatch.setattr(L, "AT_ONCE", 1)
    assert found(L.search(df, items)) == want


def test_sums_of_sorted_keys():
    rng = np.random.default_rng(1)
    keys, impacts = rng.integers(0, 2**40, 5000).astype(np.uint64) % np.uint64(70_000_000_000), rng.integers(0, 2**40, 5000)
    keys[::3] = keys[0]
    want = Counter()
    for k, v in zip(keys.tolist(), impacts.tolist(), strict=True):
        want[k] += v
    got, sums = L.added_up(keys, impacts)
    assert list(zip(got.tolist(), sums.tolist(), strict=True)) == sorted(want.items())
    assert np.array_equal(L.radix_order(keys), np.argsort(keys, kind="stable"))
