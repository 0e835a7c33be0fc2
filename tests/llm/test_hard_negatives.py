import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    """The contract over (vec_id, vector, label), each row against each."""
    kept = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, q, label) in enumerate(kept):
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v, strict=False)), i, k) for m, (i, v, k) in enumerate(kept) if m != n]
        for p, pid, _ in sorted(s for s in scores if s[2] == label)[:5]:
            found = sorted(s for s in scores if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            out += [(a, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(H.op13_hard_negatives(spark, sf))
    assert got == plain(rows) and got


ODD = [
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [1.0], 1), (200, [], 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan"), 1.0], 1), (600, [float("inf"), 1.0], 1),
    (None, [1.0, 1.0], 1), (700, [1.0, 1.0], None), (-100, [-1.0, 2.0, 0.25], 2), (1, [0.7, 0.1], 2), (2, [0.7, 0.1], 2), (3, [0.5, 0.5, 9.0], 1), (4, [0.001, -0.001], 3), (900, [-0.5, -0.5], 4), (901, [0.4, 0.4], 4),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", 7, [1]) for r in ODD], SCHEMA + ", rid string, block int, q array<int>")
    assert found(H.mine(df)) == plain(ODD)
    assert found(H.mine(df, pivots=1)) == plain(ODD)


def clusters(n, dim, seed, copies=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.randrange(6)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in centres[c]], c if rng.random() < 0.7 else rng.randrange(6)))
    return rows + [(n + i, list(rows[0][1]), i % 3) for i in range(copies)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(H, "TILE_VALUES", 16)  # tiles of 16 rows


@pytest.mark.parametrize("blocks", [H.BLOCKS, 2])
def test_tiles_blocks_and_many_copies(spark, small, monkeypatch, blocks):
    """Small tiles, anchors in blocks that are broadcast or joined, a vector that a third of all rows has."""
    monkeypatch.setattr(H, "BLOCKS", blocks)
    monkeypatch.setattr(H, "STRIPE", 5)
    rows = clusters(400, 5, 3, copies=200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(H.mine(df, anchor=F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_brackets_hold_and_exclude():
    """No score lies outside its bracket, and on clusters most rows are left out unseen."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 200, (8, 6))
    q = np.rint(centres[rng.integers(0, 8, 2000)] + rng.normal(0, 8, (2000, 6))).astype(np.int64)
    base = H.Table(6, float((q * q).sum(1).max()), np.zeros((0, 7)))
    points = base.added(q.astype(np.float64))
    base.pivots = points[:: 2000 // 8][:8]
    far, flat = base.distances(points), base.distances(np.column_stack([q[:20], np.zeros(20)]))
    square = (q[:20] ** 2).sum(1)[:, None] + base.largest
    lower = np.abs(flat[:, None] - far).max(2)
    upper = (flat[:, None] + far).min(2)
    score = q[:20] @ q.T
    assert (score <= (square - lower**2) / 2 + 0.5).all() and (score >= (square - upper**2) / 2 - 0.5).all()
    fifth = np.sort(score, axis=1)[:, -5]
    assert ((square - lower**2) / 2 + 0.5 >= fifth[:, None]).mean() < 0.4


def test_large_components_wrap_and_extremes_pass(spark):
    rows = [(0, [2.0**30, 1.0], 1), (1, [2.0**30, 2.0], 1), (2, [2.0**29, 0.0], 2), (3, [1e300, -1e300], 3)]
    H.mine(spark.createDataFrame(rows, SCHEMA)).collect()
    rows = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 2.0], 1), (2, [2.0**19, 0.0], 2)]
    assert found(H.mine(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], SCHEMA)
    assert H.mine(df).count() == H.mine(df.where("false")).count() == 0
