"""Hard negatives by a pivot table.

Vectors are quantised to integers and a component is added that gives all rows one
length, M, the largest there is; an anchor gets a zero there. Then the squared
distance of an anchor a and a row x is |a|^2 + M^2 - 2 a.x, so the nearest rows are
those of the largest inner product. The distances of every row to a few pivots are
stored with it, in tiles of rows that are near one pivot, with each tile's least and
largest distance. By the triangle inequality the anchor's own distances to the
pivots bracket its distance to a tile, then to a row, and so the score. Only rows
whose bracket reaches what an anchor still takes are checked, by exact inner
products. The results are those of a full search; pivots only change what it costs.

Pivots are chosen from at most ``SAMPLE`` rows, those of least hashed numbers,
each the farthest from those before it. Anchors, a stated part of all rows, are held
against all tiles in blocks of about ``TILE`` rows: the first pass finds an
anchor's positives, the second its negatives for each positive. A task keeps the
best rows so far, whose last score is what a bracket has to reach, and passes on
short lists, which are merged. Blocks are broadcast where there are few, and else
meet stripes of the tiles in a join by block and stripe.

Within each task brackets rarely exclude much where vectors are evenly spread over
many dimensions; they do on clusters.

Cases: rows with a null id, label or vector, or a null or non-finite component take
no part. Rows that repeat an id are rows of their own, each an anchor if its id says
so, and each may be positive or negative of the others. Shorter vectors count as if
zeros followed, empty ones score 0. Equal scores go by id. Where the squared length
of a vector reaches 2^52, scores are added up in 64-bit integers, which wrap, and no
bracket is used. Other columns are ignored, whatever their names. An empty table,
or one without anchors, gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

POSITIVES, NEGATIVES, EVERY = 5, 10, 100
#: A negative's score is within these hundredths of its positive's.
LOW, HIGH = 30, 90
PIVOTS, SAMPLE = 8, 512
TILE, TILE_VALUES, BUFFER = 1024, 1 << 18, 16
#: Blocks of anchors that are broadcast, and that a task keeps lists of at a time; tiles of a stripe beyond that.
BLOCKS, STRIPE = 32, 4096
#: Squared length below which sums of products are exact in doubles.
EXACT = float(1 << 52)
FAR = np.iinfo(np.int64).max


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, vec_id, label, q): the rows that take part, numbered, a component x as floor(256 x)."""
    values = F.col("v")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & values.isNotNull() & ~odd)
    return whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.transform(values, lambda x: F.floor(x * 256)).alias("q"))


@dataclass
class Table:
    """What the pivot table rests on: dimension, largest squared length, pivots with their added component."""

    dim: int
    largest: float
    pivots: np.ndarray

    @property
    def exact(self) -> bool:
        return self.largest < EXACT

    @property
    def tile(self) -> int:
        return max(16, min(TILE, TILE_VALUES // max(1, self.dim)))

    def added(self, values: np.ndarray) -> np.ndarray:
        """Rows with the component that gives them the length M."""
        return np.column_stack([values, np.sqrt(np.maximum(self.largest - (values * values).sum(1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of augmented points to each pivot."""
        square = (points * points).sum(1)[:, None] + self.largest - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows of one length."""
    flat, n = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
    if len(flat) == len(n) * dim:
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Table:
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = vectors.agg(F.max(F.size("q")).alias("dim"), F.max(length).alias("largest")).first()
    dim, largest = found.dim or 0, found.largest or 0.0
    rows = vectors.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("q").collect()
    out = Table(dim, largest, np.zeros((0, dim + 1)))
    if not rows or not out.exact:
        return out
    points = out.added(padded(pa.array([r.q for r in rows], pa.list_(pa.int64())), dim).astype(np.float64))
    chosen, near = [0], np.full(len(points), np.inf)
    while len(chosen) < min(pivots, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(near.argmax()))
    out.pivots = points[chosen]
    return out


TILES = "rids array<long>, ids array<long>, labels array<long>, q array<long>, far array<double>, least array<double>, most array<double>"


def tiles(vectors: DataFrame, base: Table) -> DataFrame:
    """Rows in tiles: ids, labels, values and distances to the pivots, and the least and largest of these."""

    def cut(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rids, ids, labels, q = (np.concatenate(x) for x in zip(*held, strict=True))
        far = base.distances(base.added(q.astype(np.float64))) if len(base.pivots) else np.zeros((len(q), 0))
        order = np.lexsort((far.min(1), far.argmin(1))) if len(base.pivots) else np.arange(len(q))
        for at in range(0, len(order), base.tile):
            mine = order[at : at + base.tile]
            d = far[mine]
            columns = (rids[mine], ids[mine], labels[mine], q[mine].ravel(), d.ravel(), d.min(0), d.max(0))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], names=["rids", "ids", "labels", "q", "far", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, base.tile):
                part = batch.slice(at, base.tile)
                held.append((*(part.column(c).to_numpy() for c in ("rid", "vec_id", "label")), padded(part.column("q"), base.dim)))
                rows += part.num_rows
                if rows >= BUFFER * base.tile:
                    yield from cut(held)
                    held, rows = [], 0
        if held:
            yield from cut(held)

    return vectors.mapInArrow(run, TILES)


@dataclass
class Tile:
    rids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    far: np.ndarray
    least: np.ndarray
    most: np.ndarray


class Block:
    """Anchors of one block, what each takes (score limits for each of its lists) and the best rows so far.

    A list takes scores from ``low`` to ``high``; ``low`` rises to the last score of a full list."""

    def __init__(self, base: Table, rids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.base, self.rids, self.labels, self.same, self.most = base, rids, labels, same, most
        self.low, self.high, self.q = low.copy(), high, q
        self.values = q.astype(np.float64)
        if len(base.pivots):
            flat = np.column_stack([self.values, np.zeros(len(q))])
            self.square, self.far = (self.values**2).sum(1) + base.largest, base.distances(flat)
            # What rounding may add to a bracket of an integer score.
            self.slack = 0.5 + 1e-9 * self.square
        self.owner, self.list, self.id, self.score = (np.zeros(0, np.int64) for _ in range(4))

    def _wanted(self, lower: np.ndarray, upper: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whether distances in a bracket may give a score that a list takes."""
        square, slack = (x[who].reshape(-1, *[1] * (lower.ndim - 1)) for x in (self.square, self.slack))
        best, worst = (square - lower * lower) / 2 + slack, (square - upper * upper) / 2 - slack
        out = np.zeros(lower.shape, bool)
        for k in range(self.low.shape[1]):
            low, high = (x[who, k].reshape(square.shape) for x in (self.low, self.high))
            out |= (best >= low) & (worst <= high) & (low <= high)
        return out

    def meet(self, tile: Tile) -> None:
        who = np.flatnonzero((self.low <= self.high).any(1))
        if len(self.base.pivots) and len(who):
            d = self.far[who]
            lower = np.maximum(np.maximum(tile.least - d, d - tile.most), 0).max(1)
            who = who[self._wanted(lower, (d + tile.most).min(1), who)]
        kind = tile.labels == self.labels[who][:, None]
        kind = (kind & (tile.rids != self.rids[who][:, None])) if self.same else ~kind
        if len(self.base.pivots) and len(who):
            d = self.far[who]
            lower, upper = np.zeros(kind.shape), np.full(kind.shape, np.inf)
            for j in range(d.shape[1]):
                mine, theirs = d[:, j, None], tile.far[:, j]
                np.maximum(lower, np.abs(mine - theirs), out=lower)
                np.minimum(upper, mine + theirs, out=upper)
            kind &= self._wanted(lower, upper, who)
        some, rows = np.flatnonzero(kind.any(1)), np.flatnonzero(kind.any(0))
        if not len(some):
            return
        maybe, who = kind[np.ix_(some, rows)], who[some]
        if self.base.exact:
            score = (self.values[who] @ tile.q[rows].astype(np.float64).T).astype(np.int64)
        else:
            score = self.q[who] @ tile.q[rows].T
        for k in range(self.low.shape[1]):
            takes = maybe & (score >= self.low[who, k, None]) & (score <= self.high[who, k, None])
            self._put(takes, score, who, tile.ids[rows], k)

    def _put(self, takes: np.ndarray, score: np.ndarray, who: np.ndarray, ids: np.ndarray, k: int) -> None:
        """Adds the rows taken to list ``k`` of their anchors and cuts these to the best."""
        many = np.flatnonzero(takes.sum(1) > self.most)
        if len(many):
            # Of many rows only those not below the last that can stay.
            least = np.iinfo(np.int64).min
            last = np.partition(np.where(takes[many], score[many], least), -self.most, axis=1)[:, -self.most]
            takes[many] &= score[many] >= last[:, None]
        a, r = np.nonzero(takes)
        if not len(a):
            return
        touched = who[np.unique(a)]
        held = (self.list == k) & np.isin(self.owner, touched)
        owner, id_, value = (np.concatenate(x) for x in ((self.owner[held], who[a]), (self.id[held], ids[r]), (self.score[held], score[a, r])))
        order = np.lexsort((id_, -value, owner))
        owner = owner[order]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = np.append(begins[1:], len(owner))
        place = np.arange(len(owner)) - np.repeat(begins, ends - begins)
        kept = order[place < self.most]
        full = ends - begins >= self.most
        self.low[owner[begins[full]], k] = value[order[begins[full] + self.most - 1]]
        owner = owner[place < self.most]
        self.owner, self.list = np.concatenate([self.owner[~held], owner]), np.concatenate([self.list[~held], np.full(len(owner), k)])
        self.id, self.score = np.concatenate([self.id[~held], id_[kept]]), np.concatenate([self.score[~held], value[kept]])


FOUND = "anchor_rid long, list int, id long, score long"


def _met(tiled: DataFrame, anchors: DataFrame, base: Table, blocks: int, same: bool, most: int) -> DataFrame:
    """``FOUND`` rows of every block against every tile: each task's best of each list.

    ``anchors`` (block, rows) has rows of rid, label, q, low and high."""

    def tile(row: dict) -> Tile:
        n = len(row["rids"])
        return Tile(row["rids"], row["ids"], row["labels"], row["q"].reshape(n, base.dim), row["far"].reshape(n, -1), row["least"], row["most"])

    def start(rows: pa.StructArray) -> Block:
        rid, label, q, low, high = (rows.field(c) for c in ("rid", "label", "q", "low", "high"))
        lists = max(1, int(np.diff(low.offsets.to_numpy()).max()))
        held = np.diff(low.offsets.to_numpy())
        limits = []
        for values, absent in ((low, 1), (high, 0)):  # an anchor with fewer lists takes nothing for the others
            out = np.full((len(held), lists), absent, np.int64)
            out[np.arange(lists) < held[:, None]] = values.flatten().to_numpy()
            limits.append(out)
        return Block(base, rid.to_numpy(), label.to_numpy(), padded(q, base.dim), *limits, same, most)

    def out(block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block.rids[block.owner]), pa.array(block.list.astype(np.int32)), pa.array(block.id), pa.array(block.score)], names=["anchor_rid", "list", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[int, Block] = {}
        names = ("rids", "ids", "labels", "q", "far", "least", "most")
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            for i, number in enumerate(batch.column("block").to_pylist()):
                if number not in live:
                    if len(live) >= BLOCKS:
                        yield out(live.pop(next(iter(live))))  # lists of one block may come in parts
                    live[number] = start(batch.column("rows").slice(i, 1).flatten())
                live[number].meet(tile({n: c[i].values.to_numpy(zero_copy_only=False) for n, c in columns.items()}))
        for block in live.values():
            yield out(block)

    if blocks <= BLOCKS:
        every = tiled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        joined = every.join(F.broadcast(anchors), "block")
    else:
        stripes = max(1, math.ceil(tiled.count() / STRIPE))
        stripe = F.pmod(F.xxhash64(F.get("rids", F.lit(0))), F.lit(stripes))
        every = tiled.withColumn("stripe", stripe).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        many = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
        joined = every.hint("merge").join(many, ["block", "stripe"])
    return joined.mapInArrow(run, FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor_rid", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    ``anchor`` says which rows are anchors; without it those whose id ``EVERY`` divides."""
    vectors = stored(quantised(rows))
    base = pivot_table(vectors, pivots)
    tiled = stored(tiles(vectors, base))
    asked = vectors.where(F.col("vec_id") % EVERY == 0 if anchor is None else anchor)
    blocks = max(1, math.ceil(asked.count() / base.tile))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))

    def in_blocks(of: DataFrame) -> DataFrame:
        return of.groupBy("block").agg(F.collect_list(F.struct("rid", "label", "q", "low", "high")).alias("rows"))

    any_score = numbered.withColumn("low", F.array(F.lit(-(2**63)).cast("long"))).withColumn("high", F.array(F.lit(FAR).cast("long")))
    near = stored(_best(_met(tiled, in_blocks(any_score), base, blocks, True, positives), positives).select(F.col("anchor_rid").alias("rid"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Limits in whole numbers: LOW * p <= 100 * n <= HIGH * p.
    scores = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    share = lambda p, n: p["positive_score"].cast("decimal(20,0)") * F.lit(n) / F.lit(100)
    limits = scores.select("rid", F.transform("p", lambda p: F.ceil(share(p, LOW)).cast("long")).alias("low"), F.transform("p", lambda p: F.floor(share(p, HIGH)).cast("long")).alias("high"))
    taken = _best(_met(tiled, in_blocks(numbered.join(limits, "rid")), base, blocks, False, negatives), negatives)
    named = near.join(asked.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(F.col("rid").alias("anchor_rid"), (F.col("place") - 1).alias("list"), "anchor_id", "positive_id", "positive_score")
    return taken.join(named, ["anchor_rid", "list"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels moved by one where 7 divides the id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


OP13_SQL = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_dot_product(a.q, x.q)::BIGINT AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
