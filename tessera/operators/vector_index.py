"""A stored index of vectors: blocks around a centre, of which a question reads those that can matter.

Vectors are dealt to the nearest of some centres, and a centre's vectors to shells by
their angle to it, so a block has a centre and the least and largest angle to it. By
the triangle inequality of angles a question's angle to the centre bounds its angle
to every vector of the block, on both sides. The best vectors are looked for in the
blocks of the highest bounds first, and blocks whose bound is below the last score of
the list so far are never read. A row's rank counts the blocks that lie wholly before
it and reads only those that its score lies in. All results are those of a full scan.

Centres are fitted on at most ``SAMPLE`` vectors, those of least hashed ids, by a few
rounds of means; every vector is in a block, wherever the centres are. Where vectors
are spread evenly over many dimensions all angles are near a right one and most
blocks have to be read: the worst case is a full scan and the jobs that found it out.

Zero vectors have no angle and no score above 0, so they are in no block. Null vectors
are left out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles
from tessera.operators import retrieval as R

SAMPLE, CENTRES, ROUNDS = 4096, 256, 8
BLOCK, SHELLS = 512, 16
FIRST = 16
SLACK = 1e-7


def directions(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def fitted(sample: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of directions: each chosen far from those before, then moved to the mean of its own."""
    points = directions(sample)
    chosen, near = [0], np.full(len(points), -np.inf)
    while len(chosen) < min(centres, len(points)):
        near = np.maximum(near, points @ points[chosen[-1]])
        chosen.append(int(near.argmin()))
    out = points[chosen]
    for _ in range(rounds):
        owner = (points @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, owner, points)
        filled = np.linalg.norm(sums, axis=1) > 0
        out[filled] = directions(sums[filled])
    return out


def centres_of(vectors: DataFrame, sample: int = SAMPLE, centres: int = CENTRES) -> np.ndarray:
    """Centres fitted on a bounded sample: about one for each four blocks' worth of vectors, ``centres`` at most."""
    kept = vectors.where("vector is not null")
    n = kept.count()
    rows = kept.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    points = np.array([r.vector for r in rows], np.float64)
    points = points[np.linalg.norm(points, axis=1) > 0]
    return fitted(points, max(1, min(centres, math.ceil(n / (4 * BLOCK)), len(points) // 4 or 1))) if len(points) else np.zeros((0, 0))


def _placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Vectors with the place of their centre and their angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
            near = directions(flat) @ centres.T
            cell = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kept = vectors.where(F.exists("vector", lambda x: x != 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, cell int, angle double")


def blocks(vectors: DataFrame, centres: np.ndarray, size: int = BLOCK, shells: int = SHELLS) -> DataFrame:
    """(block, cell, n, least, most, rows) of (chunk_id, vector) and, where it is there, source_id.

    A block's number is made of its centre, shell and part. A shell of over ``size`` vectors is dealt to parts, so a block has about as many, also where a third of all are equal."""
    columns = [c for c in ("chunk_id", "source_id", "vector") if c in vectors.columns]
    if not len(centres):
        none = F.lit(0).cast("long")
        return vectors.where("false").select(none.alias("block"), F.lit(0).alias("cell"), none.alias("n"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"), F.array(F.struct(*columns)).alias("rows"))
    placed = _placed(vectors.select(*columns), centres).withColumn("shell", F.floor(F.col("angle") / math.pi * (2 * shells)).cast("int"))
    # A row for each centre and shell: a bounded number.
    counts = placed.groupBy("cell", "shell").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    number = (F.col("cell") * (2 * shells + 1) + F.col("shell")).cast("long") * F.lit(1 << 40) + part
    dealt = placed.join(F.broadcast(counts), ["cell", "shell"]).withColumn("block", number).repartitionByRange("block")
    made = dealt.groupBy("block").agg(F.first("cell").alias("cell"), F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"), F.collect_list(F.struct(*columns)).alias("rows"))
    return made.sortWithinPartitions("block")


@dataclass
class VectorIndex:
    """Blocks and centres, and what changed since: vectors put in, and the sources whose vectors in the blocks are gone."""

    blocks: DataFrame
    centres: np.ndarray
    put: DataFrame | None = None
    gone: DataFrame | None = None

    def channel(self, query: list[float], eligible: DataFrame | None = None) -> Channel:
        return Channel(self, [float(x) for x in query], eligible)


@dataclass
class Channel:
    """A question to an index: the best rows, ranks and counts, as ``retrieval.Scan`` gives them from all vectors."""

    index: VectorIndex
    query: list[float]
    eligible: DataFrame | None = None
    #: What the last ``top`` ended with: the bound that a block had to reach, and the blocks read before it was known.
    least: float = field(default=0.0, compare=False)
    first: list[Row] = field(default_factory=list, compare=False)

    def __post_init__(self):
        q = directions(np.array([self.query]))
        cos = np.clip(q @ self.index.centres.T, -1, 1)[0] if len(self.index.centres) else np.zeros(0)
        self.angles = np.arccos(cos).tolist()

    def _heads(self) -> DataFrame:
        """Blocks with the least and largest cosine that their vectors may have; no vector is read."""
        return self._bounded().select("block", "n", "high", "low")

    def _bounded(self) -> DataFrame:
        angle = F.element_at(doubles(self.angles), F.col("cell") + 1) if self.angles else F.lit(0.0)
        near = F.greatest(F.lit(0.0), angle - F.col("most"), F.col("least") - angle)
        far = F.least(F.lit(math.pi), angle + F.col("most"))
        return self.index.blocks.withColumn("high", F.cos(near) + SLACK).withColumn("low", F.cos(far) - SLACK)

    def _vectors(self, some: DataFrame) -> DataFrame:
        rows = some.select(F.inline("rows"))
        return rows if self.index.gone is None else rows.join(self.index.gone, "source_id", "left_anti")

    def _scored(self, vectors: DataFrame) -> DataFrame:
        """(chunk_id, semantic) above 0; here ``eligible`` comes in."""
        if self.eligible is not None:
            vectors = vectors.join(self.eligible, "source_id", "left_semi")
        return R.semantic_scores(vectors, self.query)

    def _of(self, heads: list[Row]) -> DataFrame:
        """The blocks of a short list, by a filter that the scan takes."""
        return self.index.blocks.where(F.col("block").isin([h.block for h in heads]) if heads else F.lit(False))

    def _within(self, heads: DataFrame) -> DataFrame:
        """The vectors of some blocks, and those put in since."""
        some = self._vectors(heads)
        return some if self.index.put is None else some.unionByName(self.index.put.select(*some.columns))

    def top(self, n: int) -> list[Row]:
        """The best ``n`` (chunk_id, semantic), ties to the least chunk_id."""
        heads = self._heads().where("high > 0")
        first = heads.orderBy(F.desc("high"), "block").limit(FIRST).collect()
        some = self._vectors(self._of(first))
        if self.index.put is not None:
            some = some.unionByName(self.index.put.select(*some.columns))
        best = R.top(self._scored(some), "semantic", n)
        least = best[-1].semantic if len(best) == n else 0.0
        if len(first) < FIRST or first[-1].high < least:
            self.least, self.first = least, first
            return best
        known = F.col("block").isin([h.block for h in first])
        self.least, self.first = least, first
        # A block's bound is a matter of its own row, so the scan filters by it before it unpacks any vector.
        rest = self._vectors(self._bounded().where((F.col("high") >= least) & ~known))
        return sorted([*best, *R.top(self._scored(rest), "semantic", n)], key=lambda r: (-r.semantic, r.chunk_id))[:n]

    def _every(self) -> DataFrame:
        rows = self._vectors(self.index.blocks)
        return rows if self.index.put is None else rows.unionByName(self.index.put.select(*rows.columns))

    def scores_of(self, ids: list) -> list[Row]:
        """(chunk_id, semantic) of the ids that score above 0."""
        return self._scored(self._every().where(F.col("chunk_id").isin(*ids))).select("chunk_id", "semantic").collect()

    def ranks_of(self, rows: list[Row]) -> list[int]:
        """Each row's rank. Blocks that lie wholly above or below every row's score are counted, or passed over, unread."""
        if not rows:
            return []
        whole = self.index.gone is None and self.eligible is None
        heads = self._bounded().where(F.col("high") > 0)
        ahead = doubles(r.semantic for r in rows)  # best first
        # The rows that all of a block lies before, and those that some of it may.
        sure = F.size(F.filter(ahead, lambda s: s < F.col("low"))) if whole else F.lit(0)
        open_ = F.size(F.filter(ahead, lambda s: s <= F.col("high")))
        parted = heads.withColumn("sure", F.when(F.col("low") > 0, sure).otherwise(0)).withColumn("open", open_)
        # Both by the range between asked rows: each asked row counts itself where its block is read.
        unread = parted.where("sure = open and sure > 0").select((F.lit(len(rows)) - F.col("sure")).alias("at"), "n")
        read = self._scored(self._within(parted.where("sure < open"))).select(R.rows_before("semantic", rows).alias("at"), F.lit(1).cast("long").alias("n"))
        return R.ranks_from(unread.unionByName(read), len(rows))

    def count(self) -> int:
        """How many vectors score above 0."""
        if self.index.gone is None and self.eligible is None:
            heads = self._bounded()
            sure = heads.where("low > 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            return sure + self._scored(self._within(heads.where("low <= 0 and high > 0"))).count()
        return self._scored(self._every()).count()

    def share_read(self) -> float:
        """The share of blocks that the last ``top`` read."""
        known = F.col("block").isin([h.block for h in self.first])
        c = self._heads().agg(F.count("*").alias("n"), F.count_if(known | ((F.col("high") > 0) & (F.col("high") >= self.least))).alias("read")).first()
        return c.read / c.n if c.n else 0.0
