"""Near-duplicate removal for the corpus pipeline: bit-sliced SimHash of five-word shingles.

Each text has a 512-bit SimHash of its distinct shingles, whose Hamming
distance estimates the similarity of two shingle sets (at 0.8 within 0.02), and
``BANDS`` block keys of ``ROWS`` least hashes each, of which two texts at that
similarity share one but in 2 of 10,000 cases. Texts with the same set of
shingles count as one from the start. Within a block every text is held
against all others by ``simhash``'s comparison: bit planes, carry-save
counters, blocks given up. Texts within ``WIDE`` bits are candidates, which a
pair at the similarity exceeds in 3 of 100,000 cases; a block gives one link
for each text to the first of its group, never all pairs. The components of
these links only say which texts to hold against each other: within one, two
texts are linked where the exact similarity of their shingle sets is
``SIMILARITY`` at least. Groups are the components of the exact links; the
least doc_id of each stays.

Large blocks and large components are dealt to tasks in parts. Whatever is
linked to the first text of a block needs no more comparison within it, as it
is one group already; only the rest is held against all parts. So a group of
near copies, however large, costs what its rows cost, and only rows of many
unlike texts under one key cost the product of their parts.

Cases: null and empty texts are one group. Very long texts are compared whole,
with all their shingles. Rows that share a doc_id are one
document, of which one row stays: that with the least hash of its text, and of
all columns then. Rows without an id are compared to none and all stay. Ties
go to the least doc_id. Other columns are kept, whatever their names. An empty
table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW, bounded, few, in_batches, stored
from tessera.llm.components import components
from tessera.llm.packing import spread
from tessera.llm.shingles import shingle_sets
from tessera.llm.simhash import bits_of, linked, majority, pair_lanes

SHINGLE, SIMILARITY = 5, 0.8
WORDS, BANDS, ROWS = 8, 12, 3
#: Differing bits to expect at SIMILARITY: the angle between two sets of one size, over pi, of all bits.
RADIUS = round(64 * WORDS * math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi)
#: Four standard errors of that number more: pairs to be compared exactly.
WIDE = math.ceil(RADIUS + 4 * math.sqrt(RADIUS * (1 - RADIUS / (64 * WORDS))))
BLOCK = 4_000
PART, PART_BYTES = 4_000, 8 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


MIX, PERMUTE = _odd(WORDS, 5), _odd(BANDS * ROWS, 6)


@in_batches
def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp array<long>, keys array<long>, size); ``same`` is equal for equal sets of
    shingles, ``size`` has the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), SHINGLE)
            n = len(sets)
            full = np.array([len(s) for s in sets], np.int64)
            counts = np.maximum(full, 1)
            hashes = np.concatenate([s if len(s) else np.zeros(1, np.uint64) for s in sets])
            start = np.cumsum(counts) - counts
            fps = np.stack([majority((x := hashes * m) ^ x >> np.uint64(29), counts) for m in MIX], 1)
            least = np.stack([np.minimum.reduceat(hashes * m, start) for m in PERMUTE], 1).reshape(n, BANDS, ROWS)
            keys = least[:, :, 0].copy()
            for r in range(1, ROWS):
                keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + least[:, :, r]
            same = [f"{int(a):x}.{int(b):x}.{int(c):x}" for a, b, c in zip(full, np.add.reduceat(hashes, start), np.bitwise_xor.reduceat(hashes * MIX[0], start), strict=True)]
            lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel().view(np.int64)), a.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same), lists(fps), lists(keys), batch.column("size")], names=["doc_id", "same", "fp", "keys", "size"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = kept.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return sized.mapInArrow(run, "doc_id long, same string, fp array<long>, keys array<long>, size long")


def _fps(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def _block_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (band, key, part, other, doc_id, fp) sorted by block; a block may span batches."""

    def links(tags: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], (tags[1:] != tags[:-1]).any(1)])) if len(ids) else np.zeros(0, np.int64)
        sizes = np.diff(cuts, append=len(ids))
        twos = cuts[sizes == 2]
        ok = pair_lanes(fps[twos], fps[twos + 1], radius)
        u, v = [ids[twos + 1][ok]], [ids[twos][ok]]
        for at, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            root, mine = linked(bits_of(fps[at : at + n]), radius), ids[at : at + n]
            on = root != np.arange(n)
            u.append(mine[on])
            v.append(mine[root[on]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    rest = [np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64)]
    for batch in batches:
        new = [np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "part", "other")], 1), batch.column("doc_id").to_numpy(), _fps(batch.column("fp"))]
        tags, ids, fps = (np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(ids):
            continue
        before = np.flatnonzero((tags != tags[-1]).any(1))
        cut = int(before[-1]) + 1 if len(before) else 0
        yield links(tags[:cut], ids[:cut], fps[:cut])
        rest = [tags[cut:], ids[cut:], fps[cut:]]
    yield links(*rest)


def _dealt(rows: DataFrame, block: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` sorted by block, with columns part and other: the tile.

    ``hot`` (block, loose, tight) has the parts of large blocks, and ``rows`` says in ``bound`` which are linked to
    the block's first: such rows meet the loose parts only, loose ones all parts. A block without any loose row
    has no tile."""
    tags = [*block, "part", "other"]
    if hot is None:
        placed = rows.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    else:
        spot, none = F.xxhash64("doc_id"), F.array().cast("array<int>")
        loose, tight = F.coalesce("loose", F.lit(1)), F.coalesce("tight", F.lit(0))
        mine = F.when(F.col("bound"), loose + F.pmod(spot, F.greatest(tight, F.lit(1)))).otherwise(F.pmod(spot, F.greatest(loose, F.lit(1)))).cast("int")
        every = F.sequence(F.lit(0), loose + tight - 1)
        others = F.when(loose == 0, none).when(loose + tight == 1, F.array(F.lit(0))).when(F.col("bound"), F.sequence(F.lit(0), loose - 1)).otherwise(F.filter(every, lambda q: q != F.col("mine")))
        tiles = rows.join(few(hot), block, "left").withColumn("mine", mine).select(*rows.columns, "mine", F.explode(others).alias("to"))
        placed = tiles.select(*rows.columns, F.least("mine", "to").alias("part"), F.greatest("mine", "to").alias("other"))
    return placed.drop("bound").repartition(*tags).sortWithinPartitions(*tags, "doc_id")


def _far(a: str, b: str) -> Column:
    """Differing bits of two fingerprints."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)]
    return reduce(Column.__add__, bits)


@in_batches
def block_links(distinct: DataFrame, radius: int = WIDE, block: int = BLOCK) -> DataFrame:
    """(u, v) from rows (doc_id, fp, keys): texts that blocks link, each to the first of its group there."""
    by = ["band", "key"]
    rows = distinct.select("doc_id", "fp", F.posexplode("keys").alias("band", "key"))
    large = stored(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*by))
    links = partial(_block_links, radius=radius)
    if large.isEmpty():
        return _dealt(rows, by, None).mapInArrow(links, "u long, v long")
    firsts = stored(rows.join(few(large), by).groupBy(*by).agg(F.min("doc_id").alias("first"), F.min_by("fp", "doc_id").alias("first_fp")))
    flagged = rows.join(few(firsts, FEW // 16), by, "left").withColumn("bound", F.coalesce(_far("fp", "first_fp") <= radius, F.lit(False)))
    parts = lambda cond: F.ceil(F.count_if(cond) / block).cast("int")
    hot = stored(flagged.where("first is not null").groupBy(*by).agg(parts(~F.col("bound")).alias("loose"), parts(F.col("bound")).alias("tight")))
    stars = flagged.where("bound and doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    return stars.unionByName(_dealt(flagged.drop("first", "first_fp"), by, hot).mapInArrow(links, "u long, v long"))


def alike(sets: list[np.ndarray], fps: np.ndarray, radius: int) -> np.ndarray:
    """For each sorted set, the first of its group: pairs within ``radius`` whose exact similarity suffices join groups."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    free, root = np.ones(n, bool), np.arange(n)
    for first in range(n):
        if not free[first]:
            continue
        free[first], todo = False, [first]
        for i in todo:
            rest = np.flatnonzero(free)
            rest = rest[np.minimum(size[rest], size[i]) >= SIMILARITY * np.maximum(size[rest], size[i])]
            rest = rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(1, dtype=np.int64) <= radius]
            if not len(rest) or not size[i]:
                continue
            theirs = flat[spread(start[rest], size[rest])]
            hit = sets[i][np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)] == theirs
            common = np.add.reduceat(hit, np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            more = rest[common >= SIMILARITY * (size[rest] + size[i] - common)]
            free[more] = False
            todo += more.tolist()
        root[todo] = first
    return root


def _exact_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (label, part, other, doc_id, fp, text) sorted by the first three; a tile may span batches."""

    def links(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            tile = rows.slice(at, end - at).combine_chunks()
            ids, fps = tile.column("doc_id").to_numpy(), np.concatenate([_fps(c) for c in tile.column("fp").chunks])
            root = alike(shingle_sets(tile.column("text").to_pylist(), SHINGLE), fps, radius)
            on = root != np.arange(len(ids))
            u.append(ids[on])
            v.append(ids[root[on]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*rest, batch])
        tags = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("label", "part", "other")], 1)
        cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(1)) + 1).tolist()]
        yield links(rows, cuts)
        rest = rows.slice(cuts[-1]).to_batches()
    if rest:
        rows = pa.Table.from_batches(rest)
        yield links(rows, [0, rows.num_rows])


@in_batches
def exact_links(docs: DataFrame, members: DataFrame, radius: int = WIDE, part: int = PART) -> DataFrame:
    """(u, v) from ``docs`` (doc_id, text) and their components ``members`` (doc_id, size, fp, label): texts of exact similarity.

    Each part of a large component is held against itself and the component's first text; what isn't linked to
    that one then meets all other parts."""
    n_parts = lambda n, size: F.ceil(F.greatest(n / part, size / PART_BYTES)).cast("int")
    large = stored(members.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first")).select("label", "first", n_parts(F.col("n"), F.col("bytes")).alias("parts")).where("parts > 1"))
    links = partial(_exact_links, radius=radius)
    texts = lambda of: docs.join(few(of, FEW // 16), "doc_id").select("label", "doc_id", "fp", "text", *[c for c in of.columns if c in ("part", "bound")])
    own = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    dealt = members.join(few(large), "label", "left").select("label", "doc_id", "fp", own.alias("part"))
    tags = ["label", "part", "other"]
    alone = texts(dealt).withColumn("part", F.explode("part")).withColumn("other", F.col("part")).repartition(*tags).sortWithinPartitions(*tags, "doc_id")
    within = alone.mapInArrow(links, "u long, v long")
    if large.isEmpty():
        return within
    within = stored(within)
    bound = within.join(few(large.select(F.col("first").alias("v"))), "v", "left_semi").select(F.col("u").alias("doc_id")).distinct()
    firsts = large.select(F.col("first").alias("doc_id"))
    flagged = stored(members.join(few(large.select("label")), "label").join(bound.union(firsts).withColumn("bound", F.lit(True)), "doc_id", "left").withColumn("bound", F.coalesce("bound", F.lit(False))))
    counts = lambda cond: n_parts(F.count_if(cond), F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0)))
    hot = stored(flagged.groupBy("label").agg(counts(~F.col("bound")).alias("loose"), counts(F.col("bound")).alias("tight")).where("loose > 0"))
    rest = texts(flagged.join(few(hot.select("label")), "label", "left_semi").select("label", "doc_id", "fp", "bound"))
    return within.unionByName(_dealt(rest, ["label"], hot).mapInArrow(links, "u long, v long"))


def one_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): the rows of ``docs`` whole, one for each doc_id and all without one.

    Ids that repeat are found on the ids alone; only their rows are gathered, by partial minima."""
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    twice = stored(packed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return packed
    again = packed.join(few(twice), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "row"), F.struct(F.xxhash64("text"), F.xxhash64("row"))).alias("kept")).select("doc_id", "kept.*")
    return packed.join(few(twice), "doc_id", "left_anti").unionByName(again)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = WIDE, block: int = BLOCK) -> DataFrame:
    """(doc_id, group) of the documents that have near-duplicates: the group is the least doc_id in it."""
    return _groups(one_of_each(docs, id_col, text_col), radius, block)


def _groups(rows: DataFrame, radius: int = WIDE, block: int = BLOCK) -> DataFrame:
    named = rows.where("doc_id is not null").select("doc_id", "text")
    signed = stored(signatures(named))
    # Written first, so that the join may split the rows of one large group of copies.
    sets = stored(signed.groupBy("same").agg(F.min("doc_id").alias("first")))
    equal = stored(signed.select("doc_id", "same").join(sets, "same").select("doc_id", "first").where("doc_id <> first"))
    # A document is compared unless an equal one comes first.
    distinct = stored(signed.join(few(equal.select("doc_id")), "doc_id", "left_anti").select("doc_id", "fp", "keys", "size"))
    close = components(block_links(distinct.select("doc_id", "fp", "keys"), radius, block)).withColumnRenamed("node", "doc_id")
    members = stored(distinct.join(close, "doc_id").select("doc_id", "size", "fp", "label"))
    exact = exact_links(named, members, radius, min(block, PART))
    label = components(exact.union(equal.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))))
    return label.select(F.col("node").alias("doc_id"), F.col("label").alias("group"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, all columns as they were."""
    rows = one_of_each(docs, id_col, text_col)
    gone = stored(_groups(rows).where(F.col("doc_id") != F.col("group")).select("doc_id"))
    return rows.join(few(gone), "doc_id", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
