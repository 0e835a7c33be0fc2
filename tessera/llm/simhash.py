"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where over half the 64-bit hashes of its
shingles do. Fingerprints link at ``radius`` or fewer differing bits. Distinct
fingerprints are dealt to blocks that agree on all but ``radius`` of eight
bytes, which every linked pair shares for some choice of bytes; as a block
leaves 16 bits free at radius 2, it holds 65,536 fingerprints at most, however
large a group of near copies is. Within a block the free bits are stored
vertically, a plane for each bit, and one fingerprint is held against 64 of the
block in each machine word: carry-save counters add up the differing planes,
and the block is given up once every lane exceeds the radius. Only links along
a block's groups leave it, never all pairs.

Cases: a null text, or one without words, has fingerprint zero and is linked
like any other. Texts of fewer words than a shingle hash the whole sequence.
Very long texts are hashed whole; their shingles' hashes, 8 bytes each and about
30 times the text in passing, are in memory at once.
Equal texts and repeated rows share a fingerprint and so a component. Other
columns are ignored, whatever their names. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, stored, table
from tessera.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Hashes added up in one go; the counters below have 16 bits.
RUN = 1 << 15
AT_ONCE = 1 << 17
PIECES = 8


def _lanes() -> np.ndarray:
    """For each byte, its eight bits in 16-bit lanes of two words, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint16)
    return np.ascontiguousarray(bits).view(np.uint64)


LANES = _lanes()


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    runs = zip(*(words[i:] for i in range(shingle)), strict=False)
    return list(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, runs)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes; ``counts`` has their sizes.

    ``AT_ONCE`` hashes are spread into lanes at a time, 128 bytes each."""
    out = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    begins = np.unique(np.concatenate([ends - counts, np.arange(0, len(hashes), RUN)]))
    begins = begins[begins < len(hashes)]
    owner = np.searchsorted(ends, begins, side="right")
    limits = [*begins.tolist(), len(hashes)]
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(begins, limits[at] + AT_ONCE)))
        part = np.ascontiguousarray(hashes[limits[at] : limits[to]])
        wide = LANES[part.view(np.uint8).reshape(-1, 8)].reshape(len(part), 16)
        np.add.at(out, owner[at:to], np.add.reduceat(wide, begins[at:to] - limits[at], axis=0).view(np.uint16).astype(np.int64))
        at = to
    bits = (out * 2 > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


@in_batches
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp), the fingerprint's bits in a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            found = [shingle_hashes(t, shingle, seed) for t in batch.column("text").to_pylist()]
            counts = np.array([len(x) for x in found], np.int64)
            hashes = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(hashes, counts).view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def bits_of(values: np.ndarray) -> np.ndarray:
    """A row of bits, lowest first, for each fingerprint of one or more 64-bit words."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def planes(bits: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bit planes: a packed word array for each bit in which the rows differ."""
    pad = -len(bits) % 64
    live = np.flatnonzero(bits.any(0) & ~bits.all(0))
    return [(int(b), np.packbits(np.pad(bits[:, b], (0, pad)), bitorder="little").view(np.uint64)) for b in live]


class Counter:
    """Vertical counters, a lane for each bit of a word, that stick above ``radius``.

    Digits begin at a bias from which ``radius`` + 1 overflow the highest. Planes
    of a digit wait for a second one, so that a full adder takes both and carries
    one on: about five word operations a plane, whatever the number of digits."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.n = radius.bit_length()
        bias, ones = (1 << self.n) - 1 - radius, ~np.uint64(0)
        self.digits = [np.full(shape, ones if bias >> i & 1 else 0, np.uint64) for i in range(self.n)]
        self.waiting: list[np.ndarray | None] = [None] * self.n
        self.over = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        while level < self.n:
            first, digit = self.waiting[level], self.digits[level]
            if first is None:
                self.waiting[level] = plane
                return
            self.waiting[level], either = None, first ^ plane
            self.digits[level], plane = digit ^ either, (first & plane) | (either & digit)
            level += 1
        self.over |= plane

    def exceeds(self) -> np.ndarray:
        """Lanes above the radius so far, with all that waits added in."""
        for level in range(self.n):
            if (plane := self.waiting[level]) is not None:
                self.waiting[level] = None
                self.digits[level], carry = self.digits[level] ^ plane, self.digits[level] & plane
                self.add(carry, level + 1)
        return self.over


def near(sliced: list[tuple[int, np.ndarray]], bits: np.ndarray, lanes: int, radius: int, pause: int = 8) -> np.ndarray:
    """Which of ``lanes`` rows are within ``radius`` of any of the given rows of bits.

    The block is given up for them once every lane exceeds the radius, which is
    looked at every ``pause`` planes."""
    ones = ~np.uint64(0)
    flip = np.where(bits, ones, np.uint64(0))
    count = Counter((len(bits), (lanes + 63) // 64), radius)
    for done, (bit, plane) in enumerate(sliced):
        count.add(plane ^ flip[:, bit, None])
        if done >= radius and done % pause == pause - 1 and (count.exceeds() == ones).all():
            break
    within = np.bitwise_or.reduce(~count.exceeds(), axis=0)
    return np.unpackbits(within.view(np.uint8), bitorder="little").view(bool)[:lanes]


def linked(bits: np.ndarray, radius: int, at_once: int = 64) -> np.ndarray:
    """For each row of a block, the first row of its linked group; every row is held against the block once."""
    n = len(bits)
    sliced, free, root = planes(bits), np.ones(n, bool), np.arange(n)
    for first in range(n):
        if not free[first]:
            continue
        free[first], todo, done = False, [first], 0
        while done < len(todo):
            some = todo[done : done + at_once]
            done += len(some)
            more = np.flatnonzero(near(sliced, bits[some], n, radius) & free)
            free[more] = False
            todo += more.tolist()
        root[todo] = first
    return root


def groups(values: np.ndarray, radius: int) -> np.ndarray:
    """For sorted distinct ``values`` of a block, the least value of each one's linked group."""
    return values[linked(bits_of(values), radius)]


def pair_lanes(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] lie within ``radius``: many blocks of two at once, a lane for each."""
    if not len(a):
        return np.zeros(0, bool)
    bits, pad = bits_of(a ^ b), -len(a) % 64
    count = Counter(((len(a) + pad) // 64,), radius)
    for i in np.flatnonzero(bits.any(0)):
        count.add(np.packbits(np.pad(bits[:, i], (0, pad)), bitorder="little").view(np.uint64))
    return np.unpackbits((~count.exceeds()).view(np.uint8), bitorder="little").view(bool)[: len(a)]


def _block_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (choice, shared, fp) sorted so; a block may span batches."""

    def links(c: np.ndarray, s: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])) if len(c) else np.zeros(0, np.int64)
        sizes = np.diff(cuts, append=len(c))
        twos = cuts[sizes == 2]
        ok = pair_lanes(f[twos], f[twos + 1], radius)
        u, v = [np.maximum(f[twos], f[twos + 1])[ok]], [np.minimum(f[twos], f[twos + 1])[ok]]
        for at, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            root = groups(values := np.sort(f[at : at + n]), radius)
            u.append(values[root != values])
            v.append(root[root != values])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], names=["u", "v"])

    rest = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        c, s, f = (np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(c):
            continue
        other = np.flatnonzero((c != c[-1]) | (s != s[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield links(c[:cut], s[:cut], f[:cut])
        rest = [c[cut:], s[cut:], f[cut:]]
    yield links(*rest)


def block_masks(radius: int = RADIUS, pieces: int = PIECES) -> list[int]:
    """For each choice of ``radius`` bytes, a mask (signed) of the bits of the others."""
    width = 64 // pieces
    full = (1 << 64) - 1
    found = (full & ~sum(((1 << width) - 1) << (p * width) for p in free) for free in combinations(range(pieces), radius))
    return [m - (1 << 64) if m >> 63 else m for m in found]


@in_batches
def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints ``fp`` within ``radius``, directly or on."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    blocks = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "shared"))
    dealt = blocks.select("choice", "shared", "fp").repartition("choice", "shared").sortWithinPartitions("choice", "shared", "fp")
    return dealt.mapInArrow(partial(_block_links, radius=radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the component is the smallest doc_id that links reach."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(fingerprint_links(distinct.select("fp"), radius))
    placed = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    return marked.join(placed.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
