"""Ranked lexical search by sort-based accumulation.

Every document is scored for every item of a stated query set with integer BM25.
One pass over the texts keeps each document's length and its frequencies of the
items' terms; the counts of documents, of terms and of each term's documents are
summed from these. A second pass, over the kept numbers alone, concatenates arrays
of (item, document) keys and impacts for all matched terms, sorts the packed keys by
radix, adds up the impacts of equal keys by ``reduceat`` and keeps the best of an
item in a heap. As a document's terms are all in one task, nothing is shuffled but
these short lists; they are range-partitioned by item and document, so that an
item's lists from many tasks are selected from in parts, and ranked.

The items' terms go to the tasks in slices of at most ``SLICE_BYTES`` (an item is
never cut), each slice being held against all documents, so a query set of any size
has bounded memory.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count
as a-z. Cases: a null or empty text has no terms, is no document of the statistics
and is never found; likewise an item without terms finds nothing. Rows that repeat
a document are documents of their own; rows that repeat an item's id are one item
with the terms of all. A null document id comes after all others of its score; a
null item id is an item like any other. Texts are counted whole, a few megabytes at
a time. Other columns are ignored, whatever their names. Empty tables give no rows."""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, stored, table

TOP = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE_BYTES, TERM_OVERHEAD = 32 << 20, 64
#: Bytes of a text that are cut into words at once; keys that are sorted at once.
STRETCH, AT_ONCE = 4 << 20, 1 << 21
NO_ID = 2**63 - 1

#: What each byte of a text counts as: bytes of terms stay, capitals lower-cased, all others are spaces.
BYTES = bytes(ord(c.lower()) if (c := chr(b)) in string.ascii_letters + string.digits else b if b >= 128 else 32 for b in range(256))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once each."""
    plain = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def frequencies(raw: bytes | None, number: Callable[[bytes], int | None]) -> tuple[int, dict[int, int]]:
    """The number of a text's terms, and the frequency of each that has a number."""
    marked, n, at, found = (raw or b"").translate(BYTES), 0, 0, Counter()
    while at < len(marked):
        end = marked.find(b" ", at + STRETCH)
        words = marked[at : end if end >= 0 else len(marked)].split()
        n, at = n + len(words), end if end >= 0 else len(marked)
        found.update(map(number, words))
    found.pop(None, None)
    return n, found


def counted(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of every document that has a term; ``terms`` are places in the list given."""
    numbers = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            ids, ns, ends, places, tfs = [], [], [0], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, found = frequencies(raw.as_py(), numbers.get)
                if n:
                    places.extend(found)
                    tfs.extend(found.values())
                    ids.append(doc)
                    ns.append(n)
                    ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (places, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, two bytes at a time from the lowest; numpy sorts 16-bit digits by counting."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def added_up(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key, ascending, and the sum of its impacts."""
    if not len(keys):
        return keys, impacts
    order = radix_order(keys)
    keys, impacts = keys[order], impacts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(impacts, begins)


class Best:
    """The best ``most`` rows of each item so far: heaps whose head is the worst row kept."""

    def __init__(self, items: int, most: int = TOP):
        self.most, self.heaps = most, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a score below this can't be kept

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Rows by arrays; of a null id, ``doc`` is NO_ID."""
        some = np.flatnonzero((score >= self.least[item]) & (score > 0))
        if not len(some):
            return
        # Only an item's best of these rows go to its heap.
        order = some[np.lexsort((null[some], doc[some], -score[some], item[some]))]
        owner = item[order]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        order = order[place < self.most]
        for i, s, d, missing in zip(item[order].tolist(), score[order].tolist(), doc[order].tolist(), null[order].tolist(), strict=True):
            heap, row = self.heaps[i], (s, -d, not missing)
            if len(heap) < self.most:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
            if len(heap) == self.most:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        """(item, doc, score) of all that is kept, an item's best first."""
        for i, heap in enumerate(self.heaps):
            for s, d, known in sorted(heap, reverse=True):
                yield i, -d if known else None, s


def _doc_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id")
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


@dataclass
class Slice:
    """A part of the query set: its items and terms, and each term's items as one array with the terms' ends."""

    items: list[int | None]
    terms: list[str]
    begins: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[int | None, str]]) -> Slice:
        items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        terms = sorted({t for _, t in pairs})
        item_no, term_no = {x: n for n, x in enumerate(items)}, {x: n for n, x in enumerate(terms)}
        links = np.array(sorted((term_no[t], item_no[i]) for i, t in pairs), np.int64).reshape(-1, 2)
        return cls(items, terms, np.searchsorted(links[:, 0], np.arange(len(terms) + 1)), links[:, 1])


def candidates(counts: DataFrame, part: Slice, docs: int, words: int, weights: list[int], most: int = TOP) -> DataFrame:
    """(item, doc_id, score): each task's best rows of each item, ``item`` being a place in the slice."""
    begins, owners, weight = part.begins, part.owners, np.array(weights, np.int64)
    fan = np.diff(begins)

    def impacts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each matched term of each document: the document's place, the term and its impact."""
        lists = batch.column("terms")
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        m = 100 - 50 + (50 * batch.column("n").to_numpy() * docs) // words
        return row, term, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(part.items), most)
        for batch in batches:
            row, term, impact = impacts(batch)
            doc, null = _doc_ids(batch)
            # Whole documents, as many as have about AT_ONCE keys; one at least.
            reach = np.concatenate([[0], np.cumsum(fan[term])])
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(reach[starts], reach[starts[at]] + AT_ONCE, side="right")) - 1)
                here = slice(starts[at], starts[to])
                n = fan[term[here]]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                item = owners[np.repeat(begins[term[here]], n) + within]
                keys = (item * (to - at) + np.repeat(row[here] - at, n)).astype(np.uint64)
                found, score = added_up(keys, np.repeat(impact[here], n))
                item, place = np.divmod(found.astype(np.int64), to - at)
                best.offer(item, score, doc[at + place], null[at + place])
                at = to
        yield _arrow(best)

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def _arrow(best: Best) -> pa.RecordBatch:
    rows = list(best.rows())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])


def selected(short: DataFrame, items: int, most: int = TOP) -> DataFrame:
    """The best of candidates dealt out by ranges of item and document, an item's part in each range by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, most)
        for batch in batches:
            doc, null = _doc_ids(batch)
            best.offer(batch.column("item").to_numpy().astype(np.int64), batch.column("score").to_numpy(), doc, null)
        yield _arrow(best)

    return short.repartitionByRange("item", "doc_id").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, most: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``most`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    pairs = stored(item_terms(items))
    total = pairs.agg(F.sum(F.octet_length("term") + TERM_OVERHEAD)).first()[0] or 0
    slices = max(1, math.ceil(total / slice_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(slices):
        mine = pairs.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(slices)) == number)
        part = Slice.of([(r.item_id, r.term) for r in mine.collect()])  # at most about slice_bytes
        if not part.items:
            continue
        counts = stored(counted(docs, part.terms))
        # -1 stands for the document itself: its count is N and the sum of its lengths L.
        sums = counts.select(F.explode(F.array_append("terms", F.lit(-1))).alias("term"), "n").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("words"))
        known = {r.term: (r.df, r.words) for r in sums.collect()}
        n, words = known.get(-1, (0, 0))
        if not n:
            continue
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * known.get(t, (0, 0))[0] + 1))) for t in range(len(part.terms))]
        short = stored(candidates(counts, part, n, words, weights, most))
        numbers = spark.createDataFrame(list(enumerate(part.items)), "item int, item_id long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = selected(short, len(part.items), most).withColumn("rank", rank).where(F.col("rank") <= most)
        out = out.unionByName(ranked.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(of: str) -> str:
    return f"regexp_extract_all(translate({of}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"


OP12_SQL = f"""WITH i AS (SELECT DISTINCT item_id, unnest({_terms_sql("text")}) AS term FROM benchmark),
d AS (SELECT doc_id, {_terms_sql("text")} AS words FROM documents),
lengths AS (SELECT doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
ws AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, docs),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part FROM tfs JOIN ws USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM i JOIN parts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}"""
