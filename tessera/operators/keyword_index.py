"""A stored keyword index: the postings of each term, in blocks that say how high they can score.

``packed(source_id, chunk_id, dl, terms, tfs)`` has a row for each passage, also for one
without words. It is kept by source_id, like the passages, so that a change brings its own
postings and names the sources whose earlier ones are gone. ``postings(source_id, chunk_id,
term, tf, dl)`` are the same with a row for each term, and one with the empty term.

``blocks`` are made from packed postings: passages of about one length are dealt to ranges of
about ``RANGE``, and a block is what a term has in a range: its passages as an array, the largest
frequency, the least length and the largest saturation, sorted by term and range within a file.
For a question, the bounds of its terms' blocks add up to a bound of each range;
ranges are read by their bounds, the highest first, and those whose bound is below
the last score of the list so far are never read. Rare terms weigh most, so their
ranges come first. The list is exact: bounds hold for every passage, at whatever
average length the library has since.

What changed after the blocks were made is read as it is: new postings are scored
one by one, and passages of sources that changed are left out of the blocks.

Nulls: a null text has no words. Repeated chunk_ids are the caller's fault, as in
the store. An empty table has no postings and no scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.operators.retrieval import K1, B, idf, saturation, top

RANGE = 32
#: Words of a task that makes blocks, and blocks that it passes on at once.
TASK, BATCH = 1 << 21, 1 << 15
#: Ranges that are read first, and ranges whose numbers come to the driver.
FIRST, LISTED = 64, 1024
#: What rounding may take from a bound.
NEARLY = 1.0 - 1e-9


def _runs(words: Column) -> Column:
    """The runs of equal words of a sorted array, as (first place, word)."""
    begins = lambda w, i: F.when((i == 0) | (F.get(words, i - 1) != w), F.struct(i.alias("at"), w.alias("word")))
    return F.filter(F.transform(words, begins), lambda r: r.isNotNull())


def packed(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id, dl, terms, tfs): a row for each passage, counted within its row, so nothing is shuffled.

    Terms are one text with spaces between, which takes half of an array's bytes in a shuffle."""
    lower = F.lower("text")
    plain = F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(T.fold(lower))
    words = F.sort_array(F.coalesce(T.tokens(plain), F.array().cast("array<string>")))

    def counted(words: Column) -> Column:
        lengths = lambda runs: F.transform(runs, lambda r, k: (F.coalesce(F.get(runs, k + 1)["at"], F.size(words)) - r["at"]).cast("int"))
        return T.let(_runs(words), lambda runs: F.struct(F.size(words).cast("long").alias("dl"), F.array_join(F.transform(runs, lambda r: r["word"]), " ").alias("terms"), lengths(runs).alias("tfs")))

    return chunks.select("source_id", "chunk_id", T.let(words, counted).alias("c")).select("source_id", "chunk_id", "c.dl", "c.terms", "c.tfs")


def unpacked(rows: DataFrame) -> DataFrame:
    """A row for each term of packed postings, and one with the empty term."""
    # Without terms the text is empty, and its split is the empty term.
    terms = F.when(F.col("terms") == "", F.array(F.lit(""))).otherwise(F.split(F.concat("terms", F.lit(" ")), " "))
    pairs = F.arrays_zip(terms.alias("term"), F.array_append("tfs", F.lit(1)).alias("tf"))
    split = rows.select("source_id", "chunk_id", "dl", F.inline(pairs))
    return split.select("source_id", "chunk_id", "term", F.col("tf").cast("long").alias("tf"), "dl")


def postings(chunks: DataFrame) -> DataFrame:
    """The postings of ``chunks``, a row for each term of a passage."""
    return unpacked(packed(chunks))


def statistics(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """(bucket, n, words) of postings that have a column ``bucket``."""
    return rows.where("term = ''").groupBy(bucket).agg(F.count("*").alias("n"), F.sum("dl").alias("words"))


def totals(rows: DataFrame) -> DataFrame:
    """One row (n, words) of packed postings: passages and their words."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))


def blocks(rows: DataFrame, passages: int, words: int, size: int = RANGE) -> DataFrame:
    """(term, range, n, most, least, largest, posts) of packed postings, each file sorted by term and range; ``passages`` and ``words`` are their totals.

    Passages of about one length are in one range, as the largest frequency and the least length then go together;
    a length that many have is dealt to as many ranges as it needs. Passages are shuffled packed and by range, so a
    task has its ranges whole and makes their blocks by itself, at about ``TASK`` words."""
    length = F.floor(F.log2(F.greatest(F.col("dl"), F.lit(1))) * 4).cast("long")
    # A row for each class of length: some hundred, whatever the number of passages.
    classes = rows.groupBy(length.alias("length")).agg(F.ceil(F.count("*") / size).alias("parts"))
    spread = rows.withColumn("length", length).join(F.broadcast(classes), "length")
    number = F.col("length") * F.lit(1 << 40) + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    dealt = spread.select(number.alias("range"), "chunk_id", "source_id", "dl", "terms", "tfs").repartition(math.ceil(words / TASK) or 1, "range")
    posts = StructType([rows.schema["chunk_id"], rows.schema["source_id"], StructField("tf", LongType()), StructField("dl", LongType())])
    schema = StructType([StructField("term", StringType()), *(StructField(n, LongType()) for n in ("range", "n", "most", "least")), StructField("largest", DoubleType()), StructField("posts", ArrayType(posts))])
    return dealt.mapInArrow(_grouped(words / passages if passages else 1.0, to_arrow_schema(schema)), schema)


def _grouped(avgdl: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of a task's packed postings, by term and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [some for b in batches if (some := b.filter(pc.not_equal(b["terms"], ""))).num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        # Split into 64-bit offsets, as the terms of a task may be over 2 GB.
        lists = pc.split_pattern(rows["terms"].combine_chunks().cast(pa.large_string()), " ")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        term = lists.flatten().dictionary_encode()
        order = pc.sort_indices(term.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranges, within = np.unique(rows["range"].to_numpy(), return_inverse=True)
        key = place[term.indices.to_numpy()] * len(ranges) + within[row]
        sort = np.argsort(key, kind="stable")
        key, row = key[sort], row[sort]
        tf = rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)[sort]
        dl = rows["dl"].to_numpy()[row]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        share = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / avgdl))
        ends = np.append(at, len(key))
        figures = [ranges[key[at] % len(ranges)], np.diff(ends), np.maximum.reduceat(tf, at), np.minimum.reduceat(dl, at), np.maximum.reduceat(share, at)]
        for i in range(0, len(at), BATCH):
            j = min(i + BATCH, len(at))
            some = slice(ends[i], ends[j])
            posts = [rows[c].combine_chunks().take(pa.array(row[some])) for c in ("chunk_id", "source_id")] + [pa.array(tf[some]), pa.array(dl[some])]
            kind = schema.field("posts").type
            held_ = pa.StructArray.from_arrays([p.cast(f.type) for p, f in zip(posts, kind.value_type, strict=True)], fields=list(kind.value_type))
            lists_ = pa.ListArray.from_arrays(pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), held_, type=kind)
            names = term.dictionary.take(pa.array(order[key[at[i:j]] // len(ranges)])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, *(pa.array(f[i:j]) for f in figures), lists_], schema=schema)

    return run


def _times(terms: list[str]) -> dict[str, int]:
    return {t: terms.count(t) for t in dict.fromkeys(terms)}


def _by_term(values: dict[str, float]) -> Column:
    """A number for each of a question's terms."""
    out = F.lit(0.0)
    for t, v in values.items():
        out = F.when(F.col("term") == t, F.lit(float(v))).otherwise(out)
    return out


@dataclass
class Index:
    """Postings and statistics, as they are stored."""

    postings: DataFrame
    statistics: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame) -> Index:
        """An index that isn't stored: every question makes the postings anew."""
        rows = postings(chunks)
        return cls(rows, statistics(rows.withColumn("bucket", F.lit(0))))

    def scores(self, terms: list[str]) -> DataFrame:
        """(chunk_id, source_id, keyword): BM25 over all passages; a repeated term counts as often.

        The document frequencies are a row for each of the question's terms, so broadcast."""
        times = {t: terms.count(t) for t in terms}
        held = self.postings.where(F.col("term").isin(*times) if times else F.lit(False))
        spark = self.postings.sparkSession
        weight = spark.createDataFrame([(t, float(n)) for t, n in times.items()], "term string, times double")
        known = held.groupBy("term").agg(F.count("*").alias("n_with")).join(F.broadcast(weight), "term")
        whole = self.statistics.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        part = F.col("times") * idf(F.col("n"), F.col("n_with")) * saturation(F.col("tf").cast("double"), F.col("dl"), F.col("avgdl"))
        joined = held.join(F.broadcast(known), "term").crossJoin(F.broadcast(whole))
        return joined.groupBy("chunk_id", "source_id").agg(F.sum(part).alias("keyword")).select("chunk_id", "source_id", "keyword")

    def top(self, terms: list[str], n: int, eligible: DataFrame | None = None) -> list[Row]:
        """The best ``n`` (chunk_id, keyword), of ``eligible`` sources where given."""
        scored = self.scores(terms)
        return top(scored if eligible is None else scored.join(eligible, "source_id", "left_semi"), "keyword", n) if terms else []


@dataclass
class Statistics:
    """Of a library at a question: passages, average length, and how many passages hold each term."""

    n: int
    avgdl: float
    df: dict[str, int]

    def weight(self, term: str, times: int) -> float:
        held = self.df.get(term, 0)
        raw = math.log((self.n - held + 0.5) / (held + 0.5))
        return times * (raw if raw > 0 else 1e-6)


@dataclass
class BlockIndex:
    """Blocks and their totals, and what changed since: the postings put in, and the sources
    whose postings in the blocks are gone. ``passages`` are the packed postings that the blocks were made of."""

    blocks: DataFrame
    totals: DataFrame
    passages: DataFrame
    put: DataFrame | None = None
    gone: DataFrame | None = None
    #: Postings in the blocks that the last question read.
    read: int = field(default=0, compare=False)

    @cached_property
    def built(self) -> Row:
        """The totals of the blocks' making."""
        return self.totals.first()

    def statistics(self, terms: list[str]) -> Statistics:
        """Frequencies are those of the terms' blocks; what is gone is counted in these, and by its passages' lengths."""
        distinct = list(dict.fromkeys(terms))
        whole = self.built
        n, words, df = whole.n, whole.words, {r.term: r.df for r in self._of(_times(terms)).groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if self.gone is not None:
            lost = totals(self.passages.join(self.gone, "source_id", "left_semi")).first()
            n, words = n - lost.n, words - lost.words
            held = self._of(_times(terms)).select("term", F.inline("posts")).join(self.gone, "source_id", "left_semi")
            for r in held.groupBy("term").agg(F.count("*").alias("n")).collect():
                df[r.term] -= r.n
        if self.put is not None:
            for r in self.put.where(F.col("term").isin("", *distinct)).groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect():
                if r.term == "":
                    n, words = n + r.n, words + r.words
                else:
                    df[r.term] = df.get(r.term, 0) + r.n
        return Statistics(n, words / n if n else 0.0, df)

    def _of(self, terms: dict[str, int]) -> DataFrame:
        return self.blocks.where(F.col("term").isin(*terms))

    def _scored(self, rows: DataFrame, terms: dict[str, int], known: Statistics) -> DataFrame:
        part = _by_term({t: known.weight(t, k) for t, k in terms.items()}) * saturation(F.col("tf").cast("double"), F.col("dl"), F.lit(known.avgdl))
        return rows.groupBy("chunk_id", "source_id").agg(F.sum(part).alias("keyword"))

    def _posts(self, found: DataFrame) -> DataFrame:
        rows = found.select("term", F.inline("posts"))
        return rows if self.gone is None else rows.join(self.gone, "source_id", "left_anti")

    def bounds(self, terms: list[str], known: Statistics) -> DataFrame:
        """(range, bound, n): the most that a passage of a range can score, and its postings of the terms. No posting is read.

        A block's largest saturation was that at the average length of its making; it grows at most as that did."""
        grown = max(1.0, known.avgdl * self.built.n / self.built.words) if self.built.words else 1.0
        share = F.least(saturation(F.col("most").cast("double"), F.col("least"), F.lit(known.avgdl)), F.col("largest") * F.lit(grown))
        weights = _by_term({t: known.weight(t, k) for t, k in _times(terms).items()})
        heads = self._of(_times(terms)).select("term", "range", "n", (weights * share).alias("bound"))
        return heads.groupBy("range").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"))

    def scores(self, terms: list[str]) -> DataFrame:
        """(chunk_id, source_id, keyword) of every passage with a term."""
        times, known = _times(terms), self.statistics(terms)
        rows = self._posts(self._of(times))
        if self.put is not None:
            rows = rows.unionByName(self.put.where(F.col("term").isin(*times)).select(*rows.columns))
        return self._scored(rows, times, known)

    def top(self, terms: list[str], n: int, eligible: DataFrame | None = None) -> list[Row]:
        """The best ``n`` (chunk_id, keyword), of ``eligible`` sources where given, ties to the least chunk_id."""
        times, known = _times(terms), self.statistics(terms)
        if not times or not known.n:
            return []
        ranges = self.bounds(terms, known)
        listed = ranges.orderBy(F.desc("bound"), "range").limit(LISTED).collect()
        best: list[Row] = []
        self.read = 0

        def take(rows: DataFrame) -> None:
            within = rows if eligible is None else rows.join(eligible, "source_id", "left_semi")
            found = top(self._scored(within, times, known), "keyword", n)
            best[:] = sorted([*best, *found], key=lambda r: (-r.keyword, r.chunk_id))[:n]

        def in_reach() -> list[Row]:
            """The ranges not read so far that may hold a row of the list."""
            least = best[-1].keyword * NEARLY if len(best) == n else -math.inf
            return [r for r in listed[done:] if r.bound >= least]

        if self.put is not None:
            take(self.put.where(F.col("term").isin(*times)).select("term", "chunk_id", "source_id", "tf", "dl"))
        done = 0
        for most in (FIRST, LISTED):
            some = in_reach()[:most]
            if some:
                take(self._posts(self._of(times).where(F.col("range").isin([r.range for r in some]))))
                self.read += sum(r.n for r in some)
                done += len(some)
        if len(listed) == LISTED and done == LISTED:
            last, least = listed[-1], best[-1].keyword * NEARLY if len(best) == n else -math.inf
            after = (F.col("bound") < last.bound) | ((F.col("bound") == last.bound) & (F.col("range") > last.range))
            more = ranges.where(after & (F.col("bound") >= least))
            self.read += more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            take(self._posts(self._of(times).join(more.select("range"), "range", "left_semi")))
        return best

    def share_read(self, terms: list[str]) -> float:
        """Of the terms' postings in blocks, the share that the last ``top`` read."""
        whole = self._of(_times(terms)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return self.read / whole if whole else 0.0
