"""Packing by power-of-two decomposition.

Each document's ids (its tokens, then one end id) are cut into as many full
pieces of ``max_len`` as fit, and the rest into the powers of two of its binary
form, longest first. A piece is a sequence by itself: none crosses a document
and none is padded, as every length is a power of two. Pieces of equal length
form a bucket, from which a trainer draws batches of one shape.

Cases: a null or empty text has the end id alone, one piece of length 1.
Very long texts are cut into ids whole, a batch by themselves. Repeated rows
are packed once each. Any other columns are ignored, whatever
their names. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, table

MAX_LEN = 2048
END_ID = 1
#: Words that a Python worker remembers the ids of; the rarer half then goes.
CACHE_WORDS = 250_000


def _parts(text: str | None, added: tuple[str, ...] = ()) -> list[str]:
    """Words between spaces and line feeds. Letters up to U+00FF are put in lower
    case, as the normaliser does too; that halves the forms to remember. Texts
    with one of the ``added`` tokens in any case stay, as these count as written."""
    if not text:
        return []
    try:
        text.encode("latin-1")
        low = text.lower()
        text = text if any(a in low for a in added) else low
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").split(" ")


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class WordIds(dict):
    """Ids of words, as ``tokenizers`` gives them, remembered per word.

    The vocabulary's normaliser and splitter never join text across a space or
    a line feed, nor a letter with a full stop or comma, so the ids of a text
    are those of such parts in order; added tokens hold neither. Looking up words costs a fraction of
    encoding every occurrence anew. The key None stands for the end of a
    document."""

    def __init__(self, path: str, end_id: int = END_ID, most: int = CACHE_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(tokens.values()) + 1, bool)
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.end_id, self.most = end_id, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[None] = 0
        self.flat = np.array([self.end_id], np.uint32)
        self.start, self.length, self.hits = np.array([0]), np.array([1]), np.array([0])
        self.plain: list[tuple[int, str]] = []
        self.marked: list[tuple[int, int, int]] = []

    def __missing__(self, word: str) -> int:
        if word[-1:] in self.marks and word[-2:-1] <= "\xff" and word[-2:-1].isalpha() and len(self.marks[word[-1]]) == 1:
            base = self[word[:-1]]
            self.marked.append((len(self), base, self.marks[word[-1]][0]))
        else:
            self.plain.append((len(self), word))
        self[word] = n = len(self)
        return n

    def _encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places among ``words``, ids one after another, ids of each), in two parts. Words of plain
        letters go together as one text: the vocabulary marks the last token of each, which tells
        them apart again."""
        few = lambda texts, n: [texts[k : k + n] for k in range(0, len(texts), n)]
        encode = lambda some: [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        flat = lambda found: np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        letters = np.array([w.isalpha() and (w.isascii() or max(w) <= "\xff") for w in words], bool)
        joined, other = [w for w, ok in zip(words, letters, strict=True) if ok], [w for w, ok in zip(words, letters, strict=True) if not ok]
        ids = np.concatenate([np.zeros(0, np.uint32), *(flat(encode([" ".join(part)])) for part in few(joined, 1000))])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(joined):
            letters[:], other, ids, ends = False, words, ids[:0], ends[:0]
        rest = [x for part in few(other, 2048) for x in encode(part)]
        return [(np.flatnonzero(letters), ids, np.diff(ends, prepend=0)), (np.flatnonzero(~letters), flat(rest), np.fromiter(map(len, rest), np.int64, len(rest)))]

    def _shrink(self) -> None:
        """Keep the half of the words that were met most often."""
        keep = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        keep = np.concatenate([[0], np.sort(keep[keep != 0])])
        words = list(self)
        self.flat = self.flat[spread(self.start[keep], self.length[keep])]
        self.length, self.hits = self.length[keep], self.hits[keep] // 2
        self.start = np.cumsum(self.length) - self.length
        self.clear()
        self.update((words[k], i) for i, k in enumerate(keep.tolist()))

    def _learn(self) -> None:
        """Fill in the ids of the words met since the last call."""
        known = len(self.start)
        if len(self) == known:
            return
        fresh = np.zeros(len(self) - known, np.int64)
        self.length, self.hits = np.concatenate([self.length, fresh]), np.concatenate([self.hits, fresh])
        at = np.array([n for n, _ in self.plain], np.int64)
        found = [(at[place], ids, lengths) for place, ids, lengths in self._encode([w for _, w in self.plain])]
        for at, _, lengths in found:
            self.length[at] = lengths
        marked = np.array(self.marked, np.int64).reshape(-1, 3)
        self.length[marked[:, 0]] = self.length[marked[:, 1]] + 1
        new = self.length[known:]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(new) - new])
        self.flat = np.concatenate([self.flat, np.zeros(int(new.sum()), np.uint32)])
        for at, ids, lengths in found:
            self.flat[spread(self.start[at], lengths)] = ids
        to, base, mark = marked.T
        self.flat[spread(self.start[to], self.length[base])] = self.flat[spread(self.start[base], self.length[base])]
        self.flat[self.start[to] + self.length[base]] = mark
        self.plain, self.marked = [], []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the count for each text."""
        if len(self) > self.most:
            self._shrink()
        parts = [_parts(t, self.added) + [None] for t in texts]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        self._learn()
        self.hits += np.bincount(at, minlength=len(self.hits))
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        ids = self.flat[spread(self.start[at], lengths)]
        last = np.cumsum(np.array([len(p) for p in parts], np.int64)) - 1
        return ids, np.diff(ends[last], prepend=0)


@lru_cache(1)
def _worker_words(path: str, end_id: int) -> WordIds:
    """One memory for all the tasks of a Python worker."""
    return WordIds(path, end_id)


def binary_pieces(total: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``total`` ids; ``max_len`` is a power of two."""
    full, rest = divmod(total, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


@in_batches
def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length (also the bucket), ids (little-endian 32-bit), doc_tokens; a row is a sequence.

    No shuffle: each task packs what it reads, in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(vocabulary, end_id)
        for batch in bounded(batches, "text", 1 << 20):
            ids, counts = words.encode(batch.column("text").to_pylist())
            pieces = [binary_pieces(int(n), max_len) for n in counts]
            per = np.array([len(p) for p in pieces], np.int64)
            length = np.fromiter((n for p in pieces for n in p), np.int64, int(per.sum()))
            ends = np.cumsum(length)
            first = np.repeat(np.cumsum(counts) - counts, per)
            cuts = np.concatenate([[0], ends * 4]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), per))),
                    pa.array(ends - length - first),
                    pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))]),
                    pa.array(np.repeat(counts, per)),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = kept.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    return packed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader takes batches of a single shape."""
    packed.write.partitionBy("length").parquet(path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed with the public word vocabulary; ids as a checksum."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
