"""The built-in text vectors: hashed words, word pairs and letter runs, without a model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

from tessera.functions.lexicon import STOP_WORDS, SUFFIXES
from tessera.functions.text import stem_word
from tessera.functions.vectors import fnv1a_from, fnv1a_many, joined_bytes

DIMENSIONS, GRAM = 384, 4
#: Characters of texts that are worked on at once; a longer text is by itself.
SLICE = 1 << 19
#: Stems that a worker remembers.
KNOWN = 1 << 16
#: Weights in hundredths, so that sums are whole numbers.
WORD_WEIGHT, PAIR_WEIGHT, GRAM_WEIGHT = 100, 65, 28
_STOP = frozenset(STOP_WORDS)
#: A word that ends otherwise is its own stem.
_ENDS = frozenset(s[-1] for s in SUFFIXES)
_stems: dict[str, str] = {}


def _stem(word: str) -> str:
    """A word's stem, or nothing where it is no feature."""
    found = _stems.get(word)
    if found is None:
        if len(_stems) >= KNOWN:
            _stems.clear()
        stem = "" if word in _STOP else stem_word(word) if word[-1] in _ENDS else word
        found = _stems[word] = stem if len(stem) >= 2 else ""
    return found


def _slots(h: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and signed weight of hashed features."""
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63) == 1, -weight, weight)


def _added(out: np.ndarray, row: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> None:
    out += np.bincount(row * DIMENSIONS + slot, weight, out.size).reshape(out.shape).astype(np.int64)


def sums(texts: list[str]) -> np.ndarray:
    """The added-up weights of each text's features in hundredths, a row of ``DIMENSIONS`` for each.

    The features of a word, its own and its letter runs, are hashed once for each distinct stem; a pair's hash goes on
    from that of its first word. Memory is some numbers for each word and feature of these texts."""
    out, codes = np.zeros((len(texts), DIMENSIONS), np.int64), {}
    words = [[codes.setdefault(w, len(codes)) for w in re.findall(r"[^\W_]+", t.lower())] for t in texts]
    flat = np.fromiter(chain.from_iterable(words), np.int64)
    known: dict[str, int] = {}
    stem_of = np.array([known.setdefault(s, len(known)) if (s := _stem(w)) else -1 for w in codes], np.int64)
    if not known:
        return out
    stem, row = stem_of[flat], np.repeat(np.arange(len(texts)), [len(w) for w in words])
    stem, row = stem[stem >= 0], row[stem >= 0]
    stems = list(known)
    own_at, own = _slots(fnv1a_many([f"w:{s}" for s in stems]), WORD_WEIGHT)
    _added(out, row, own_at[stem], own[stem])
    grams: dict[str, int] = {}
    held = [[grams.setdefault(s[i : i + GRAM], len(grams)) for i in range(len(s) - GRAM + 1)] for s in stems]
    if grams:
        gram_at, gram = _slots(fnv1a_many([f"c:{g}" for g in grams]), GRAM_WEIGHT)
        of, many = np.fromiter(chain.from_iterable(held), np.int64), np.array([len(g) for g in held])
        # The places in ``of`` of each word's letter runs, word after word.
        n = many[stem]
        at = np.repeat((np.cumsum(many) - many)[stem] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        _added(out, np.repeat(row, n), gram_at[of[at]], gram[of[at]])
    pair = np.flatnonzero(row[:-1] == row[1:])
    data, start, size = joined_bytes(stems)
    second = stem[pair + 1]
    pair_at, weight = _slots(fnv1a_from(fnv1a_many([f"b:{s}_" for s in stems])[stem[pair]], data, start[second], size[second]), PAIR_WEIGHT)
    _added(out, row[pair], pair_at, weight)
    return out


def embed(texts: list[str]) -> np.ndarray:
    """Unit vectors of ``DIMENSIONS``, a row for each text; no features give zeros."""
    out = sums(texts) / 100
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts, null ones as empty, in order and about ``SLICE`` characters at a time."""
    some, n = [], 0
    for t in texts:
        t = t.as_py() or ""
        if some and n + len(t) > SLICE:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def _lists(parts: Iterator[np.ndarray], kind: pa.DataType) -> pa.Array:
    """The rows of matrices as one array of lists, of which only the numbers themselves are held."""
    made = [pa.ListArray.from_arrays(np.arange(0, p.size + 1, DIMENSIONS, np.int32), pa.array(p.ravel(), kind)) for p in parts]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(kind))


@F.arrow_udf(ArrayType(FloatType()))
def builtin_embedding(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Vectors of a column of texts."""
    for texts in batches:
        yield _lists((embed(some).astype(np.float32) for some in _slices(texts)), pa.float32())


@F.arrow_udf(ArrayType(LongType()))
def feature_sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sums behind the vectors of a column of texts, in hundredths: whole numbers, as all weights are."""
    for texts in batches:
        yield _lists(map(sums, _slices(texts)), pa.int64())


def with_vectors(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.withColumn("vector", builtin_embedding(F.col(text_col)))
