"""Vector and hash functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def doubles(values: Iterable[float]) -> Column:
    """An array of numbers, written as one expression: a column for each would be a call to the driver's JVM for each."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the length of the shorter one."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) == 0, F.lit(0.0)).otherwise(x.cast("double") / norm(a)))


def fnv1a(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 of texts one after another, and where each begins and how long it is."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size


def fnv1a_from(h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a hashes that went as far as ``h``, gone on with bytes of ``data``, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    h, at, longest = h[order], start[order], -size[order]
    for i in range(int(-longest[0]) if len(h) else 0):
        n = np.searchsorted(longest, -i)
        h[:n] = (h[:n] ^ data[at[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_many(texts: list[str]) -> np.ndarray:
    """FNV-1a of many texts."""
    return fnv1a_from(np.full(len(texts), 0xCBF29CE484222325, np.uint64), *joined_bytes(texts))


@F.pandas_udf(StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    known = text.notna()
    out = pd.Series([None] * len(text), dtype=object)
    out[known.to_numpy()] = [f"{h:016x}" for h in fnv1a_many(text[known].tolist()).tolist()]
    return out
