"""Hashed word shingles of many texts at once, for near-duplicates whose hash is free to choose.

Words are runs without white space, A-Z in lower case. A word's hash is a
polynomial of its bytes, each put through a table of random odd numbers, modulo
2**64: differences of one running sum over all texts. A shingle's hash is the
weighted sum of its words' hashes, mixed. Equal shingles have equal hashes, and
others do in 1 of 2**64 cases or so. Texts are taken in pieces of ``PIECE``
bytes, cut between words, so a long text costs no more than its hashes; words
of over ``LONG`` bytes are hashed one by one."""

from __future__ import annotations

import re

import numpy as np
import xxhash

PIECE, LONG = 1 << 20, 1 << 14
_BREAKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table() -> np.ndarray:
    out = _odd(256, 21)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


BYTES = _table()
BASE = int(_odd(1, 22)[0])
WEIGHTS = _odd(64, 23)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the base and of its inverse, for places in a piece.
UP, DOWN = _powers(BASE, PIECE + 1), _powers(pow(BASE, -1, 1 << 64), PIECE + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _words_of(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes) of a piece's words."""
    gap = _BREAKS[piece]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[piece] * UP[: len(piece)], dtype=np.uint64)])
    hashes = (sums[end] - sums[start]) * DOWN[start]
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(piece[start[i] : end[i]].tobytes().lower(), 7)
    return start, hashes


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes) of all words in order."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            back = next((i for i in range(end - 1, max(at, end - LONG - 2), -1) if raw[i] in b" \t\n\v\f\r"), None)
            if back is None:
                # A word of over LONG bytes reaches the end: what goes before it is a piece, then itself.
                first = max(raw.rfind(b, at, end) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1
                if first > at:
                    end = first
                else:
                    after = _SPACE.search(raw, at)
                    end = after.start() if after else len(raw)
                    if end - at > PIECE:
                        starts.append(np.array([at]))
                        hashes.append(np.array([xxhash.xxh64_intdigest(raw[at:end].lower(), 7)], np.uint64))
                        at = end
                        continue
            else:
                end = back + 1
        s, h = _words_of(np.frombuffer(raw, np.uint8, end - at, at))
        starts.append(s + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: a text of fewer words is one shingle, one without words has none."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    at, words = word_hashes(b" ".join(raw))
    words = _mixed(words)
    cuts = np.searchsorted(at, ends[:-1]) if len(ends) else np.zeros(0, np.int64)
    first = np.concatenate([[0], cuts]).astype(np.int64)
    counts = np.diff(first, append=len(words))[: len(raw)]
    n = max(0, len(words) - shingle + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(shingle):
        runs += words[j : j + n] * WEIGHTS[j]
    runs = _mixed(runs)
    out = []
    for a, c in zip(first.tolist(), counts.tolist(), strict=False):
        if c >= shingle:
            out.append(np.unique(runs[a : a + c - shingle + 1]))
        else:
            out.append(_mixed((words[a : a + c] * WEIGHTS[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)) if c else np.zeros(0, np.uint64))
    return out
