"""FLAC: losslessly stored byte payloads, decoded with checks.

Encoding: one channel of 8-bit samples (a byte less 128), blocks of 1,024
samples; each block takes the cheapest of a constant, raw samples, the fixed
predictors and a fitted linear predictor, with Rice-coded residuals in
partitions. A seek table has the sample and byte offset of every block.

Decoding: Rice residuals and linear predictors of all blocks of a batch are
worked off side by side, a sample of each at a time, as blocks stand alone.
The checksums of block headers (CRC-8) and blocks (CRC-16) and the stream's MD5
are verified; a mismatch raises ValueError. Blocks are found by the seek table
or, where it lacks any, one after another.

Cases: a null text is an empty payload; every payload is filled up with zero
bytes to a positive multiple of 64. Equal texts have equal files. Very long
texts are many blocks, and take some 23 times their size in memory. Repeated rows are stored once each. Other columns are
ignored, whatever their names. An empty table gives no rows."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, table

BLOCK, UNIT, RATE, BITS = 1024, 64, 8000, 8
LPC_ORDER, LPC_BITS, MAX_PARTITION = 4, 7, 2
ESCAPE = 15
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_steps(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _crc_steps(0x07, 8), _crc_steps(0x8005, 16)
_far = [CRC16.astype(np.uint16)]


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges: each byte adds its own share by its distance from the end."""
    while len(_far) < (int(size.max()) if len(size) else 0):
        last = _far[-1].astype(np.uint32)
        _far.append(((last << 8 & 0xFFFF) ^ CRC16[last >> 8]).astype(np.uint16))
    shares = np.array(_far).ravel()
    ends = np.cumsum(size)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    back = np.repeat(size, size) - 1 - within
    each = shares[back * 256 + data[np.repeat(start, size) + within]]
    return np.bitwise_xor.reduceat(each, ends - size) if len(ends) else each


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _number(n: int) -> bytes:
    """FLAC's UTF-8-like coding of a block number."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *tail])


def _block_header(number: int, n: int) -> bytes:
    full = n == BLOCK
    head = bytes([0xFF, 0xF8, (10 if full else 7) << 4 | 4, 1 << 1]) + _number(number) + (b"" if full else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, end: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Writes values of ``width`` bits that end before bit ``end``."""
    for j in range(int(width.max()) if len(width) else 0):
        on = width > j
        bits[end[on] - 1 - j] = value[on] >> j & 1


def _linear(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order ``LPC_ORDER`` and their shifts, for rows of samples (zero beyond n)."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    a, err = np.zeros((len(x), LPC_ORDER)), r[:, 0] * 1.0001 + 1e-9
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = err * (1 - k * k)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(top) + 1e-9), 0, 15).astype(np.int64)
    most = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64), shift


def _rice_cost(u: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter for each run of ``size`` values, and its bits: the better of
    the two next to the mean. Residuals of 9 bits stay below the escape code."""
    start = np.cumsum(size) - size
    mean = np.add.reduceat(u, start) / np.maximum(size, 1)
    low = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7)), 0, 12).astype(np.int64)
    cost = [np.add.reduceat(u >> np.repeat(k.astype(u.dtype), size), start) + size * (1 + k) for k in (low, low + 1)]
    return np.where(cost[1] < cost[0], low + 1, low), np.minimum(*cost)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; lengths are multiples of ``UNIT``."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-sizes // BLOCK)
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    f = int(blocks.sum())
    number = np.arange(f) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    n = np.minimum(BLOCK, np.repeat(sizes, blocks) - number * BLOCK)
    first = np.cumsum(n) - n
    wide = int(n.max())
    rows = np.zeros((f, wide), np.int32)
    inside = np.arange(wide) < n[:, None]
    rows[inside] = data
    coef, shift = _linear(rows, n)
    small = coef.astype(np.int32)
    predicted = sum(small[:, j, None] * rows[:, LPC_ORDER - 1 - j : wide - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None].astype(np.int32)
    tried = {"lpc": (LPC_ORDER, rows[:, LPC_ORDER:] - predicted)}
    residual = rows
    for order in range(2):
        tried[order] = (order, residual)
        residual = residual[:, 1:] - residual[:, :-1]
    # Partitions: as many as the block's length allows, eight at most.
    log2 = np.minimum(MAX_PARTITION, np.log2((n & -n) // UNIT).astype(np.int64))
    step = n >> log2
    parts, of_part = 1 << log2, np.repeat(np.arange(f), 1 << log2)
    part0 = np.cumsum(parts) - parts
    choice, bits_of, kept = np.full(f, -1), n * BITS, {}
    codes = list(tried)
    for c, name in enumerate(codes):
        order, r = tried[name]
        u = r[inside[:, order:]]
        u = u << 1 ^ u >> 31
        size = step[of_part] - np.where(np.isin(np.arange(len(of_part)), part0), order, 0)
        k, cost = _rice_cost(u, size)
        total = np.bincount(of_part, weights=cost + 4, minlength=f).astype(np.int64) + 6 + order * BITS + (9 + LPC_ORDER * LPC_BITS if name == "lpc" else 0)
        better = total < bits_of
        choice[better], bits_of = c, np.minimum(bits_of, total)
        kept[c] = (u, size, k)
    constant = (rows == rows[:, :1]).__or__(~inside).all(1)
    choice[constant], bits_of[constant] = -2, BITS
    heads = [_block_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head_len = np.array([len(h) for h in heads])
    body = head_len + 1 + -(-bits_of // 8)
    whole = body + 2
    begin = np.cumsum(whole) - whole
    bits = np.zeros(int(whole.sum()) * 8, np.uint8)
    pos = (begin + head_len) * 8
    kind = np.select([choice == -2, choice == -1, choice == 0], [0, 1, 32 + LPC_ORDER - 1], 8 + choice - 1)
    _put(bits, pos + 8, kind << 1, np.full(f, 8))
    pos = pos + 8
    order_of = np.select([choice == 0, choice > 0], [LPC_ORDER, choice - 1], 0)
    warm = np.where(constant, 1, np.where(choice == -1, n, order_of))
    w_frame = np.repeat(np.arange(f), warm)
    w_at = np.arange(int(warm.sum())) - np.repeat(np.cumsum(warm) - warm, warm)
    _put(bits, pos[w_frame] + (w_at + 1) * BITS, rows[w_frame, w_at] & 0xFF, np.full(len(w_at), BITS))
    pos = pos + warm * BITS
    lin = np.flatnonzero(choice == 0)
    _put(bits, pos[lin] + 4, np.full(len(lin), LPC_BITS - 1), np.full(len(lin), 4))
    _put(bits, pos[lin] + 9, shift[lin], np.full(len(lin), 5))
    for j in range(LPC_ORDER):
        _put(bits, pos[lin] + 9 + (j + 1) * LPC_BITS, coef[lin, j] & ((1 << LPC_BITS) - 1), np.full(len(lin), LPC_BITS))
    pos[lin] += 9 + LPC_ORDER * LPC_BITS
    coded = np.flatnonzero(choice >= 0)
    _put(bits, pos[coded] + 6, log2[coded], np.full(len(coded), 6))
    pos[coded] += 6
    for c, (u, size, k) in kept.items():
        mine = np.flatnonzero(choice[of_part] == c)
        if not len(mine):
            continue
        u = u[np.repeat(choice[of_part] == c, size)]
        owner = np.repeat(mine, size[mine])
        frame = of_part[owner]
        kk = k[owner].astype(np.int32)
        opens = np.concatenate([[True], owner[1:] != owner[:-1]])
        length = (u >> kk) + 1 + kk + 4 * opens.astype(np.int32)
        end = np.cumsum(length, dtype=np.int64)
        starts = np.concatenate([[True], frame[1:] != frame[:-1]])
        base = (pos[frame[starts]] - (end - length)[starts]).repeat(np.diff(np.flatnonzero(starts), append=len(u)))
        end = end + base
        one = np.left_shift(np.int32(1), kk)
        _put(bits, end, (u & (one - 1)) | one, kk + 1)
        _put(bits, (end - length)[opens] + 4, kk[opens], np.full(int(opens.sum()), 4))
    out = np.packbits(bits)
    for b, h in zip(begin.tolist(), heads, strict=True):
        out[b : b + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(out, begin, body)
    out[begin + body], out[begin + body + 1] = check >> 8, check & 0xFF
    raw, files, at = out.tobytes(), [], 0
    for i, p in enumerate(payloads):
        m = int(blocks[i])
        lens, counts = whole[at : at + m], n[at : at + m]
        offsets = np.cumsum(lens) - lens
        seek = b"".join(struct.pack(">QQH", j * BLOCK, int(o), int(c)) for j, (o, c) in enumerate(zip(offsets, counts, strict=True)))
        about = RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(p)
        pcm = (np.frombuffer(p, np.uint8) - np.uint8(128)).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(lens.min()).to_bytes(3, "big") + int(lens.max()).to_bytes(3, "big") + about.to_bytes(8, "big") + hashlib.md5(pcm).digest()
        a = int(begin[at])
        files.append(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[a : a + int(lens.sum())])
        at += m
    return files


def _metadata(file: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """Stream figures, seek points (sample, byte offset, samples) and where blocks begin."""
    if file[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, {}, []
    while True:
        kind, size = file[at], int.from_bytes(file[at + 1 : at + 4], "big")
        body = file[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            about = int.from_bytes(body[10:18], "big")
            info = {"samples": about & (1 << 36) - 1, "bits": (about >> 36 & 31) + 1, "channels": (about >> 41 & 7) + 1, "md5": body[18:34]}
        elif kind & 0x7F == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
        if kind & 0x80:
            return info, points, at


def _read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(header bytes, block number, samples) of the block at ``at``, its CRC-8 verified."""
    if data[at] != 0xFF or data[at + 1] != 0xF8:
        raise ValueError("lost block synchronisation")
    code, i = data[at + 2] >> 4, at + 4
    lead = data[i]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not extra else lead & (0x3F >> extra)
    for b in data[i + 1 : i + 1 + extra]:
        number = number << 6 | b & 0x3F
    i += 1 + extra
    if code == 6:
        n, i = data[i] + 1, i + 1
    elif code == 7:
        n, i = int.from_bytes(data[i : i + 2], "big") + 1, i + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    i += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if data[at + 3] >> 4 or data[at + 3] >> 1 & 7 not in (0, 1):
        raise ValueError("only one channel of 8-bit samples is read here")
    if crc8(data[at:i]) != data[i]:
        raise ValueError("wrong block header checksum")
    return i + 1 - at, number, n


CLZ16 = (16 - np.ceil(np.log2(np.arange(65536) + 1)).astype(np.int64)).astype(np.int64)


class Blocks:
    """Reads many blocks of one buffer in step: sample t of each at a time."""

    def __init__(self, data: bytes, start: np.ndarray):
        heads = [_read_header(data, s) for s in start.tolist()]
        order = np.argsort([-h[2] for h in heads], kind="stable")
        self.back = np.argsort(order)
        self.start = start[order]
        self.number = np.array([h[1] for h in heads], np.int64)[order]
        self.n = np.array([h[2] for h in heads], np.int64)[order]
        self.raw = np.frombuffer(data + bytes(16), np.uint8)
        word = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | self.raw[i : i + len(word)]
        self.word = word
        self.p = (self.start + np.array([h[0] for h in heads], np.int64)[order]) * 8

    def window(self, p: np.ndarray) -> np.ndarray:
        return self.word[p >> 3] << (p & 7).astype(np.uint64)

    def take(self, who: np.ndarray, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), who.shape)
        w = self.window(self.p[who])
        w = np.where(width > 0, (w.view(np.int64) if signed else w) >> (64 - np.maximum(width, 1)).astype(np.int64 if signed else np.uint64), 0)
        self.p[who] += width
        return w.astype(np.int64)

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """Samples (a column for each block, in the given order) and the byte after each block."""
        f = len(self.n)
        every = np.arange(f)
        kind = self.take(every, 8)
        if (kind & 1).any() or (kind >> 7).any():
            raise ValueError("wasted bits aren't read here")
        kind >>= 1
        self.kind = kind
        lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
        order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
        self.order = order
        deep = int(order.max()) if f else 0
        out = np.zeros((deep + (int(self.n[0]) if f else 0), f), np.int64)
        bias = np.zeros(f, np.int64)
        bias[kind == 0] = self.take(every[kind == 0], BITS, True)
        for t in range(deep):
            who = np.flatnonzero(order > t)
            out[deep + t, who] = self.take(who, BITS, True)
        coef, shift = np.zeros((f, max(deep, 1)), np.int64), np.zeros(f, np.int64)
        for o, c in FIXED.items():
            coef[np.ix_(np.flatnonzero(fixed & (order == o)), np.arange(len(c)))] = c
        who = np.flatnonzero(lpc)
        width = self.take(who, 4) + 1
        shift[who] = self.take(who, 5)
        for j in range(deep):
            some = order[who] > j
            coef[who[some], j] = self.take(who[some], width[some], True)
        coded = np.flatnonzero(lpc | fixed)
        log2, param_bits = np.zeros(f, np.int64), np.full(f, 4)
        param_bits[coded] += self.take(coded, 2)
        log2[coded] = self.take(coded, 4)
        k, rawn = np.zeros(f, np.int64), np.where(kind == 1, BITS, 0)
        is_raw = ~(lpc | fixed)
        step = self.n >> log2
        opens: dict[int, list[int]] = {}
        for i in coded.tolist():
            for q in range(1 << int(log2[i])):
                opens.setdefault(max(q * int(step[i]), int(order[i])), []).append(i)
        live_at = f
        active_steps = int(self.n[0]) if f else 0
        any_raw = is_raw.any()
        for t in range(active_steps):
            while live_at and self.n[live_at - 1] <= t:
                live_at -= 1
            if t in opens:
                i = np.array(opens[t])
                k[i] = self.take(i, param_bits[i])
                is_raw[i] = k[i] == (1 << param_bits[i]) - 1
                esc = i[is_raw[i]]
                rawn[esc] = self.take(esc, 5)
                any_raw = is_raw.any()
            go = slice(0, live_at) if t >= deep and not any_raw else np.flatnonzero((order[:live_at] <= t) & ~is_raw[:live_at])
            p, kk = self.p[go], k[go]
            w = self.window(p)
            q = CLZ16[(w >> np.uint64(48)).view(np.int64)]
            if (q == 16).any():
                q = self._long_run(p, q)
                w = self.window(p + q) << np.uint64(1)
            else:
                w = w << (q + 1).astype(np.uint64)
            u = q << kk | (w >> np.uint64(1) >> (63 - kk).astype(np.uint64)).view(np.int64)
            self.p[go] = p + q + 1 + kk
            row = out[deep + t]
            row[go] = u >> 1 ^ -(u & 1)
            if any_raw:
                who = np.flatnonzero(is_raw[:live_at] & (order[:live_at] <= t))
                row[who] = self.take(who, rawn[who], True)
            if deep:
                pred = coef[:live_at, 0] * out[deep + t - 1, :live_at]
                for j in range(1, deep):
                    pred += coef[:live_at, j] * out[deep + t - 1 - j, :live_at]
                pred >>= shift[:live_at]
                row[:live_at] += pred if t >= deep else np.where(order[:live_at] <= t, pred, 0)
        samples = out[deep:] + bias
        return samples[:, self.back], (-(-self.p // 8))[self.back]

    def _long_run(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        q, far = q.copy(), np.flatnonzero(q == 16)
        while len(far):
            more = CLZ16[(self.window(p[far] + q[far]) >> np.uint64(48)).view(np.int64)]
            q[far] += more
            far = far[more == 16]
        return q


def decode(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], dict]]:
    """For each file: the payload, the blocks' (sample offset, samples) and figures of the decoding."""
    infos, starts, owner, seeks = [], [], [], []
    at = 0
    for i, f in enumerate(files):
        info, points, first = _metadata(f)
        infos.append(info)
        if sum(p[2] for p in points) != info["samples"]:
            points = _walk(f, first)
        seeks.append(points)
        starts += [at + first + p[1] for p in points]
        owner += [i] * len(points)
        at += len(f)
    data = b"".join(files)
    start = np.array(starts, np.int64)
    blocks = Blocks(data, start)
    samples, ends = blocks.decode()
    sizes = ends - start
    stored = blocks.raw[ends].astype(np.int64) << 8 | blocks.raw[ends + 1]
    if (crc16(blocks.raw, start, sizes) != stored).any():
        raise ValueError("wrong block checksum")
    n, kind = blocks.n[blocks.back], blocks.kind[blocks.back]
    out, b = [], 0
    for i, info in enumerate(infos):
        m = len(seeks[i])
        pcm = np.concatenate([samples[: n[j], j] for j in range(b, b + m)]) if m else np.zeros(0, np.int64)
        raw = pcm.astype(np.int8).tobytes()
        if len(pcm) != info["samples"] or (any(info["md5"]) and hashlib.md5(raw).digest() != info["md5"]):
            raise ValueError("wrong stream checksum")
        kinds = np.bincount(np.digitize(kind[b : b + m], [1, 8, 32]), minlength=4)
        level = float(np.sqrt((pcm.astype(np.float64) ** 2).mean())) if m else 0.0
        figures = {"blocks": m, "constant": int(kinds[0]), "verbatim": int(kinds[1]), "fixed": int(kinds[2]), "lpc": int(kinds[3]), "peak": int(np.abs(pcm).max()) if m else 0, "rms": round(level, 6)}
        out.append(((np.frombuffer(raw, np.uint8) + np.uint8(128)).tobytes(), [(p[0], p[2]) for p in seeks[i]], figures))
        b += m
    return out


def _walk(file: bytes, first: int) -> list[tuple[int, int, int]]:
    """Seek points found by decoding one block after another, for files without a whole table."""
    at, sample, points = first, 0, []
    while at + 2 < len(file):
        one = Blocks(file, np.array([at]))
        _, end = one.decode()
        points.append((sample, at - first, int(one.n[0])))
        sample, at = sample + int(one.n[0]), int(end[0]) + 2
    return points


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


@in_batches
def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's padded bytes as a FLAC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            files = encode([padded(r) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, media binary")


@in_batches
def from_media(media: DataFrame) -> DataFrame:
    """Adds the payload read back and the decoding's figures to (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media", 1 << 20):
            found = decode(batch.column("media").to_pylist())
            say = [" ".join(f"{k}={v}" for k, v in x[2].items()) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.binary()), pa.array(say, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


@in_batches
def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, pcm): decoded blocks, each to be sought by its sample offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media", 1 << 20):
            found = decode(batch.column("media").to_pylist())
            rows = [(d, i, o, x[0][o : o + n]) for d, x in zip(batch.column("doc_id").to_pylist(), found, strict=True) for i, (o, n) in enumerate(x[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "block", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, pcm binary")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC and read back; digests of both."""
    back = from_media(to_media(table(spark, sf_dir, "documents")))
    size = F.octet_length("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
