"""SentencePiece encoding and decoding by a max-plus parallel scan.

Pieces of a text are those of the best path through it: the sum of the pieces'
scores is the largest (a unigram lattice over the model's pieces; of equal
paths, the one whose last piece is longest, and so on backwards). Bytes of
characters that no piece holds become byte pieces. A model file of another kind
than unigram is read the same way: its pieces and scores are taken, not its
merge order; the README says what that means for the public BPE model.

Texts are cut into chunks. The state at a boundary is how many bytes before it
the last piece ended, so a chunk's effect is a max-plus matrix from its left
states to its right ones. Matrices of a document's chunks combine
associatively into the best sums at each boundary; with these, each chunk maps
its right states to left ones, the boundary states follow from the maps, and
each chunk is backtraced by itself between its two states. Where a chunk begins at a space
that no piece reaches across, its only state is 0 and the matrix is a single
number. Where no such place is in reach, small chunks have full matrices, all made
side by side, a depth of every chunk in each step, with the states that begin a
character alone.

Texts over ``CHUNK`` bytes are scanned so; a shorter one is a chunk by itself, whose
path is found directly. Chunks of giant documents become rows and are dealt to
all tasks; other documents are scanned where they are read. A stretch between
two such spaces that occurred before has its sum and ids remembered by worker, as words recur.

Cases: a null text is encoded as null and decoded as null; an empty one has no
ids. Decoding gives the text back but for U+2581 itself, which reads as a
space. Repeated rows are encoded once each. Other columns are ignored, whatever
their names. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, stored, table
from tessera.llm.packing import spread

CHUNK, GIANT, GROUP = 1 << 12, 1 << 16, 1 << 18
#: Bytes of a chunk inside a stretch that no safe place cuts.
SMALL = 384
SPACE = "▁".encode()
#: What an unknown character costs beyond the lowest score, as in unigram models.
UNKNOWN_COST = 10.0
LOW = -1e30


def _model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


class Lattice:
    """A model's pieces as a byte trie in flat arrays."""

    def __init__(self, path: str):
        model = _model(path)
        self.prefix = bool(model.normalizer_spec.add_dummy_prefix)
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are read here")
        kinds = model.SentencePiece
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        usable: list[tuple[bytes, int, float]] = []
        for i, p in enumerate(model.pieces):
            raw = p.piece.encode()
            if p.type == kinds.BYTE:
                raw = bytes([int(p.piece[3:5], 16)])
                self.byte_id[raw[0]] = i
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                usable.append((raw, i, p.score))
            else:
                raw = b""
            self.bytes_of.append(raw)
        normal = [s for r, _, s in usable]
        self.unknown = min(normal) - UNKNOWN_COST if normal else -UNKNOWN_COST
        self.longest = max(len(r) for r, _, _ in usable)
        #: The longest tail of a piece that a boundary can cut off.
        self.states = max(self.longest, 4)
        children: list[dict[int, int]] = [{}]
        self.piece_at, self.score_at = [-1], [0.0]
        for raw, i, score in usable:
            node = 0
            for b in raw:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    self.piece_at.append(-1)
                    self.score_at.append(0.0)
                node = children[node][b]
            self.piece_at[node], self.score_at[node] = i, score
        self.piece_at, self.score_at = np.array(self.piece_at), np.array(self.score_at)
        self.base, self.check, self.next = self._rows(children)
        self.inner_space = any(SPACE in r.lstrip(SPACE) or (r.startswith(SPACE) and SPACE in r[3:] and r.strip(SPACE)) for r, _, _ in usable)
        if self.inner_space:
            raise ValueError("only models whose pieces hold no space after their beginning are read here, as texts are cut at spaces")

    @staticmethod
    def _rows(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the trie laid over one another: child of node by byte b at base[node] + b.

        Rows with several children go first, each to the first place where it
        fits; a row of one child fits into any free slot."""
        size = 1 << 19
        taken, base, low = np.zeros(size, bool), np.zeros(len(children), np.int64), 0
        check, nxt = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        several = sorted((n for n, c in enumerate(children) if len(c) > 1), key=lambda n: -len(children[n]))
        for node in several:
            keys = np.array(sorted(children[node]), np.int64)
            at = low
            while True:
                ok = ~taken[at + keys[0] : at + keys[0] + 1024]
                for k in keys[1:]:
                    ok &= ~taken[at + k : at + k + 1024]
                hit = int(ok.argmax())
                if ok[hit]:
                    at += hit
                    break
                at += 1024
            base[node] = at
            taken[at + keys], check[at + keys] = True, node
            nxt[at + keys] = [children[node][int(k)] for k in keys]
            while taken[low : low + 512].all():
                low += 256
        single = np.array([(n, *next(iter(c.items()))) for n, c in enumerate(children) if len(c) == 1], np.int64).reshape(-1, 3)
        slots = np.flatnonzero(~taken[256:])[: len(single)] + 256
        base[single[:, 0]], check[slots], nxt[slots] = slots - single[:, 1], single[:, 0], single[:, 2]
        return base, check, nxt

    def normalise(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass").replace(b" ", SPACE)
        return (SPACE if self.prefix and raw else b"") + raw

    def arcs(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, score) of every piece in ``data``; none reaches beyond its start's ``stop``."""
        n = len(data)
        wide = data.astype(np.int64)
        follows = (wide & 0xC0) == 0x80
        live, node = np.flatnonzero(~follows), np.zeros(n, np.int64)
        node = node[live]
        starts, ends, pieces, scores = [], [], [], []
        for depth in range(self.longest):
            ok = live + depth < stop[live]
            live, node = live[ok], node[ok]
            at = self.base[node] + wide[live + depth]
            hit = self.check[at] == node
            live, node = live[hit], self.next[at[hit]].astype(np.int64)
            if not len(live):
                break
            piece = self.piece_at[node]
            got = piece >= 0
            starts.append(live[got])
            ends.append(live[got] + depth + 1)
            pieces.append(piece[got])
            scores.append(self.score_at[node[got]])
        # A character that is no piece by itself is an unknown of its own.
        first = np.flatnonzero(~follows)
        width = np.zeros(n, np.int64)
        width[first] = np.diff(first, append=n)
        whole = np.zeros(n, bool)
        for x, y in zip(starts, ends, strict=True):
            whole[x[y - x == width[x]]] = True
        lost = first[~whole[first] & (first + width[first] <= stop[first])]
        starts.append(lost)
        ends.append(lost + width[lost])
        pieces.append(np.full(len(lost), -1))
        scores.append(np.full(len(lost), self.unknown))
        return tuple(np.concatenate(x) for x in (starts, ends, pieces, scores))


def cut(raw: bytes, chunk: int = CHUNK) -> list[int]:
    """Where chunks of a normalised text begin: before a space that follows none, where there is
    one within reach of ``chunk`` bytes, else at a character."""
    out, at, n = [], 0, len(raw)
    while at < n:
        out.append(at)
        if n - at <= chunk:
            break
        end = at + chunk
        safe = raw.rfind(SPACE, at + 1, end)
        while safe > at and raw[safe - 3 : safe] == SPACE:
            safe = raw.rfind(SPACE, at + 1, safe + 2)
        if safe > at:
            at = safe
        else:
            while end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
            at = end
    return out


def is_safe(raw: bytes, at: int) -> bool:
    """Whether no piece can reach across ``at``: a space begins there and none ends there."""
    return at == 0 or at == len(raw) or (raw.startswith(SPACE, at) and raw[max(0, at - 3) : at] != SPACE)


class Abreast:
    """Best sums over many chunks at once, a depth of all of them in each step.

    A chunk is (bytes, lead): the bytes before ``lead`` are what goes before it, for the pieces that reach into it, and
    begin with a character. ``enters`` has for each chunk a row of sums for each column, by the left state: its node is
    that many bytes before the chunk. Of equal sums the longest last piece is kept."""

    def __init__(self, lattice: Lattice, chunks: list[tuple[bytes, int]], enters: list[np.ndarray], trace: bool):
        self.lattice = lattice
        self.size, self.lead = np.array([len(d) for d, _ in chunks]), np.array([x for _, x in chunks])
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(d for d, _ in chunks), np.uint8)
        owner = np.repeat(np.arange(len(chunks)), self.size)
        s, e, p, w = lattice.arcs(self.raw, (self.first + self.size)[owner])
        c = owner[s]
        # A chunk has a node more than bytes, so nodes are shifted by its number.
        depth = e - self.first[c]
        keep = depth > self.lead[c]
        order = np.lexsort((s[keep], e[keep], depth[keep]))
        self.s, self.p, w, c, depth = (x[keep][order] for x in (s, p, w, c, depth))
        self.e = e[keep][order]
        start, end = self.s + c, self.e + c
        ends = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        self.best = np.full((int(self.size.sum()) + len(chunks), max(len(x) for x in enters)), LOW)
        self.via = np.full(len(self.best), -1) if trace else None
        for i, enter in enumerate(enters):
            at = self.first[i] + i + self.lead[i]
            self.best[at - np.arange(enter.shape[1]), : len(enter)] = enter.T
        steps = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(depth) else np.zeros(1, np.int64)
        bounds, weight = np.searchsorted(ends, steps).tolist(), w[:, None]
        for k, (a, b) in enumerate(zip(steps.tolist(), steps[1:].tolist(), strict=False)):
            cuts = ends[bounds[k] : bounds[k + 1]]
            sums = self.best[start[a:b]] + weight[a:b]
            top = np.maximum.reduceat(sums, cuts - a, axis=0)
            ok = top > LOW / 2
            here = end[cuts]
            self.best[here] = np.where(ok, top, LOW)
            if trace:
                # The first arc of those that give the best sum is the longest.
                which = np.where(sums[:, 0] == np.repeat(top[:, 0], np.diff(np.append(cuts, b))), np.arange(a, b), b)
                self.via[here] = np.where(ok[:, 0], np.minimum.reduceat(which, cuts - a), -1)

    def transfer(self, i: int, states: int) -> np.ndarray:
        """(column, right state) of a chunk: the sum up to the node that is ``state`` bytes before its end."""
        out, reach = np.full((self.best.shape[1], states), LOW), min(states, int(self.size[i]) + 1)
        out[:, :reach] = self.best[self.first[i] + i + self.size[i] - np.arange(reach)].T
        return out

    def trace(self, i: int, state: int) -> tuple[list[int], int]:
        """Ids of a chunk's path from a right state back to a left one, and that one; -1 where there is no path."""
        first, lead, at, out = int(self.first[i]), int(self.lead[i]), int(self.size[i]) - state, []
        if at < 0 or self.best[first + i + at, 0] <= LOW / 2:
            return [], -1
        while at > lead:
            k = int(self.via[first + i + at])
            piece = int(self.p[k])
            if piece >= 0:
                out.append(piece)
            else:
                out += self.lattice.byte_id[self.raw[self.s[k] : self.e[k]]].tolist()[::-1]
            at = int(self.s[k]) - first
        return out[::-1], lead - at


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices; associative."""
    return np.maximum((a[:, :, None] + b[None]).max(1), LOW)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by recursive doubling over the associative product."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [plus(out[i - step], m) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


class Pieces:
    """A model's pieces as bytes, for decoding alone."""

    def __init__(self, path: str):
        model = _model(path)
        self.prefix = bool(model.normalizer_spec.add_dummy_prefix)
        kinds = model.SentencePiece
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode().replace(SPACE, b" ") if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in model.pieces]
        self.flat, self.length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> str:
        # Three byte pieces may spell the space's bytes, so it is looked for once more.
        raw = self.flat[spread(self.start[ids], self.length[ids])].tobytes().replace(SPACE, b" ")
        text = raw.decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


class Words(dict):
    """Best paths of stretches between safe places, remembered per worker: a number for each stretch,
    its ids and sum in flat arrays. The rarer half goes when there are too many."""

    def __init__(self, lattice: Lattice, most: int = 200_000):
        super().__init__()
        self.lattice, self.most = lattice, most
        self.flat = np.zeros(0, np.uint32)
        self.start, self.length, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n

    def at(self, parts: list[bytes]) -> np.ndarray:
        """The numbers of stretches, all known afterwards."""
        if len(self) > self.most:
            self._shrink()
        found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self._learn()
        self.hits += np.bincount(found, minlength=len(self.hits))
        return found

    def ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after another, and the count for each."""
        at = self.at(parts)
        return self.flat[spread(self.start[at], self.length[at])], self.length[at]

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.most // 2])
        words = list(self)
        self.flat = self.flat[spread(self.start[keep], self.length[keep])]
        self.length, self.hits, self.score = self.length[keep], self.hits[keep] // 2, self.score[keep]
        self.start = np.cumsum(self.length) - self.length
        self.clear()
        self.update((words[k], i) for i, k in enumerate(keep.tolist()))

    def _learn(self) -> None:
        """Paths of the waiting stretches, in groups of bounded size."""
        new, self.waiting = self.waiting, []
        while new:
            sizes = np.cumsum([len(w) for w in new])
            n = max(1, int(np.searchsorted(sizes, GROUP)))
            self._paths(new[:n])
            new = new[n:]

    def _paths(self, new: list[bytes]) -> None:
        # All new stretches side by side: arcs with the same end depth and length in one step,
        # short before long, so that of equal sums the longest last piece stays.
        size = np.array([len(w) for w in new])
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(new), np.uint8)
        s, e, p, w = self.lattice.arcs(data, np.repeat(first + size, size))
        begin = np.repeat(first, size)[s]
        span = self.lattice.states + 1
        step = (e - begin) * span + (e - s)
        order = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
        s, e, p, w, step, begin = s[order], e[order], p[order], w[order], step[order], begin[order]
        # The sum up to a node stands at the byte before it, as stretches adjoin.
        best, via = np.full(len(data), LOW), np.full(len(data), -1)
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            start, end = s[a:b], e[a:b] - 1
            sums = np.where(start == begin[a:b], 0.0, best[start - 1]) + w[a:b]
            better = sums >= best[end]
            end = end[better]
            best[end] = sums[better]
            via[end] = np.flatnonzero(better) + a
        # Back from all ends at once, a piece of each stretch at a time.
        at, taken = first + size, []
        while (on := at > first).any():
            k = np.where(on, via[at - 1], -1)
            taken.append(k)
            at = np.where(on, s[k], at)
        arcs = np.stack(taken[::-1], 1)
        used = arcs >= 0
        path, counts = arcs[used], used.sum(1)
        # An unknown character gives an id for each of its bytes.
        wide = np.where(p[path] >= 0, 1, e[path] - s[path])
        ids = np.repeat(p[path], wide)
        lost = ids < 0
        ids[lost] = self.lattice.byte_id[data[spread(s[path], wide)[lost]]]
        ends = np.cumsum(counts)
        length = np.diff(np.cumsum(wide)[ends - 1], prepend=0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.score = np.concatenate([self.score, best[first + size - 1]])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])


def safe_split(raw: bytes) -> list[bytes]:
    """Stretches of a normalised text that no piece reaches across: runs of spaces go with what follows."""
    parts = raw.split(SPACE)
    out, spaces = ([parts[0]] if parts[0] else []), 0
    for p in parts[1:]:
        spaces += 1
        if p:
            out.append(SPACE * spaces + p)
            spaces = 0
    return [*out, SPACE * spaces] if spaces else out


def encode_span(words: Words, raw: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Ids of a normalised text: stretches up to ``chunk`` bytes by their remembered paths, longer ones by the scan."""
    out, short = [], []
    for part in [*safe_split(raw), b""]:
        if 0 < len(part) <= chunk:
            short.append(part)
            continue
        out.append(words.ids(short)[0])
        short = []
        if part:
            out.append(np.array(scan_encode(words.lattice, part, min(chunk, SMALL)), np.uint32))
    return np.concatenate(out)


def scan_encode(lattice: Lattice, raw: bytes, chunk: int | None = None) -> list[int]:
    """The scan over the chunks of one stretch, in this process."""
    return Segment(lattice, raw, 0, True, True, chunk).ids(_start(lattice), 0)


def _start(lattice: Lattice) -> np.ndarray:
    out = np.full(lattice.states, LOW)
    out[0] = 0.0
    return out


class Segment:
    """A stretch of chunks: ``lead`` bytes of ``raw`` go before it; left, right: whether its ends are safe.

    All its chunks' matrices are made side by side, with a column for each left state that begins a character."""

    def __init__(self, lattice: Lattice, raw: bytes, lead: int, left: bool, right: bool, chunk: int | None = None):
        self.lattice, self.raw = lattice, raw
        begins = [lead + b for b in cut(raw[lead:], chunk or SMALL)]
        self.chunks, self.leads, self.safe = [], [], []
        for i, a in enumerate(begins):
            b = begins[i + 1] if i + 1 < len(begins) else len(raw)
            before = 0 if (left if i == 0 else is_safe(raw, a)) else min(a, lattice.states - 1)
            while before and raw[a - before] & 0xC0 == 0x80:
                before -= 1
            self.chunks.append((raw[a - before : b], before))
            self.safe.append(right if b == len(raw) else is_safe(raw, b))
        self._made: list[np.ndarray] | None = None

    def matrices(self) -> list[np.ndarray]:
        """Each chunk's max-plus matrix (left state, right state)."""
        if self._made is None:
            states, self._made = self.lattice.states, []
            lefts = [[k for k in range(lead + 1) if k == 0 or data[lead - k] & 0xC0 != 0x80] for data, lead in self.chunks]
            enters = []
            for (_, lead), some in zip(self.chunks, lefts, strict=True):
                enter = np.full((len(some), lead + 1), LOW)
                enter[np.arange(len(some)), some] = 0.0
                enters.append(enter)
            for at, to in self._groups([len(x) for x in lefts]):
                run = Abreast(self.lattice, self.chunks[at:to], enters[at:to], False)
                for i in range(at, to):
                    matrix = np.full((states, states), LOW)
                    matrix[lefts[i]] = run.transfer(i - at, states)[: len(lefts[i])]
                    if self.safe[i]:
                        matrix[:, 1:] = LOW
                    self._made.append(matrix)
        return self._made

    def _groups(self, columns: list[int]) -> Iterator[tuple[int, int]]:
        """Runs of chunks whose nodes have about ``GROUP`` sums for all columns, one chunk at least."""
        at = size = 0
        for i, ((data, _), n) in enumerate(zip(self.chunks, columns, strict=True)):
            if i > at and size + len(data) * n > 8 * GROUP:
                yield at, i
                at, size = i, 0
            size += len(data) * n
        yield at, len(self.chunks)

    def matrix(self) -> np.ndarray:
        """The whole segment's, as a tree of products."""
        level = self.matrices()
        while len(level) > 1:
            level = [plus(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _runs(self, enter: np.ndarray) -> list[tuple[int, Abreast]]:
        """The chunks' best paths, once the sums into each are known from the matrices."""
        into = [enter]
        for m in self.matrices()[:-1]:
            into.append(np.maximum((into[-1][:, None] + m).max(0), LOW))
        enters = [x[None, : lead + 1] for x, (_, lead) in zip(into, self.chunks, strict=True)]
        return [(at, Abreast(self.lattice, self.chunks[at:to], enters[at:to], True)) for at, to in self._groups([1] * len(self.chunks))]

    def solve(self, enter: np.ndarray, state: int) -> tuple[list[int], int]:
        """Ids of the path that leaves in ``state``, of equal sums the longest last piece and so on back, and its left state."""
        out = []
        for at, run in reversed(self._runs(enter)):
            for i in range(len(run.size) - 1, -1, -1):
                ids, state = run.trace(i, state)
                out.append(ids)
        return [j for ids in reversed(out) for j in ids], state

    def ids(self, enter: np.ndarray, state: int) -> list[int]:
        return self.solve(enter, state)[0]

    def lefts(self, enter: np.ndarray, rights: list[int]) -> list[int]:
        """The left state of the best path to each right state, -1 where there is none. Paths soon meet, so each is followed once."""
        now = {r: r for r in rights}
        for _, run in reversed(self._runs(enter)):
            for i in range(len(run.size) - 1, -1, -1):
                known = {r: run.trace(i, r)[1] if r >= 0 else -1 for r in set(now.values())}
                now = {r: known[x] for r, x in now.items()}
        return [now[r] for r in rights]


def decode_ids(lattice: Lattice, ids: list[int]) -> str:
    raw = b"".join(map(lattice.bytes_of.__getitem__, ids))
    text = raw.replace(SPACE, b" ").decode("utf-8", "surrogatepass")
    return text[1:] if lattice.prefix and text.startswith(" ") else text


@lru_cache(1)
def worker_words(path: str) -> Words:
    """One memory for all the tasks of a Python worker."""
    return Words(lattice_of(path))


def _chunks(lattice: Lattice, raw: bytes, chunk: int) -> list[dict]:
    """The chunks of one normalised text, with the stretches of those whose ends are safe; where no safe place is in
    reach, chunks are one row, which has chunks of its own."""
    begins, out = [a for a in cut(raw, chunk) if is_safe(raw, a)], []
    for a, b in zip(begins, [*begins[1:], len(raw)], strict=True):
        left, right = is_safe(raw, a), is_safe(raw, b)
        lead = 0 if left else min(a, lattice.states - 1)
        parts = safe_split(raw[a:b]) if left and right else []
        out.append({"raw": raw[a - lead : b], "lead": lead, "safe_left": left, "safe_right": right, "parts": parts if max(map(len, parts), default=0) <= chunk else []})
    return out


def scan_texts(words: Words, raws: list[bytes], chunk: int = CHUNK) -> list[tuple[np.ndarray, float]]:
    """(ids, best sum) of normalised texts, each by the scan over its chunks.

    The matrices of chunks are 1 x 1 between safe places. Their products give the sums
    into every chunk, its right state gives its left one, and each is traced by itself."""
    texts = [_chunks(words.lattice, raw, chunk) for raw in raws]
    parts = [c["parts"] for rows in texts for c in rows]
    at = words.at(list(chain.from_iterable(parts)))
    cuts = np.cumsum([0, *map(len, parts)])
    sums = np.diff(np.concatenate([[0.0], np.cumsum(words.score[at])])[cuts]).tolist()
    known = np.concatenate([[0], np.cumsum(words.length[at])])[cuts].tolist()
    every = words.flat[spread(words.start[at], words.length[at])]
    out, n = [], 0
    for rows in texts:
        segments = {i: Segment(words.lattice, r["raw"], r["lead"], r["safe_left"], r["safe_right"], min(chunk, SMALL)) for i, r in enumerate(rows) if not r["parts"]}
        ahead = scan([_trimmed(segments[i].matrix(), r) if i in segments else np.array([[sums[n + i]]]) for i, r in enumerate(rows)])
        state, ids = 0, []
        for i in range(len(rows) - 1, -1, -1):
            r = rows[i]
            if r["parts"]:
                ids.append(every[known[n + i] : known[n + i + 1]])
                state = 0
                continue
            enter = _start(words.lattice)
            if i:
                enter[:] = LOW
                enter[: ahead[i - 1].shape[1]] = ahead[i - 1][0]
            found, state = segments[i].solve(enter, state)
            ids.append(np.array(found, np.uint32))
        out.append((np.concatenate(ids[::-1]), float(ahead[-1][0, 0])))
        n += len(rows)
    return out


def scan_text(words: Words, raw: bytes, chunk: int = CHUNK) -> tuple[np.ndarray, float]:
    return scan_texts(words, [raw], chunk)[0]


def small_matrix(words: Words, r: dict) -> np.ndarray:
    """A segment's matrix without the states that a safe end doesn't have."""
    return _trimmed(segment_matrix(words, r["raw"], r["lead"], r["safe_left"], r["safe_right"]), r)


def _trimmed(m: np.ndarray, r: dict) -> np.ndarray:
    return m[: 1 if r["safe_left"] else None, : 1 if r["safe_right"] else None]


def encode_texts(words: Words, texts: list[str | None]) -> list[np.ndarray | None]:
    raws = [None if t is None else words.lattice.normalise(t) for t in texts]
    long = [r is not None and len(r) > CHUNK for r in raws]
    plain = [[] if far or not r else safe_split(r) for r, far in zip(raws, long, strict=True)]
    ids, counts = words.ids(list(chain.from_iterable(plain)))
    before = np.concatenate([[0], np.cumsum(counts)])
    ends = before[np.cumsum([len(p) for p in plain])].tolist() if plain else []
    spans = zip([0, *ends], ends, strict=False)
    scanned = iter(scan_texts(words, [r for r, far in zip(raws, long, strict=True) if far]))
    return [None if r is None else next(scanned)[0] if far else ids[a:b] for r, far, (a, b) in zip(raws, long, spans, strict=True)]


def _ids_column(found: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if f is None else f.astype("<u4").tobytes() for f in found], pa.binary())


def segment_matrix(words: Words, raw: bytes, lead: int, left: bool, right: bool) -> np.ndarray:
    """A segment's matrix; one with safe ends adds up its stretches' sums."""
    lattice = words.lattice
    if not (left and right):
        return Segment(lattice, raw, lead, left, right).matrix()
    parts = safe_split(raw[lead:])
    out = np.full((lattice.states, lattice.states), LOW)
    at = words.at([p for p in parts if len(p) <= CHUNK])
    out[0, 0] = words.score[at].sum()
    out[0, 0] += sum(Segment(lattice, p, 0, True, True).matrix()[0, 0] for p in parts if len(p) > CHUNK)
    return out


def segment_ids(words: Words, row: dict) -> np.ndarray:
    """Ids of a segment by its entry sums and right state, found without the other segments."""
    if row["safe_left"] and row["safe_right"]:
        return encode_span(words, row["raw"])
    segment = Segment(words.lattice, row["raw"], row["lead"], row["safe_left"], row["safe_right"])
    return np.array(segment.ids(np.frombuffer(row["enter"], "<f8"), row["state_out"] or 0), np.uint32)


SEGMENTS = "doc_id long, n long, part long, raw binary, lead int, safe_left boolean, safe_right boolean"


def _giants(docs: DataFrame, path: str, segment: int) -> DataFrame:
    """(doc_id, ids) of giant documents: segments, their matrices, sums and states at their ends,
    and then each segment's ids. A document's matrices and ids meet in one task, as its text did."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in bounded(batches, "text"):
            for doc, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "text")), strict=True):
                raw = lattice.normalise(text)
                begins = cut(raw, segment)
                for i, a in enumerate(begins):
                    b = begins[i + 1] if i + 1 < len(begins) else len(raw)
                    lead = 0 if is_safe(raw, a) else min(a, lattice.states - 1)
                    row = {"doc_id": doc, "n": n, "part": i, "raw": raw[a - lead : b], "lead": lead, "safe_left": is_safe(raw, a), "safe_right": is_safe(raw, b)}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("raw", pa.binary()), ("lead", pa.int32()), ("safe_left", pa.bool_()), ("safe_right", pa.bool_())]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path)
        for batch in batches:
            rows = batch.to_pylist()
            small = [small_matrix(words, r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("part"), pa.array([m.shape[1] for m in small], pa.int32()), pa.array([m.astype("<f8").tobytes() for m in small], pa.binary())], names=["n", "part", "wide", "matrix"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = lattice_of(path).states
        for batch in batches:
            for r in batch.to_pylist():
                parts, sums = sorted(r["all"], key=lambda p: p["part"]), [_start(lattice_of(path))]
                for p in parts[:-1]:
                    m = np.frombuffer(p["matrix"], "<f8").reshape(-1, p["wide"])
                    after = np.full(states, LOW)
                    after[: m.shape[1]] = np.maximum((sums[-1][: len(m), None] + m).max(0), LOW)
                    sums.append(after)
                yield pa.RecordBatch.from_arrays([pa.array([r["n"]] * len(parts), pa.int64()), pa.array([p["part"] for p in parts], pa.int64()), pa.array([x.astype("<f8").tobytes() for x in sums], pa.binary())], names=["n", "part", "enter"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [Segment(lattice, r["raw"], r["lead"], False, r["safe_right"]).lefts(np.frombuffer(r["enter"], "<f8"), [0] if r["safe_right"] else list(range(lattice.states))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("part"), pa.array(found, pa.list_(pa.int32()))], names=["n", "part", "lefts"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: dict[int, int] = {}
                for p in sorted(r["all"], key=lambda p: -p["part"]):
                    out[p["part"] - 1] = p["lefts"][out.get(p["part"], 0)]
                yield pa.RecordBatch.from_arrays([pa.array([r["n"]] * len(out), pa.int64()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int32())], names=["n", "part", "state_out"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path)
        for batch in batches:
            found = [segment_ids(words, r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("part"), _ids_column(found)], names=["doc_id", "n", "part", "ids"])

    numbered = docs.withColumn("n", F.monotonically_increasing_id())
    parts = stored(numbered.mapInArrow(deal, SEGMENTS).repartition("n", "part"))
    matrices = parts.select("n", "part", "raw", "lead", "safe_left", "safe_right").mapInArrow(weigh, "n long, part long, wide int, matrix binary")
    sums = matrices.groupBy("n").agg(F.collect_list(F.struct("part", "wide", "matrix")).alias("all")).mapInArrow(enter, "n long, part long, enter binary")
    entered = parts.join(stored(sums), ["n", "part"])
    maps = entered.where("not safe_left").mapInArrow(reach, "n long, part long, lefts array<int>")
    states = maps.groupBy("n").agg(F.collect_list(F.struct("part", "lefts")).alias("all")).mapInArrow(settle, "n long, part long, state_out int")
    traced = entered.join(states, ["n", "part"], "left").mapInArrow(trace, "doc_id long, n long, part long, ids binary")
    joined = traced.groupBy("n").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("all"))
    return joined.select("doc_id", F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["ids"])), "")).alias("ids"))


@in_batches
def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT) -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of every text; documents over ``giant`` bytes are dealt out by segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(model)
        for batch in bounded(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _ids_column(encode_texts(words, batch.column("text").to_pylist()))], names=["doc_id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    large = F.coalesce(F.octet_length("text") > giant, F.lit(False))
    return kept.where(~large).mapInArrow(run, "doc_id long, ids binary").unionByName(_giants(kept.where(large), model, giant // 2))


@in_batches
def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in bounded(batches, "ids", 1 << 20):
            texts = [None if i is None else pieces.decode(np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public pieces; digests of both."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
