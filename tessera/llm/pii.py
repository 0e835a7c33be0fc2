"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The base patterns give emails, addresses of hosts, card and phone numbers. The
field's nodes are a document's candidate mentions (runs of digits with their
separators, mail-like forms); each has weights for its shape and the words
before it. Chain edges join neighbours; skip edges join distant mentions whose
normal forms are equal or similar (the same last seven digits, the same
mailbox), each to the next of its kind and to one that a base pattern found, so
edges grow with the text and not with its square. Loopy message passing over
all of them, until no message moves, makes a document's labels agree: a number
that is a phone in one place is found in another form elsewhere, however often
and far away. Mentions that a base pattern found are held at its kind; base spans
always stay, and the field adds the mentions that overlap none of them. What it
may add is bounded in form, not in place: runs of 7 to 25 digits with at most
two separators between, and hidden mail addresses whose parts have at most 64
characters. Neighbours over 200 characters apart don't touch.

Weights are trained on generated mentions with known labels, by
pseudo-likelihood; the seed is fixed, so every run has the same.

Cases: a null or empty text has no spans. Very long texts are taken whole;
patterns run in linear time. Repeated rows are searched once each. Other
columns are kept by ``redact`` and ignored by ``find``. An empty table gives no
rows."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
DAMPING, SURE = 0.3, 0.8
#: Messages have settled once none moves more than this. After PATIENCE rounds damping grows, which ends oscillations.
SETTLED, PATIENCE = 1e-4, 200

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As ``finditer`` would give them, but from each @ outwards: linear in runs without one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, leftmost and non-overlapping for each, by start and kind."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 2 * 19 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Words that tell what a number after them is.
CONTEXT = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "ring", "telefon", "teléfono", "téléphone"),
    "card": ("card", "visa", "payment", "credit", "debit", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "server", "address", "addr", "client"),
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
}
_WORD_KIND = {w: k for k, ws in CONTEXT.items() for w in ws}
_NUMBER = re.compile(r"(?<![\w@.])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9\w@])")
_HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,64})+", re.I)
_BEFORE = re.compile(r"[\w-]+")
N_SHAPES = 24


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str]]:
    """Spans that the field labels, with their normal forms: base spans first, then others."""
    found = {(s, e) for _, s, e in base}
    if _DIGIT.search(text):
        found |= {m.span() for m in _NUMBER.finditer(text)}
    if "(at)" in (low := text.lower()) or "[at]" in low:
        found |= {m.span() for m in _HIDDEN.finditer(text)}
    return [(s, e, normal(text[s:e])) for s, e in sorted(found)]


def normal(mention: str) -> str:
    """A form that differing ways of writing a mention share."""
    if not _DIGIT.search(mention) or "@" in mention or re.search(r"[\[(]at[\])]", mention, re.I):
        plain = re.sub(r" ?[\[(]at[\])] ?", "@", mention, flags=re.I)
        return re.sub(r" ?[\[(]dot[\])] ?", ".", plain, flags=re.I).lower()
    return re.sub("[^0-9]", "", mention)


def shape(text: str, start: int, end: int, form: str) -> list[float]:
    """A mention's features: its shape and the kind of word before it."""
    m = text[start:end]
    x = [0.0] * N_SHAPES
    x[0] = 1
    if "@" in form:
        x[1 + ("@" not in m)] = 1
    else:
        n = len(form)
        x[3 + sum(n >= k for k in (9, 10, 11, 12, 14, 17, 20))] = 1
        x[11], x[12], x[13], x[14] = m.startswith("+"), "(" in m, " " in m, "-" in m
        dots = m.split(".")
        x[15] = len(dots) == 4 and all(p.isdigit() for p in dots)
        x[16] = bool(x[15]) and all(len(p) <= 3 and int(p) <= 255 for p in dots)
        x[17] = n >= 14 and n <= 19 and luhn(form)
        parts = len(re.findall("[0-9]+", m))
        x[18 + min(parts, 4) - 1 if parts < 4 else 20] = 1
    before = _BEFORE.findall(text[max(0, start - 40) : start].lower())[-2:]
    for w in before:
        if w in _WORD_KIND:
            x[21 if _WORD_KIND[w] == "phone" else 22 if _WORD_KIND[w] == "card" else 23] = 1
    return x


EQUAL, SIMILAR, CHAIN = range(3)


def _keys(form: str) -> tuple[tuple[int, tuple[str, str]], ...]:
    return (EQUAL, ("=", form)), (SIMILAR, ("~", form.split("@")[0] if "@" in form else form[-7:]))


def edges(nodes: list[tuple[int, int, str]], held: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(node, later node, type): each to its neighbour, to the next equal and to the next similar form.

    With ``held`` (a label, or -1) each node that isn't held has an edge to a held one of an equal form, or
    else of a similar one, too: the last before it, or else the first after it."""
    out, last = [], {}
    for i, (_, _, form) in enumerate(nodes):
        if i and nodes[i][0] - nodes[i - 1][1] < 200:
            out.append((i - 1, i, CHAIN))
        for kind, key in _keys(form):
            if key in last and (kind == EQUAL or nodes[last[key]][2] != form):
                out.append((last[key], i, kind))
            last[key] = i
    if held is None or max(held, default=-1) < 0:
        return out
    near: list[dict[int, int]] = [{} for _ in nodes]
    for order in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
        seen: dict[tuple[str, str], int] = {}
        for i in order:
            for kind, key in _keys(nodes[i][2]):
                if held[i] >= 0:
                    seen[key] = i
                elif key in seen:
                    near[i].setdefault(kind, seen[key])
    known = set(out)
    for i, found in enumerate(near):
        if found:
            kind = min(found)
            link = (min(i, found[kind]), max(i, found[kind]), kind)
            if link not in known:
                out.append(link)
    return out


class Field:
    """The trained weights: shapes to labels, and an agreement matrix for each edge type."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, x: np.ndarray, links: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Label shares of every node once loopy sum-product has settled; ``held`` nodes (label, or -1) stay."""
        u = x @ self.unary
        fixed = np.flatnonzero(held >= 0)
        u[fixed] = -30
        u[fixed, held[fixed]] = 0
        if not len(links):
            return _share(u)
        a, b, kind = links.T
        source, to = np.concatenate([a, b]), np.concatenate([b, a])
        table_ = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(source), LABELS))
        for done in count():
            belief = u.copy()
            np.add.at(belief, to, msg)
            out = (belief[source] - msg[back])[:, :, None] + table_
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            step = (1 - DAMPING) * min(1.0, PATIENCE / (done + 1)) ** 2 * (new - msg)
            msg = msg + step
            if np.abs(step).max() <= SETTLED:
                break
        belief = u.copy()
        np.add.at(belief, to, msg)
        return _share(belief)


def _share(u: np.ndarray) -> np.ndarray:
    p = np.exp(u - u.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _made_number(rnd: random.Random) -> tuple[int, list[str]]:
    """A label and ways to write one made-up mention of it."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    pick = rnd.randrange(9)
    if pick == 0:
        u, h = f"{rnd.choice('abcdefgh')}{d(2)}.{rnd.choice(['lee', 'kim', 'roe'])}", f"mail{d(1)}.example"
        return 1, [f"{u}@{h}.com", f"{u} (at) {h} (dot) com", f"{u}[at]{h}.com"]
    if pick == 1:
        return 2, [".".join(str(rnd.randrange(100, 256)) for _ in range(4))] * 2
    if pick == 2:
        n = rnd.choice("3456") + d(14)
        n += next(c for c in "0123456789" if luhn(n + c))
        return 3, [n, " ".join(n[i : i + 4] for i in range(0, 16, 4)), "-".join(n[i : i + 4] for i in range(0, 16, 4))]
    if pick in (3, 4):
        a, b, c = d(3), d(3), d(4)
        return 4, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}", f"{a}{b}{c}"]
    if pick == 5:
        return 0, [d(rnd.randrange(7, 14))] * 2
    if pick == 6:
        return 0, [f"{rnd.randrange(1990, 2030)}-{d(2)}-{d(2)} {d(2)}-{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}"]
    if pick == 7:
        n = d(15)
        return 0, [n + next(c for c in "0123456789" if not luhn(n + c)), n[:13], f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"]
    return 0, [f"{d(3)}.{d(6)}", f"{d(4)}.{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)} {d(3)}"]


@lru_cache(1)
def trained(documents: int = 1500, seed: int = 11, steps: int = 1200) -> Field:
    """Weights by pseudo-likelihood on generated documents whose labels are known."""
    rnd = random.Random(seed)
    xs, ys, links = [], [], []
    for _ in range(documents):
        text, truth, seen = "", {}, set()
        made = [_made_number(rnd) for _ in range(rnd.randrange(1, 4))]
        for label, ways in (rnd.choice(made) for _ in range(rnd.randrange(1, 7))):
            words = [rnd.choice(CONTEXT[KINDS[label - 1]])] if label and rnd.random() < 0.3 else [rnd.choice(["the", "of", "on", "is", "with", "no", "it"])]
            text += " ".join(["of the", *words, ""])
            way = rnd.choice(ways if id(ways) in seen else ways[:-1])  # the last way only where another went before
            seen.add(id(ways))
            truth[len(text)] = label
            text += way + rnd.choice([". ", ", ", " and so "])
        nodes = candidates(text, [s for s in base_spans(text) if s[1] in truth])
        at = len(xs)
        links += [(a + at, b + at, k) for a, b, k in edges(nodes)]
        xs += [shape(text, *n) for n in nodes]
        ys += [truth.get(n[0], 0) for n in nodes]
    x, y, link = np.array(xs), np.array(ys), np.array(links).reshape(-1, 3)
    want = np.eye(LABELS)[y]
    unary, pair = np.zeros((N_SHAPES, LABELS)), np.zeros((3, LABELS, LABELS))
    a, b, kind = link.T
    for _ in range(steps):
        u = x @ unary
        np.add.at(u, b, pair[kind, y[a]])
        np.add.at(u, a, pair[kind, :, y[b]])
        miss = want - _share(u)
        unary += 3.0 * (x.T @ miss / len(x) - 1e-4 * unary)
        step = np.zeros_like(pair)
        np.add.at(step, (kind, y[a]), miss[b])
        np.add.at(step.transpose(0, 2, 1), (kind, y[b]), miss[a])
        pair += 6.0 * (step / len(x) - 2e-5 * pair)
    return Field(unary, pair)


def _apart(base: list[Span]):
    """A test whether (start, end) overlaps none of the spans, which are in order of their starts."""
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))

    def test(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return test


def added_spans(texts: list[str], bases: list[list[Span]], field: Field, sure: float = SURE) -> list[list[Span]]:
    """The field's own spans of each text, one message passing for all."""
    spans, xs, links, held, owner = [], [], [], [], []
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        nodes = candidates(text, base)
        known = {(s, e): KINDS.index(k) + 1 for k, s, e in reversed(base)}
        at = len(spans)
        fixed = [known.get(n[:2], -1) for n in nodes]
        links += [(a + at, b + at, k) for a, b, k in edges(nodes, fixed)]
        spans += [n[:2] for n in nodes]
        xs += [shape(text, *n) for n in nodes]
        held += fixed
        owner += [i] * len(nodes)
    out: list[list[Span]] = [[] for _ in texts]
    if not spans:
        return out
    share = field.marginals(np.array(xs), np.array(links, np.int64).reshape(-1, 3), np.array(held))
    label = share.argmax(1)
    reach, free = [0] * len(texts), [_apart(b) for b in bases]
    for n in np.flatnonzero((label > 0) & (np.array(held) < 0) & (share.max(1) >= sure)).tolist():
        s, e = spans[n]
        i = owner[n]
        if s >= reach[i] and free[i](s, e):
            out[i].append((KINDS[label[n] - 1], s, e))
            reach[i] = e
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


@in_batches
def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans): counts of the base, both lists as text."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, field)
            counts = [[sum(k == kind for k, _, _ in b) for b in bases] for kind in KINDS]
            columns = [*counts, [len(m) for m in more]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array([digest(b) for b in bases], pa.string()), pa.array([digest(b + m) for b, m in zip(bases, more, strict=True)], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@in_batches
def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with personal data in the text replaced."""
    field = trained()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            raw = batch.column(at).to_pylist()
            texts = [t or "" for t in raw]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, field)
            new = [redacted(t, b + m) for t, b, m in zip(raw, bases, more, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and spans, and all spans."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
