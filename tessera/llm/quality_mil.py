"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, all of them. Each passage
is encoded: shares of character classes and figures of its trigrams, then a
learned layer. Gated attention, tanh(Vh) * sigmoid(Uh), gives each passage a
weight within its bag, learned from document labels alone; the score is the
logistic of the weighted passage representation.

Training takes whole documents: at most ``SAMPLE`` labelled ones, those with
the least hashed ids, as far as their passages come to ``PASSAGES`` at most
(one that would go beyond is passed over, later ones may still fit), and none
whose crc32(doc_id as text) modulo 4 is 2; these are held out. Scoring takes every passage, in one pass without a shuffle; a long text's
are measured ``SLICE`` bytes at a time. Labels, language, source and id are
never inputs of a score.

Cases: null and empty texts are one passage of no characters and get a score
like any other. Null labels are left out; conflicting labels of a document
count as 0; of the texts that share an id that with the least hash is fitted.
Equal texts have equal scores. Repeated rows are scored once each.
Where labels are too few or of one kind, the score is that share of ones.
Other columns are kept by ``keep``. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, in_batches, table

PASSAGE, SAMPLE, PASSAGES, THRESHOLD = 512, 4000, 1 << 16, 0.7
SLICE = PASSAGE << 11
HIDDEN, GATE, ROUNDS, SEED = 24, 16, 400, 7
TRIGRAM_BINS, DECAY = 512, 1e-4


def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line feed, other control, high, or its own mark."""
    out = np.full(256, 5, np.int64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[ord(" ")], out[ord("\n")], out[128:] = 3, 4, 6
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = np.arange(7, 7 + len(marks))
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + 4


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage in order, and the number of passages of each text (1 at least)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bags = np.array([max(1, -(-len(r) // PASSAGE)) for r in raw], np.int64)
    # Slices end where passages do, which no feature reaches across.
    pieces = [r[i : i + SLICE] for r in raw for i in range(0, len(r) or 1, SLICE)]
    made, some, size = [], [], 0
    for piece in [*pieces, None]:
        if some and (piece is None or size + len(piece) > SLICE):
            made.append(_features(some))
            some, size = [], 0
        if piece is not None:
            some.append(piece)
            size += len(piece)
    return np.concatenate(made) if made else np.zeros((0, N_FEATURES), np.float32), bags


def _features(raw: list[bytes]) -> np.ndarray:
    sizes = np.array([len(r) for r in raw], np.int64)
    bags = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.cumsum(bags) - bags, sizes) + inside // PASSAGE
    n = int(bags.sum())
    length = np.maximum(1, np.bincount(owner, minlength=n))[:, None]
    shares = np.bincount(owner * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / length
    wide = data.astype(np.int64)
    code = (wide[:-2] * 961 + wide[1:-1] * 31 + wide[2:]) % TRIGRAM_BINS if len(data) > 2 else np.zeros(0, np.int64)
    whole = owner[:-2] == owner[2:] if len(data) > 2 else np.zeros(0, bool)
    grams = np.bincount(owner[:-2][whole] * TRIGRAM_BINS + code[whole] if len(code) else code, minlength=n * TRIGRAM_BINS).reshape(n, TRIGRAM_BINS) / length
    words = (shares[:, 3] + shares[:, 4])[:, None]
    figures = np.concatenate([(grams > 0).mean(1, keepdims=True), np.sqrt((grams**2).sum(1, keepdims=True)), grams.max(1, keepdims=True), words / (1 - words + 1e-3)], 1)
    return np.concatenate([np.sqrt(shares), figures], 1).astype(np.float32)


@dataclass
class Model:
    """Scales of the features and the layers' weights."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        scaled = np.clip((x.astype(np.float64) - self.mean) / self.scale, -6, 6)
        return np.round(_forward(self.w, scaled, np.cumsum(bags) - bags, bags)["p"], 9)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["e"] + w["eb"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    s = (t * g) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, start), bags))
    a = s / np.repeat(np.add.reduceat(s, start), bags)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the log loss over documents."""
    if len(y) < 20 or len(np.unique(y)) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(SEED)
    w = {"e": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "eb": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "cb": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    start, bag_of = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
    for step in range(1, ROUNDS + 1):
        for k, d in gradients(w, x, start, bags, bag_of, y).items():
            m[k] += 0.1 * (d - m[k])
            v2[k] += 0.01 * (d * d - v2[k])
            w[k] = (w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, bags: np.ndarray, bag_of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean log loss over documents and ``DECAY`` / 2 times the weights' squares."""
    f = _forward(w, x, start, bags)
    dp = ((f["p"] - y) / len(y)).astype(x.dtype)
    dz = dp[:, None] * w["c"]
    dzi = dz[bag_of]
    da = (dzi * f["h"]).sum(1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[bag_of])
    dtg = ds[:, None] * w["a"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dzi + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    grad = {"c": f["z"].T @ dp, "cb": dp.sum(keepdims=True), "a": (f["t"] * f["g"]).T @ ds, "v": f["h"].T @ dt, "u": f["h"].T @ dg, "e": x.T @ dh, "eb": dh.sum(0)}
    return {k: d + DECAY * w[k] for k, d in grad.items()}


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from training; a null id's aren't known."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            x, bags = passage_features(batch.column("text").to_pylist())
            if model is None:
                parts = np.split(x, np.cumsum(bags)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "x"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x, bags).astype(np.float64))], names=["doc_id", "score"])

    return run


@in_batches
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out, all passages of each.

    The sample's ids, labels and sizes are at most ``sample`` rows and so are joined by broadcast; features of
    at most ``passages`` passages, not texts, come to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    drawn = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("doc_id", "t.text")
    y = {r.doc_id: r.y for r in drawn.collect()}
    sizes = chosen.select("doc_id", F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)).alias("n"), F.xxhash64("doc_id").alias("h"))
    whole = _within(sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id)), passages)
    taken = docs.sparkSession.createDataFrame([(i,) for i in whole], "doc_id long")
    bags = chosen.join(F.broadcast(taken), "doc_id", "left_semi").mapInArrow(_scorer(None), "doc_id long, x binary")
    rows = sorted(bags.toLocalIterator(), key=lambda r: r.doc_id)
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    every = np.concatenate(x) if x else np.zeros((0, N_FEATURES), np.float32)
    return fit(every, np.array([len(b) for b in x], np.int64), np.array([y[r.doc_id] for r in rows], np.float32))


def _within(sizes: list, passages: int) -> list[int]:
    """The documents, in their order, whose passages fit into what is left of ``passages``."""
    out = []
    for r in sizes:
        if r.n <= passages:
            out.append(r.doc_id)
            passages -= r.n
    return out


@in_batches
def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scorer(model), "doc_id long, score double")


@in_batches
def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col, 1 << 20):
            good = model.score(*passage_features(batch.column(at).to_pylist())) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, fitted on labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
