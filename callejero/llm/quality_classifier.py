"""Quality classifier: a linear support-vector model on naive Bayes features.

Features are indicators of n-grams (words, word pairs, and the shapes of words, in which letters,
digits and each sign are told apart), hashed into ``BUCKETS``. Over all learning rows each bucket
gets the log ratio of its smoothed shares in the two classes; indicators are scaled by it, and a
linear hinge-loss model is fitted by dual coordinate descent. Counts cover all learning rows; the
descent itself runs on the driver over at most ``FIT_ROWS`` of them, chosen by a hash of the id.

Scoring is row-local: the weights (one array of fixed size) are broadcast and no row is shuffled.
The margin becomes a score in (0, 1) by a logistic curve fitted on the rows of the descent.

Defined cases: null and empty texts have no features and score by the intercept; a null id counts
as the empty text for the fold; labels that are null are left out; a document labelled twice
counts once per label; repeated rows give repeated rows; with one class, or no label at all, the
score is that class's share (1 without labels). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_residue

FOLDS, HELD_OUT = 4, 2
BITS = 18
BUCKETS = 1 << BITS
FIT_ROWS = 6000
PREDICT_AT = 0.7
#: Labels that are broadcast (some 60 MB in memory); more are joined by a shuffle of the learning texts.
BROADCAST_LABELS = 2_000_000
SLICE = 256
#: Words that a worker remembers.
REMEMBERED = 300_000
#: Each byte's shape. Letters (and all bytes of non-ASCII letters) are a, digits 0, signs themselves.
SHAPE = bytes(97 if chr(b).isalpha() or b > 127 else 48 if chr(b).isdigit() else b for b in range(256))


class Features:
    """Sorted, distinct buckets of a text's n-grams."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def _word(self, w: bytes) -> tuple[int, int]:
        shape = w.translate(SHAPE)
        while b"aa" in shape:
            shape = shape.replace(b"aa", b"a")
        out = (zlib.crc32(w), zlib.crc32(b"\x00" + shape))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[w] = out
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        both = np.array([known.get(w) or self._word(w) for w in words], np.uint64)
        single, shape = both[:, 0], both[:, 1]
        pairs = (single[:-1] * np.uint64(0x9E3779B1) + single[1:]) >> np.uint64(7)
        shapes = (shape[:-1] * np.uint64(0x85EBCA6B) + shape[1:]) >> np.uint64(5)
        return np.unique(np.concatenate([single, shape, pairs, shapes]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by class (2), and by class and bucket, over all of ``rows`` (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros((2, BUCKETS + 1))
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y, features(t)] += 1
                total[y, BUCKETS] += 1
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["i", "n"])

    sums = rows.select("text", "label").mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # two counts per bucket at most
    flat = np.zeros(2 * (BUCKETS + 1))
    flat[table.column("i").to_numpy()] = table.column("n").to_numpy()
    counts = flat.reshape(2, BUCKETS + 1)
    return counts[:, BUCKETS], counts[:, :BUCKETS]


def log_ratios(docs: np.ndarray, counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    share = counts + alpha
    share = share / share.sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    # A bucket that no learning row has tells nothing.
    return np.where(counts.sum(0) > 0, ratio, 0.0)


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, costs: np.ndarray, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last is the intercept) of the hinge-loss model, by dual coordinate descent."""
    w = np.zeros(len(scale) + 1)
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    values = [scale[r] for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            y = labels[i]
            gradient = y * (float(w[rows[i]] @ values[i]) + w[-1]) - 1.0
            new = min(max(dual[i] - gradient / norms[i], 0.0), costs[i])
            step = (new - dual[i]) * y
            if step:
                dual[i] = new
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-5:
            break
    return w


def logistic(margins: np.ndarray, positive: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the curve from margin to share of positives, by Newton's method with softened targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        hess = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p))
        step = np.clip(step, -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, cost: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """Weights by bucket (ratios included), intercept, and the logistic curve, from (doc_id, text, label)."""
    docs, counts = class_counts(rows)
    zero = np.zeros(BUCKETS)
    if docs.min() == 0:
        share = (docs[1] + 1e-9) / (docs.sum() + 1e-9) if docs.sum() else 1.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return zero, 0.0, 1.0, float(np.log(share / (1 - share)))
    ratios = log_ratios(docs, counts)
    # Half of the rows of either class, as far as there are: rare bad documents count as much.
    half = {y: min(1.0, fit_rows / 2 / docs[y]) for y in (0, 1)}
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    part = rows.where(chance < F.when(F.col("label") == 1, half[1]).otherwise(half[0])).select("text", "label")
    features, xs, ys = Features(), [], []
    for r in part.toLocalIterator():
        xs.append(features(r["text"]))
        ys.append(1.0 if r["label"] == 1 else -1.0)
    if len(set(ys)) < 2:
        return zero, 0.0, 1.0, float(np.log(docs[1] / docs[0]))
    y = np.array(ys)
    share = {s: (y == s).mean() for s in (1.0, -1.0)}
    w = descend(xs, y, ratios, np.array([cost * 0.5 / share[s] for s in ys]) / 50.0)
    weights = w[:-1] * ratios
    margins = np.array([weights[x].sum() + w[-1] for x in xs])
    a, b = logistic(margins, y > 0)
    return weights, float(w[-1]), a, b


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("label"))
    d = docs.select("doc_id", "text").where(id_residue(FOLDS) != HELD_OUT)
    # Labels are an id and a digit: while they are few their rows go to the texts; beyond that both sides are dealt by id.
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return d.join(known, d["doc_id"] == known["labelled"]).select("doc_id", "text", "label")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(learning_rows(docs, labels), fit_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one weight per bucket
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, a, b = held.value
        features = Features()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                margins = np.array([weights[features(t)].sum() + intercept for t in part.column(2).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", (id_residue(FOLDS) == HELD_OUT).alias("held_out"), "text")
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
