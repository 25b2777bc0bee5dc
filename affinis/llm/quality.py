"""Quality classification by naive Bayes support vectors over byte n-grams.

Indicators of hashed n-grams are scaled by their classes' log-count ratio and by the vector's length; a linear model
with hinge loss is fitted to them by dual coordinate descent, and a logistic curve turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_share, give_back, small_batches, with_added
from ._words import buffers

BITS = 17
ORDERS = (1, 2, 3, 4)
#: Labelled rows of each class that a model is fitted on, about.
ROWS_PER_CLASS = 3000
#: N-grams of such a row that it is fitted with; of more, those first in the order of a hash. (Scores use all.)
GRAMS_PER_ROW = 8192
_MULTIPLY = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


class Featuriser:
    """Indexes of the n-grams that a text holds, each once."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        wide = b.astype(np.uint32) + np.uint32(1)
        for n in ORDERS:
            if len(b) < n:
                break
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h ^= wide[j : len(h) + j] * _MULTIPLY[j]
                if j:
                    h *= np.uint32(0x2C1B3C6D)
            self.seen[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def first_of(grams: np.ndarray, most: int) -> np.ndarray:
    """At most so many of these indexes, by a hash of each, in order."""
    if len(grams) <= most:
        return grams
    return np.sort(grams[np.argsort(grams * np.uint32(0x85EBCA77), kind="stable")[:most]])


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for r, c in zip(rows, y, strict=True):
        (p if c == 1 else q)[r] += 1  # a row holds an index once
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, passes: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise half their squares plus cost times the hinge loss, over scaled indicators of length one."""
    rnd = np.random.default_rng(5)
    w, bias, alpha = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(rows))
    values = [r[x] / max(float(np.sqrt((r[x] ** 2).sum())), 1e-6) for x in rows]
    square = np.array([float((v**2).sum()) for v in values]) + 1.0
    for _ in range(passes):
        most = 0.0
        for i in rnd.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (float(w[x] @ v) + bias) - 1.0
            to = min(max(alpha[i] - g / square[i], 0.0), cost)
            if (step := to - alpha[i]) != 0.0:
                most = max(most, abs(step))
                alpha[i] = to
                w[x] += np.float32(step * y[i]) * v
                bias += step * y[i]
        if most < tolerance:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), classes weighted alike, by Newton's method with a small ridge."""
    t = (y > 0).astype(float)
    weight = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    x, ab = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)) - 1e-3 * ab)
        ab += step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


@dataclass
class Model:
    """ratio: the log-count ratios; weights: of indicators, before they are divided by their length."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum()) / max(float(np.sqrt((self.ratio[found] ** 2).sum())), 1e-6) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(found) + self.b, -30, 30))))


def _train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = log_count_ratio(rows, y)
    w, bias = descend(rows, y, ratio)
    return Model(ratio, w * ratio, bias, 1.0, 0.0)


def train(rows: list[np.ndarray], y: np.ndarray, share: float, folds: int = 3) -> Model:
    """y: 1 or -1; share: of class 1 among all labelled rows. The curve is fitted to margins of rows left out in turn."""
    if not len(rows) or len(set(y.tolist())) < 2:  # nothing to tell apart: every score is the share
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % folds
    margin = np.zeros(len(rows))
    for k in range(folds):
        ours = fold != k
        if len(set(y[ours].tolist())) == 2:
            part = _train([r for r, o in zip(rows, ours, strict=True) if o], y[ours])
            for i in np.flatnonzero(~ours):
                margin[i] = part.margin(rows[i])
    model = _train(rows, y)
    model.a, model.b = logistic(margin, y)
    model.b += float(np.log(share / (1 - share)))
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn from about rows_per_class labelled rows of each class, chosen by a hash of the key.

    The chosen keys (2 * rows_per_class of them, about) are broadcast to the texts, and the n-grams of those, of each
    GRAMS_PER_ROW at most, come to the driver. A key labelled more than once takes the majority; null labels and keys, and labels without a text, are
    left out.
    """
    small_batches(docs.sparkSession)
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key"))
    one = one.agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    counts = {r[0]: r[1] for r in one.groupBy("__label").count().collect()}
    chosen = bounded_share(one, "__key", "__label", rows_per_class)
    found = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key").select("__key", "__text", "__label")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Featuriser()
        for b in it:
            data, at = buffers(b.column(1))
            rows = [first_of(grams(data[at[i] : at[i + 1]]).astype(np.uint32), GRAMS_PER_ROW).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["key", "label", "grams"])
        give_back()

    kind = found.schema["__key"].dataType.simpleString()
    got = found.mapInArrow(batches, f"key {kind}, label int, grams binary").toArrow()
    keys = list(zip(got["key"].to_pylist(), got["grams"].to_pylist(), strict=True))
    got = got.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
    del keys
    rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in got["grams"]]
    total = sum(counts.values())
    model = train(rows, np.where(got["label"].to_numpy() > 0, 1, -1), counts.get(1, 0) / total if total else 0.5)
    del rows, got
    give_back()  # the driver goes on to other stages
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every row of docs with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= threshold) added.

    Nothing is shuffled. Whole texts count, whatever their length; a null or empty text has no n-grams and gets the
    score of the model's bias. Repeated rows stay, and columns of docs with the names of added ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = [*docs.columns, "score"]
    place = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Featuriser()
        for b in it:
            data, at = buffers(b.column(place))
            scores = [model.score(grams(data[at[i] : at[i + 1]])) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=names)
        give_back()

    out = docs.mapInArrow(batches, with_added(docs, "score double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

