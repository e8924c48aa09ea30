"""Quality classifier: support vectors on naive Bayes features.

Indicators of n-grams (byte trigrams, words, bigrams and trigrams of word shapes) are hashed into a fixed space and
scaled by class log-count ratios; a linear hinge-loss model is fit on them by dual coordinate descent. Margins become
scores by a logistic curve fit on cross-validated margins, weighted to the class shares of all labelled rows.

Only the fit is bounded: at most ``per_class`` labelled rows of either class, the first by hash of their id, reach one
task as feature ids. The model is one float for each of DIM features, whatever the corpus. Scoring is one pass
over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, text_of

BYTES, WORDS, SHAPES2, SHAPES3 = 1 << 16, 1 << 16, 1 << 14, 1 << 16
DIM = BYTES + WORDS + SHAPES2 + SHAPES3
#: Bytes looked at together, so that memory stays bounded on very long texts.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_KIND = np.zeros(256, np.uint8)  # upper, lower, digit, stop, other mark, beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 32
_KIND[[*b".,;:?!'-"]] = 8
_KIND[[i for i in range(33, 127) if not _KIND[i]]] = 16
_VALUE = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint32)
_POWER = ((np.arange(1, 257, dtype=np.uint64) * 0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of 32-bit values to so many bits."""
    return ((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def indicators(text: str | None) -> np.ndarray:
    """Sorted ids of the features that occur in a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(DIM, bool)
    tail, last, at = np.zeros(0, np.uint32), None, 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):  # cut after white space, so that no word is split
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        b, more = data[at:end], data[at:end + 2].astype(np.uint32)
        at = end
        if len(more) > 2:
            seen[_fold((more[:-2] << np.uint32(16)) | (more[1:-1] << np.uint32(8)) | more[2:], 16)] = True
        gap = _SPACE[b]
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        if not len(starts):
            continue
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.concatenate(
            (np.zeros(starts[0], np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))))
        )
        word = np.add.reduceat(_VALUE[b] * _POWER[place & 255], starts, dtype=np.uint32)
        seen[BYTES + _fold(word, 16)] = True
        before = np.concatenate(([word[0] ^ np.uint32(1) if last is None else last], word[:-1]))
        last = word[-1]
        shape = np.bitwise_or.reduceat(_KIND[b], starts).astype(np.uint32) | ((word == before).astype(np.uint32) << np.uint32(6))
        shape = np.concatenate((tail, shape))
        tail = shape[-2:]
        if len(shape) > 1:
            two = (shape[:-1] << np.uint32(7)) | shape[1:]
            seen[BYTES + WORDS + two.astype(np.int64)] = True
            if len(shape) > 2:
                seen[BYTES + WORDS + SHAPES2 + _fold((two[:-1] << np.uint32(7)) | shape[2:], 16)] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the smoothed share of each feature in the positive rows over that in the negative rows."""
    total = []
    for sign in (1, -1):
        count = np.full(DIM, smooth)
        for row, label in zip(rows, y):
            if label == sign:
                count[row] += 1
        total.append(np.log(count / count.sum()))
    return total[0] - total[1]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights and bias. Rows are visited in a seeded order; ends early when no step is left."""
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(42)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-4 * cost:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve that turns margins into probabilities (Newton steps, smoothed targets)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([g @ margin + 1e-3 * (a - 1), g.sum()]))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a, b


class Model:
    """Weight of every feature, with the curve's slope and offset folded in."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset = weights.astype(np.float32), float(offset)

    def score(self, text: str | None) -> float:
        z = float(self.weights[indicators(text)].sum(dtype=np.float64)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, cost: float = 0.01, folds: int = 3) -> Model:
    """Fit on feature ids with labels of 1 and -1; ``share`` is the share of label 1 in all labelled rows.

    Without rows of both classes there is nothing to tell apart: every score is the share of label 1.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM), np.log(share / (1 - share)))

    def train(keep: np.ndarray) -> tuple[np.ndarray, float]:
        chosen, labels = [rows[i] for i in keep], y[keep]
        ratio = log_count_ratio(chosen, labels)
        w, bias = dual_coordinate_descent(chosen, [ratio[r] for r in chosen], labels, cost)
        return w * ratio, bias

    part = np.zeros(len(rows), np.int64)
    for sign in (1, -1):
        own = np.flatnonzero(y == sign)
        part[own] = np.arange(len(own)) % folds
    margin = np.zeros(len(rows))
    for k in range(folds):
        if min(np.sum(y[part != k] > 0), np.sum(y[part != k] < 0)) == 0:
            continue
        w, bias = train(np.flatnonzero(part != k))
        for i in np.flatnonzero(part == k):
            margin[i] = w[rows[i]].sum() + bias
    weight = np.where(y > 0, share / max(1, np.sum(y > 0)), (1 - share) / max(1, np.sum(y < 0))) * len(y)
    a, b = _logistic(margin, y, weight)
    w, bias = train(np.arange(len(rows)))
    return Model(a * w, a * bias + b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pa.array([indicators(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), got], names=["quality", "features"])


def _fit_rows(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """One model from all rows of a task, in an order that doesn't depend on how they arrive."""
    got = sorted((q, bytes(f)) for b in batches for q, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    model = fit([np.frombuffer(f, np.int32) for _, f in got], np.array([1 if q else -1 for q, _ in got]), share)
    yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "offset": [model.offset]})


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train_model(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out fold, at most ``per_class`` of each class.

    A document labelled both ways, or with a null, is not used.
    """
    told = labels.where("quality in (0, 1) and doc_id is not null").where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")
    ).where("quality = other").select("doc_id", F.col("quality").cast("int").alias("quality"))
    there = told.join(docs.select("doc_id").distinct(), "doc_id")
    first = there.withColumn("order", F.xxhash64("doc_id"))
    share = there.agg(F.avg("quality")).first()[0]
    if share is None:
        return Model(np.zeros(DIM), 0.0)
    # Ids alone are sorted here; each class's first ones are a bounded set that may be broadcast.
    chosen = first.where("quality = 1").orderBy("order", "doc_id").limit(per_class).unionByName(first.where("quality = 0").orderBy("order", "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")
    rows = map_arrow(texts.select("quality", "text"), _features, "quality int, features binary").repartition(1)
    fitted = map_arrow(rows, partial(_fit_rows, share=share), "weights binary, offset double").first()
    return Model(np.frombuffer(fitted[0], np.float32), fitted[1]) if fitted else Model(np.zeros(DIM), 0.0)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = pa.array([model.score(t.as_py()) for t in batch.column(0)], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], names=[*batch.schema.names[1:], "score"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2000) -> DataFrame:
    """Quality of every row: doc_id, held_out, score, predicted.

    The score depends on the text alone; null counts as empty, and an empty text gets the score of no evidence.
    Repeated rows are scored alike; an empty table gives no rows. Other columns of either table are ignored. A
    null id is hashed as the empty text for held_out.
    """
    model = train_model(docs, labels, per_class)
    rows = docs.select(text_of().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    scored = map_arrow(rows, partial(_scores, model=model), "doc_id long, score double")
    fold = F.coalesce(fold_of(F.col("doc_id")), F.lit(0))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accepted(batches: Iterator[pa.RecordBatch], model: Model, threshold: float, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [model.score(t.as_py()) >= threshold for t in batch.column(batch.schema.get_field_index(column))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2000) -> DataFrame:
    """The rows that the classifier scores ``threshold`` or more, all columns, in one pass without a shuffle.

    Each row is judged by its own text, whatever its id: null counts as empty and stays null, repeated rows and rows without an id stay or go alike. Without
    labels of both classes every score is the share of label 1 (one half without any). An empty table gives no rows; columns of any name come back as they were.
    """
    model = train_model(docs, labels, per_class)
    return map_arrow(docs, partial(_accepted, model=model, threshold=threshold, column="text"), docs.schema)
