"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by class log-count ratios, then a linear model
with hinge loss is fitted by dual coordinate descent.

The indicators are n-grams of three streams of a text, hashed into ``DIMS``
slots: its bytes, its shape (each byte reduced to a class, runs collapsed), and
for each word whether it repeats one shortly before.  They say how a text is
written, so that a model carries over to words that no labelled row holds.

The model is fitted on at most ``FIT_ROWS`` labelled rows, those whose ids have
the smallest hashes, and of these on as many as have ``FIT_BYTES`` of indicators
together.  Their ids, never more than that, are broadcast to find the texts;
Spark reduces these to one for each id; their indicators come to the driver.
Scoring is one pass over the documents without a shuffle.  Margins become scores by a logistic curve, which
is fitted on a fifth of those rows that the support vectors did not see.

Defined results: null and empty texts have no indicators and get the score of
the model's intercept; repeated rows score alike; a document with several labels
counts as the lowest, an id with several texts as the one with the smallest
hash; null labels and ids are left out of the fit; very long texts are scored
whole; an empty table stays empty.  Where the
labels hold fewer than two classes every score is the share of label 1, or 0.5
without any labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import materialize

#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 8000
#: Bytes of their indicators, at most (4 for each distinct slot of a text).
FIT_BYTES = 128 << 20
DIMS = 1 << 17
EPOCHS = 12
COST = 1.0

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 17)


def _classes() -> np.ndarray:
    """Byte -> class: capitals A, other letters a, digits 0, each sign itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = 65
    table[97:123] = 97
    table[48:58] = 48
    table[128:] = 97
    table[[9, 11, 12, 13]] = 32
    return table


_CLASS = _classes()
_BYTE = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(12).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)


def _grams(stream: np.ndarray, sizes: range, tag: int) -> list[np.ndarray]:
    """Hashed n-grams of a stream of small numbers."""
    out, h = [], np.full(len(stream), np.uint64(tag))
    wide = stream.astype(np.uint64) + np.uint64(1)
    for n in range(1, sizes.stop):
        if n > len(stream):
            break
        h = (h[: len(stream) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1 :]) * _MULTIPLIER
        if n in sizes:
            out.append((h ^ (h >> np.uint64(31))) * _MULTIPLIER >> _SHIFT)
    return out


def repeats(raw: np.ndarray) -> np.ndarray:
    """For each word its distance (1 to 4) to the same word before it, or 0."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint8)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))), axis=0) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    word = np.add.reduceat(np.where(inside, _BYTE[raw] * _PLACE[place & 63], np.uint64(0)), starts)
    out = np.zeros(len(word), np.uint8)
    for back in (4, 3, 2, 1):
        if len(word) > back:
            out[back:][word[back:] == word[:-back]] = back
    return out


class Indicators:
    """Distinct slots of a text; keeps one buffer to find them without sorting."""

    def __init__(self) -> None:
        self.last = np.zeros(DIMS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64)
        shape = _CLASS[raw]
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
        slots = np.concatenate([*_grams(raw, range(3, 4), 1), *_grams(shape, range(2, 7), 2), *_grams(repeats(raw), range(1, 4), 3), np.zeros(0, np.uint64)]).astype(np.int64)
        place = np.arange(len(slots))
        self.last[slots] = place
        return slots[self.last[slots] == place]


@dataclass(frozen=True)
class Model:
    """margin = sum(weights of the slots) / norm of their ratios + bias; score = logistic(slope * margin + offset)."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        r = self.ratios[slots]
        norm = math.sqrt(float(r @ r))
        return (float(self.weights[slots].sum()) / norm if norm else 0.0) + self.bias

    def score(self, slots: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.slope * self.margin(slots) + self.offset))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.ones((2, DIMS))
    for slots, g in zip(rows, good, strict=True):
        counts[int(g), slots] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised linear model with hinge loss.

    One dual variable in [0, cost] for each row; the bias is the weight of a
    constant 1.
    """
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(cost, max(0.0, alpha[i] - gradient / square[i]))
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                largest = max(largest, abs(step))
        if largest < 1e-3 * cost:
            break
    return w, bias


def logistic_fit(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    if good.all() or not good.any():
        share = min(1 - 1e-6, max(1e-6, float(good.mean()))) if len(good) else 0.5
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, math.log(share / (1 - share)))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        held[:] = False
    used = np.flatnonzero(~held)
    ratios = log_count_ratios([rows[i] for i in used], good[used])
    values = [(r := ratios[rows[i]]) / max(1e-12, math.sqrt(float(r @ r))) for i in used]
    w, bias = dual_coordinate_descent([rows[i] for i in used], values, np.where(good[used], 1.0, -1.0), DIMS)
    bare = Model(ratios, ratios * w, bias, 1.0, 0.0)
    judged = np.flatnonzero(held) if held.any() else used
    slope, offset = logistic_fit(np.array([bare.margin(rows[i]) for i in judged]), good[judged])
    return Model(ratios.astype(np.float32), (ratios * w).astype(np.float32), bias, slope, offset)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, with at most ``fit_bytes`` of indicators."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
    sample = known.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "k")
    one = texts.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Indicators()
        for b in batches:
            found = pa.array((slots(t.as_py()).astype(np.int32).tobytes() for t in b.column("t")), pa.binary(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), found], names=["k", "y", "s"])

    kind = docs.schema[key].dataType.simpleString()
    found = materialize(one.select("k", F.col("y").cast("int").alias("y"), "t").mapInArrow(run, f"k {kind}, y int, s binary"))
    in_order = [F.xxhash64("k"), "k"]
    sizes = np.cumsum([r[0] for r in found.orderBy(*in_order).select(F.octet_length("s")).collect()])
    rows = found.orderBy(*in_order).limit(int(np.searchsorted(sizes, fit_bytes, "right"))).select("y", "s").collect()
    return fit([np.frombuffer(r.s, np.int32) for r in rows], np.array([r.y for r in rows], int) == 1)


def classify(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Every row with its score; a column of that name is replaced."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = Indicators()
        for texts in batches:
            yield pa.array((model.score(slots(t.as_py())) for t in texts), pa.float64(), size=len(texts))

    return docs.withColumn(score, F.arrow_udf(scored, "double")(F.coalesce(F.col(text), F.lit(""))))
