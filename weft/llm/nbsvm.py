"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the class log-count ratio of a smoothed
multinomial Naive Bayes, and a linear model with hinge loss is fitted on them by
dual coordinate descent (Wang and Manning 2012; Hsieh et al. 2008).  The weights
are interpolated towards their mean magnitude, and margins become probabilities
by Platt scaling on a part of the sample that the fit did not see.

N-grams come from three views of a text: its words, the shapes of its words
(runs of one character class), and whether a word repeats its predecessor.

Null text counts as empty; an empty text has only the feature "no words".  Rows
with equal ids or texts are scored alike and all kept.  Without labelled rows of
both classes the score is the constant rate of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import held_out, labelled_sample, map_rows, sliced
from weft.session import ship

BITS = 18
SIZE = 1 << BITS
#: At most this many labelled rows are used to fit the model.
MAX_TRAIN_ROWS = 12_000

_shape = bytearray(range(256))
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _shape[_c] = 97
    elif 65 <= _c <= 90:
        _shape[_c] = 65
    elif 48 <= _c <= 57:
        _shape[_c] = 48
    elif _c in (9, 10, 11, 12, 13):
        _shape[_c] = 32
SHAPE = bytes(_shape)


def shapes(raw: bytes) -> list[bytes]:
    """Shapes of the words: one byte per run of a character class."""
    a = np.frombuffer(raw.translate(SHAPE), dtype=np.uint8)
    keep = np.empty(len(a), bool)
    keep[:1] = True
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep].tobytes().split()


def features(text: str) -> np.ndarray:
    """Sorted distinct indices of the text's n-gram indicators."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.array([crc32(b"none") % SIZE], np.int32)
    found = [crc32(w) for w in set(words)]
    found += [crc32(b, crc32(a) ^ 0x5BD1E995) for a, b in set(zip(words, words[1:]))]
    shape = shapes(raw)
    found += [crc32(s, 11) for s in set(shape)]
    found += [crc32(b, crc32(a, 12)) for a, b in set(zip(shape, shape[1:]))]
    found += [crc32(c, crc32(b, crc32(a, 13))) for a, b, c in set(zip(shape, shape[1:], shape[2:]))]
    same = bytes(map(bytes.__eq__, words, words[1:]))
    found += [crc32(b"\x01" * n, 14) for n in (1, 2, 3, 4) if b"\x01" * n in same]
    return np.unique(np.array(found, np.uint32) & (SIZE - 1)).astype(np.int32)


@dataclass
class Model:
    """``weights``: of the scaled indicators; ``squares``: of the ratios, for unit-length rows."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, idx: np.ndarray) -> float:
        return float(self.weights[idx].sum()) / (math.sqrt(float(self.squares[idx].sum())) or 1.0) + self.bias

    def score(self, idx: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * self.margin(idx) + self.offset))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (positive share / negative share) of each indicator, smoothed by ``alpha``."""
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for idx, label in zip(rows, y):
        (p if label > 0 else q)[idx] += 1
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float64)


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model on indicators scaled by ``r``; the last weight is the bias.

    Class costs are inverse to class sizes.
    """
    w, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norms = [math.sqrt(float(r[idx] @ r[idx])) or 1.0 for idx in rows]
    rate = max(1e-9, (y > 0).mean())
    cost = np.where(y > 0, 0.5 / rate, 0.5 / max(1e-9, 1 - rate)) * c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            idx = rows[i]
            v = r[idx] / norms[i]
            g = y[i] * (float(w[idx] @ v) + bias) - 1.0
            old = alpha[i]
            new = min(max(old - g / 2.0, 0.0), cost[i])
            if new != old:
                d = (new - old) * y[i]
                w[idx] += d * v
                bias += d
                alpha[i] = new
                largest = max(largest, abs(new - old))
        if largest < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic of a margin, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, math.log((pos + 1.0) / (neg + 1.0))
    for _ in range(50):
        z = np.clip(a * margins + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(rows: list[np.ndarray], labels: list[int], beta: float = 0.25) -> Model:
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if not rows or len(set(y)) < 2:
        rate = min(0.99, max(0.01, float((y > 0).mean()))) if rows else 0.5
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 1.0, math.log(rate / (1 - rate)))
    every = np.arange(len(rows))
    check = every[every % 5 == 0] if len(rows) >= 50 else every
    use = every[every % 5 != 0] if len(rows) >= 50 and len(set(y[every % 5 != 0])) == 2 else every
    r = log_count_ratio([rows[i] for i in use], y[use])
    w, bias = dual_coordinate_descent([rows[i] for i in use], r, y[use])
    w = (1 - beta) * np.abs(w).sum() / max(1, np.count_nonzero(w)) + beta * w
    model = Model((w * r).astype(np.float32), (r * r).astype(np.float32), beta * bias, 1.0, 0.0)
    model.slope, model.offset = platt(np.array([model.margin(rows[i]) for i in check]), y[check])
    return model


def _features_of(batches):
    for b in batches:
        yield {"doc_id": b["doc_id"], "label": b["label"], "idx": [features(t).tobytes() for t in b["text"]]}


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 4, rest: int = 2, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod ``modulus`` is not ``rest``.

    Only n-gram indices of at most ``max_rows`` rows reach the driver.
    """
    sample = labelled_sample(docs, labels, column, modulus, rest, max_rows)
    found = map_rows(sample, _features_of, "doc_id bigint, label int, idx binary").toArrow().sort_by("doc_id")
    return fit_rows([np.frombuffer(x.as_buffer(), np.int32) for x in found.column("idx")], found.column("label").to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [m.score(features(t or "")) for t in b["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, fit(docs, labels, "quality", modulus, rest)).select(
        "doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose quality score is ``threshold`` or more."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in sliced(batches):
            yield b.filter(pa.array([m.score(features(t or "")) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
