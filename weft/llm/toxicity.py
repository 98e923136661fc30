"""Toxicity: maximum-scoring segments of token log-odds.

Units are words and five-letter word beginnings.  They get log-odds of the toxic
against the clean class with an informative Dirichlet prior taken from both
classes together (Monroe et al. 2008).  Units whose log-odds are significantly
high, judged by the documents that hold them, score that much; a word takes the
higher score of its two units, and every other word scores the negative
``drift``, so the expected score is negative.  A linear-time scan (Ruzzo and Tompa 1999) yields
every maximal segment.  Segment scores follow an extreme-value law (Karlin and
Altschul 1990): lambda solves sum p exp(lambda s) = 1 on the clean class, K is
fitted to the best segments of clean documents, and a segment is a significant
passage if its E-value is below ``max_e``.  A document's evidence is the sum of
its segments' normalised scores; a logistic turns it into a probability.

Null text counts as empty; documents without tokens or passages get the
probability of no evidence.  Equal rows are scored alike and all kept.  Without
labelled rows of both classes every score is the rate of label 1 (0.5 without
labels).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import held_out, labelled_sample, map_rows
from weft.llm.nbsvm import platt
from weft.llm.textsets import shingle_sets

#: At most this many labelled rows are used to fit the model.
MAX_TRAIN_ROWS = 20_000

_keep = bytearray(b" " * 256)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128 or _c == 39:
        _keep[_c] = _c
    elif 65 <= _c <= 90:
        _keep[_c] = _c + 32
KEEP = bytes(_keep)


#: Bytes that begin a word, at most, for the second kind of unit.
STEM = 5


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(KEEP).split()


def units(word: bytes) -> tuple[bytes, ...]:
    return (word,) if len(word) <= STEM else (word, word[:STEM] + b"*")


@dataclass
class Model:
    terms: dict[bytes, float]
    drift: float
    lam: float
    k: float
    slope: float
    offset: float
    max_e: float = 0.05

    def word(self, w: bytes) -> float:
        return max(self.terms.get(w, 0.0), self.terms.get(w[:STEM] + b"*", 0.0) if len(w) > STEM else 0.0)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        bar = math.log(max(self.k * n, 1e-9))
        return sum(max(0.0, self.lam * s - bar) for _, _, s in found)

    def score(self, words: list[bytes]) -> float:
        x = self.evidence(segments(words, self), len(words))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(x) + self.offset))))

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(first token, end token, score, E-value) of each significant segment."""
        n = max(1, len(words))
        found = ((a, b, s, self.k * n * math.exp(-self.lam * s)) for a, b, s in segments(words, self))
        return [x for x in found if x[3] <= self.max_e]


def segments(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, end token, score), in order.

    Each scored token is a one-token candidate; the drift between two of them
    enters the running total, so a text of n tokens with h hits takes O(n + h).
    """
    hits = [(i, model.word(w)) for i, w in enumerate(words) if w in model.terms or w[:STEM] + b"*" in model.terms]
    stack: list[list] = []  # [start, end, total before, total after, index of the nearest lower left neighbour]
    total, at = 0.0, 0
    for i, s in hits:
        total -= model.drift * (i - at)
        at = i + 1
        seg = [i, i + 1, total, total + s, -1]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                seg[4] = j
                stack.append(seg)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3], -1]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for a negative mean score."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 500))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _count(batches):
    n: dict = {}
    seen = Counter()
    for b in batches:
        for text, label in zip(b["text"], b["label"]):
            words = Counter(tokens(text))
            seen[label] += 1
            seen[label, "n"] += words.total()
            found = Counter()
            for w, k in words.items():
                for u in units(w):
                    found[u] += k
            for u, k in found.items():
                at = n.setdefault((u, label), [0, 0])
                at[0] += 1
                at[1] += k
        if len(n) > 400_000:
            yield _counts(n)
            n.clear()
    yield _counts(n | {(None, x): [seen[x], seen[x, "n"]] for x in seen if not isinstance(x, tuple)})


def _counts(n):
    return {"unit": [k[0] for k in n], "label": [k[1] for k in n], "docs": [v[0] for v in n.values()], "n": [v[1] for v in n.values()]}


def terms_of(sample: DataFrame, z_least: float = 3.0, prior: float = 500.0) -> tuple[list, int, int]:
    """[(unit, log-odds, occurrences in clean documents)] of units whose document log-odds have a z-score of ``z_least`` or more; documents of each class."""
    counts = map_rows(sample.select("text", "label"), _count, "unit binary, label int, docs bigint, n bigint")
    toxic = F.col("label") > 0
    by = counts.groupBy("unit").agg(
        *(F.sum(F.when(toxic, F.col(x)).otherwise(0)).alias(f"t_{x}") for x in ("docs", "n")),
        *(F.sum(F.when(toxic, 0).otherwise(F.col(x))).alias(f"c_{x}") for x in ("docs", "n")),
    ).persist()
    total = by.where(F.col("unit").isNull()).first()
    dt, dc = (total["t_docs"], total["c_docs"]) if total else (0, 0)
    if not dt or not dc:
        by.unpersist()
        return [], dt, dc

    def odds(x: str, weight: float):
        t, c, nt, nc = F.col(f"t_{x}"), F.col(f"c_{x}"), total[f"t_{x}"], total[f"c_{x}"]
        a = (t + c) * (weight / max(1, nt + nc))
        up = F.log((t + a) / (nt + 1 + weight - t - a)) - F.log((c + a) / (nc + 1 + weight - c - a))
        return up, up / F.sqrt(1 / (t + a) + 1 / (c + a))

    up, z = odds("n", prior)[0], odds("docs", 50.0)[1]
    rows = (
        by.where(F.col("unit").isNotNull() & (F.col("t_docs") >= 3)).select("unit", "c_n", up.alias("up"), z.alias("z"))
        .where((F.col("z") >= z_least) & (F.col("up") > 0)).orderBy(F.desc("z"), "unit").collect()
    )
    by.unpersist()
    return [(bytes(r["unit"]), r["up"], r["c_n"]) for r in rows], dt, dc


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 3, rest: int = 1, max_rows: int = MAX_TRAIN_ROWS, drift: float = 0.25) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod ``modulus`` is not ``rest``.

    Copies and near copies in the sample, those whose two smallest shingle hashes
    agree, count once, with the higher label of theirs, so the words of one much-copied document are no evidence.  So do all texts without
    words.  The driver gets every significant token, which three toxic rows of the sample
    must hold, and two numbers for each sampled row.
    """
    sample = labelled_sample(docs, labels, column, modulus, rest, max_rows)
    sample = map_rows(sample.select("text", "label"), _near, "near binary, text string, label int")
    sample = sample.groupBy("near").agg(F.max(F.struct("label", "text")).alias("x")).select("x.text", "x.label").persist()
    try:
        rows, nt, nc = terms_of(sample)
        rate = min(0.99, max(0.01, nt / (nt + nc))) if nt + nc else 0.5
        plain = Model({}, drift, 1.0, 1.0, 1.0, math.log(rate / (1 - rate)))
        if not rows:
            return plain
        model = Model({w: s for w, s, _ in rows}, drift, 1.0, 1.0, 1.0, 0.0)
        best = map_rows(sample, _best(sample, model), "label int, n bigint, best double").toPandas()
        clean = best[(best["label"] <= 0) & (best["n"] > 0)]
        n_clean = float(clean["n"].sum()) or 1.0
        p = np.array([max(c, 0.5) / n_clean for _, _, c in rows])
        model.lam = solve_lambda(np.append(p, max(1e-9, 1 - p.sum())), np.append([s for _, s, _ in rows], -drift))
        # Mean of a Gumbel law: lambda S - ln n = ln K + 0.5772 where a segment exists.
        model.k = math.exp(float(np.mean(model.lam * clean["best"] - np.log(clean["n"]))) - 0.5772) if len(clean) else 1.0
        x = map_rows(sample, _evidence(sample, model), "label int, x double").toPandas()
        y = np.where(x["label"] > 0, 1.0, -1.0)
        model.slope, model.offset = platt(np.log1p(x["x"].to_numpy()), y) if len(set(y)) > 1 else (plain.slope, plain.offset)
        return model
    finally:
        sample.unpersist()


def _near(batches):
    for b in batches:
        yield {"near": [s[:2].tobytes() for s in shingle_sets(b["text"], 3)], "text": b["text"], "label": b["label"]}


def _best(sample, model):
    def run(batches):
        for b in batches:
            words = [tokens(t) for t in b["text"]]
            yield {"label": b["label"], "n": [len(w) for w in words], "best": [max((s for *_, s in segments(w, model)), default=0.0) for w in words]}

    return run


def _evidence(sample, model):
    def run(batches):
        for b in batches:
            words = [tokens(t) for t in b["text"]]
            yield {"label": b["label"], "x": [model.evidence(segments(w, model), len(w)) for w in words]}

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, passages) for every row; passages hold (first, end, score, e_value) by token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            words = [tokens(t or "") for t in b["text"]]
            found = [m.passages(w) for w in words]
            yield {
                "doc_id": b["doc_id"], "score": [m.score(w) for w in words], "n_passages": [len(x) for x in found],
                "passages": [[{"first": a, "end": z, "score": s, "e_value": e} for a, z, s, e in x] for x in found],
            }

    schema = "doc_id bigint, score double, n_passages bigint, passages array<struct<first: bigint, end: bigint, score: double, e_value: double>>"
    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for every document."""
    return scan(docs, fit(docs, labels, "toxic", modulus, rest)).select(
        "doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages",
    )
