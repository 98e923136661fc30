"""Longer strings are searched where all shorter ones in them repeat; windows and claims are gathered without a loop over runs."""

import random

import numpy as np

from weft.llm import suffix_dedup as S


def brute(texts, length):
    """Bytes of each text that strings occurring elsewhere cover."""
    seen = {}
    for i, x in enumerate(texts):
        for j in range(len(x) - length + 1):
            seen.setdefault(x[j : j + length], []).append((i, j))
    hit = [set() for _ in texts]
    for where in seen.values():
        for i, j in where if len(where) > 1 else ():
            hit[i].update(range(j, j + length))
    return [len(h) for h in hit]


def test_long_repeats_lie_in_stretches_of_short_ones():
    raw = [np.array([[0, 100], [100, 150], [300, 350]], np.int64).tobytes()]
    got = next(S._stretches(200, 100)([{"d": [1, 2], "t": [3, 4], "p": [raw, [np.array([[5, 105]], np.int64).tobytes()]]}]))
    assert got["d"] == [1] and got["t"] == [3]
    assert np.frombuffer(got["within"][0], np.int64).tolist() == [0, 249]
    edge = next(S._stretches(200, 100)([{"d": [1], "t": [1], "p": [[np.array([[7, 108]], np.int64).tobytes()]]}]))
    assert np.frombuffer(edge["within"][0], np.int64).tolist() == [7, 207]


def test_both_lengths_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    shared = [word(n) for n in (45, 60, 79, 80, 81, 150, 400)]
    texts = ["".join(rng.choice([word(rng.randrange(1, 60)), rng.choice(shared)]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += [texts[0], "x" * 300, "ab" * 90, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    raw = [t.encode() for t in texts]
    for keep_first in (False, True):
        got = {r["doc_id"]: r for r in S.removed_bytes(docs, 80, keep_first, 40).collect()}
        if not keep_first:
            assert [got[i]["n_removed"] for i in range(len(raw))] == brute(raw, 80)
            assert [got[i]["n_passage"] for i in range(len(raw))] == brute(raw, 40)
        else:
            alone = {r["doc_id"]: r["n_removed"] for r in S.removed_bytes(docs, 80, True).collect()}
            assert {i: r["n_removed"] for i, r in got.items()} == alone


def test_unions():
    rng = np.random.default_rng(1)
    g, b = rng.integers(0, 5, 300), rng.integers(0, 400, 300)
    e = b + rng.integers(1, 9, 300)
    at, begin, end = S._unions(g, b, e)
    claims = [{"fd": int(x), "ft": 0, "fs": int(y), "b": int(y), "e": int(z)} for x, y, z in zip(g, b, e)]
    assert [(c["fd"], c["b"], c["e"]) for c in S.merged(claims)] == list(zip(g[at].tolist(), begin.tolist(), end.tolist()))
    assert [len(x) for x in S._unions(*(np.zeros(0, np.int64),) * 3)] == [0, 0, 0]
    keys = rng.integers(0, 3, (2, 50))
    assert len(set(zip(*keys.tolist()))) == S._numbered(*keys).max() + 1
