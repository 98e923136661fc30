"""The distributed suffix order against sorting, and its repeats against all windows."""

import random
from collections import defaultdict

import pytest

from weft.llm import difference_cover as D
from weft.llm.common import Workspace


@pytest.mark.parametrize("n", [14, 15, 16])
def test_ranks_equal_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(D, "LOCAL", 6)
    monkeypatch.setattr(D, "ROWS", 7)
    rng = random.Random(n)
    seq = [rng.choice([1, 2]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(seq)), "i bigint, c bigint")
    got = {r["i"]: r["rank"] for r in D.ranks(df, n, Workspace(spark, "test")).collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(n), key=lambda i: seq[i:]))}


def test_repeats_equal_all_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "LOCAL", 60)
    rng = random.Random(2)
    part = "".join(rng.choices("ab", k=20))
    texts = {1: "xé" + part + "q", 2: part, 3: None, 4: "", 5: part + part[:9], 6: "".join(rng.choices("abc", k=40)), 9: "short"}
    docs = spark.createDataFrame(list(texts.items()), "d bigint, text string")
    k, where = 8, defaultdict(list)
    for d, t in texts.items():
        x = (t or "").encode()
        for p in range(len(x) - k + 1):
            where[x[p : p + k]].append((d, p))
    want = sorted(p for places in where.values() if len(places) > 1 for p in places)
    assert sorted(map(tuple, D.repeated(docs, k).collect())) == want
