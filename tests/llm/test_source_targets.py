"""Targets of a table of sources against those of a list."""

import random

import pytest

from weft.llm import mixing
from weft.llm.common import Workspace


def both(spark, sizes, **how):
    rows = spark.createDataFrame(sizes, "source string, source_size bigint").repartition(5)
    got, n = mixing.source_targets(Workspace(spark, "targets-test"), rows, **how)
    want = {s: (size, t) for s, size, t in mixing.targets(sizes, **how)}
    assert n == len(sizes)
    return {r["_s"]: (r["source_size"], r["target"]) for r in got.collect()}, want


def test_many_sources(spark):
    """Sizes over six orders of magnitude, so that sources stop in several rounds; ranks run across range partitions."""
    rng = random.Random(5)
    names = {None, "", "\U0001f600", "￿", "z", "Z", "é"} | {f"s{rng.randrange(10**9)}" for _ in range(400)}
    sizes = [(s, int(10 ** rng.uniform(0, 6))) for s in sorted(names, key=lambda s: (s is None, s or ""))]
    rng.shuffle(sizes)
    got, want = both(spark, sizes)
    assert got.keys() == want.keys()
    assert all(got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1], rel=1e-12) for s in want)
    assert sum(t == 2 * n for n, t in got.values()) > 10 and sum(t < 2 * n for n, t in got.values()) > 10


@pytest.mark.parametrize("sizes", [[], [("a", 0)], [("a", 0), (None, 0)], [(None, 7)], [("a", 1), ("b", 1), ("c", 10**12)]])
def test_small(spark, sizes):
    got, want = both(spark, sizes)
    assert got == want


@pytest.mark.parametrize("share", [2.0, 5.0])
def test_all_at_their_most(spark, share):
    got, want = both(spark, [("a", 10), ("b", 20), ("c", 30), (None, 40)], share=share)
    assert got == want
