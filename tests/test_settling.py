"""Searches in order of cost: stop rules, bounds, and how many labels they make."""

import heapq
import random

import pytest

from weft.operators import settling, traverse, weighted
from weft.session import Workspace


@pytest.fixture(params=[0, 10_000], ids=["distributed", "driver"])
def where(request, monkeypatch):
    monkeypatch.setattr(traverse, "DRIVER_EDGES", request.param)


def plain(rows, s, limit):
    """Least (cost, hops) of each node."""
    after = {}
    for a, b, w in rows:
        after.setdefault(a, []).append((b, w))
    best, heap = {}, [(0.0, 0, s)]
    while heap:
        c, h, v = heapq.heappop(heap)
        if v not in best:
            best[v] = (c, h)
            for b, w in after.get(v, []):
                if c + w <= limit:
                    heapq.heappush(heap, (c + w, h + 1, b))
    return best


def frame(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")


def graph(seed, n=30, m=70, weights=(0.0, 0.5, 1.0, 2.0, 7.0)):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.choice(weights)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_costs_and_paths(spark, where, seed):
    """Weights of zero and below the width too."""
    rows = graph(seed)
    g, s = frame(spark, rows), rows[0][0]
    best = plain(rows, s, 12)
    lightest = {}
    for a, b, w in rows:
        lightest[a, b] = min(w, lightest.get((a, b), w))
    nodes = {x for r in rows for x in r[:2]}
    far = max(best, key=lambda v: (best[v], v))
    beyond = min(nodes - set(best), default=None)
    r = weighted.dijkstra(g, s, far, 12).first()
    path = [int(x) for x in r["path"]]
    assert r["cost"] == best[far][0] == sum(lightest[p] for p in zip(path, path[1:])) and len(path) == best[far][1] + 1
    assert weighted.bidirectional_dijkstra(g, s, far, 12).first()["cost"] == best[far][0]
    if beyond is not None:
        assert not weighted.dijkstra(g, s, beyond, 12).first()["found"] and not weighted.bidirectional_dijkstra(g, s, beyond, 12).first()["found"]


def fan(width):
    """A short path beside a wide fan that lies beyond the target."""
    return [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)] + [(3, 100 + i, 1.0) for i in range(width)] + [(0, 200 + i, 1.0) for i in range(5)]


def test_nothing_is_settled_past_the_target(spark):
    space = Workspace(spark, "test")
    e = space.write(settling.weighted_edges(frame(spark, fan(40)), settling.F.col("weight")), "edges")
    found, search = settling.cheapest(e, 0, 3, 20.0, space)
    assert found["path"] == [0, 1, 2, 3] and found["cost"] == 3.0
    # The fan behind the target has no labels at all.
    assert search.size == 9 and search.labels.where("key > 3").isEmpty()


def test_settled_bound(spark, where):
    """The target is the ninth node to be settled."""
    rows = [(0, i, 1.0) for i in range(1, 8)] + [(7, 50, 1.0), (50, 51, 1.0)]
    g = frame(spark, rows)
    assert weighted.dijkstra(g, 0, 50, 20, most=8).first()["found"]
    assert not weighted.dijkstra(g, 0, 50, 20, most=7).first()["found"]
    assert not weighted.dijkstra(g, 0, 51, 20, most=3).first()["found"]


def test_bidirectional_settles_fewer(spark):
    """Both ends have wide fans behind them that a one-sided search has to cross."""
    rows = [(i, i + 1, 1.0) for i in range(8)] + [(k, 1000 + 50 * k + i, 1.0) for k in range(1, 9) for i in range(40)]
    space = Workspace(spark, "test")
    e = space.write(settling.weighted_edges(frame(spark, rows), settling.F.col("weight")), "edges")
    best, ahead, behind = settling.meeting(e, 0, 8, 20.0, space)
    _, one = settling.cheapest(e, 0, 8, 20.0, space)
    assert best["cost"] == 8.0 and ahead.settled + behind.settled < one.settled / 2
    # Stops once both lowest open labels cost as much as the path.
    assert ahead.top + behind.top >= 8.0 and ahead.rounds + behind.rounds <= 9


def test_bidirectional_is_right_on_weights(spark, where):
    """The first node that both sides reach is not on the cheapest path."""
    g = frame(spark, [(0, 1, 5.0), (1, 9, 5.0), (0, 2, 3.0), (2, 3, 3.0), (3, 9, 3.0)])
    r = weighted.bidirectional_dijkstra(g, 0, 9, 20).first()
    assert r["cost"] == 9.0 and r["meeting"] in ("2", "3")
    assert not weighted.bidirectional_dijkstra(g, 0, 9, 8).first()["found"]


def test_landmarks_steer(spark):
    """On a grid, bounds keep labels near the way to the target: the path of Dijkstra, fewer labels."""
    n = 9
    rows = [(n * y + x, n * b + a, 1.0) for y in range(n) for x in range(n) for b, a in ((y, x + 1), (y + 1, x), (y, x - 1), (y - 1, x)) if 0 <= a < n and 0 <= b < n]
    g, s, t = frame(spark, rows), n * 4 + 3, n * 4 + 8
    marks = weighted.landmarks(g, 3)
    space = Workspace(spark, "test")
    e = space.write(settling.weighted_edges(g, settling.F.col("weight")), "edges")
    h = space.write(weighted.heuristic(marks, t), "bounds")
    plainly, wide = settling.cheapest(e, s, t, 20.0, space)
    steered, narrow = settling.cheapest(e, s, t, 20.0, space, h)
    assert steered["path"] == plainly["path"] and narrow.size < wide.size / 2
    for driver in (0, 10_000):
        assert [int(x) for x in weighted.a_star(g, s, t, marks, 20, driver).first()["path"]] == plainly["path"]
