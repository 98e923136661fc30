"""Weak components of few edges are done in one task each, however many they are: no rounds over the whole graph."""

import pytest

from weft.operators import condense, reach


def small_graphs(spark):
    """Of each ten nodes a chain with a way back over its middle, and one large component."""
    rows = [(10 * c + i, 10 * c + i + 1) for c in range(40) for i in range(8)] + [(10 * c + 5, 10 * c + 3) for c in range(40)]
    rows += [(1000 + i, 1001 + i) for i in range(30)] + [(1020, 1004)]
    return spark.createDataFrame(rows, "src bigint, dst bigint"), rows


def test_strong_components(spark, monkeypatch):
    e, rows = small_graphs(spark)
    want = condense.tarjan(rows)
    chains = []
    monkeypatch.setattr(condense, "chains", lambda e, space: chains.append(e.count()))
    assert {r["id"]: r["scc"] for r in condense.strong_components(e, driver_edges=0, finish=12).collect()} == want
    # Only the large component's edges go the way of the large graphs.
    assert chains == [31]


def test_layers_and_labels(spark, monkeypatch):
    e, rows = small_graphs(spark)
    rows = [r for r in rows if r[0] < r[1]]
    up, nodes = e.where("src < dst"), spark.createDataFrame([(5000,)], "id bigint")
    want = dict(condense._longest([(a, b, 1) for a, b in rows])) | {5000: 0}
    assert {r["id"]: r["layer"] for r in condense.topological_layers(up, nodes, finish=12).collect()} == want
    assert {r["id"]: r["layer"] for r in condense.topological_layers(up, nodes, finish=100).collect()} == want
    with pytest.raises(ValueError):
        condense.topological_layers(e.where("src < 1000"), finish=12)
    key = lambda df: sorted(map(tuple, df.collect()))
    for n in (None, nodes):
        assert key(reach.labels(up, n, 12)) == key(reach.labels(up, n, 0)) == key(reach.labels(up, n))
    marks = []
    monkeypatch.setattr(reach, "_firsts", lambda *a: marks.append(a))
    reach.labels(up, None, 40)
    assert not marks


def test_reachable_is_searched_in_one_component(spark, monkeypatch):
    e, rows = small_graphs(spark)
    scc = condense.strong_components(e)
    dag = condense.condensed_edges(e, scc)
    sizes = []
    searched = condense.distances
    monkeypatch.setattr(condense, "distances", lambda d, s: sizes.append(d.count()) or searched(d, s))
    ask = lambda a, b: condense.reachable(scc, dag, a, b, driver_edges=0)
    assert [ask(0, 8), ask(8, 0), ask(0, 18), ask(3, 5)] == ["Reachable", "Unreachable", "Unreachable", "Reachable"]
    assert sizes == [6, 6]
