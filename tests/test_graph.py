import random

import pytest

from weft.model import to_edges
from weft.operators import components as comp, condense, history, layout, lookup, traverse, weighted
from weft.sources import edges as sources



@pytest.fixture(params=[500_000, 0], ids=["driver", "distributed"])
def where(request, monkeypatch):
    """Searches of small graphs on the driver, and the same by levels of jobs."""
    monkeypatch.setattr(traverse, "DRIVER_EDGES", request.param)


NARROW = "src string, dst string, transformation string"


def graph(spark, text):
    return spark.createDataFrame([(e.split(">")[0], e.split(">")[1], None) for e in text.split()], NARROW)


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint")


def way(df):
    r = df.first()
    return list(r["path"]) if r["found"] else None


T1 = "A>B B>C C>A C>D D>E E>A"
T4 = "N1>N2 N2>N3 N3>N4 N1>N9 N9>N3"
SEARCHES = [traverse.shortest_path, traverse.bidirectional_path, weighted.dijkstra, weighted.a_star]


@pytest.mark.parametrize("search", SEARCHES)
def test_paths(spark, search, where):
    assert way(search(graph(spark, T4), "N1", "N4")) == ["N1", "N2", "N3", "N4"]
    g = graph(spark, T1)
    assert way(search(g, "A", "E")) == ["A", "B", "C", "D", "E"]
    assert way(search(g, "A", "A")) == ["A"] and way(search(g, "Z", "Z")) is None
    assert way(search(g, "A", "Z")) is None and way(search(graph(spark, "A>B C>D"), "A", "D")) is None


def bound():
    """The default bound on the driver, a short one where each level is a job."""
    return 12 if traverse.DRIVER_EDGES else 3


@pytest.mark.parametrize("search", SEARCHES)
def test_bounds(spark, search, where):
    n = bound()
    g = chain(spark, n + 3)
    given = [None, n] if search is weighted.a_star else [n]
    assert len(way(search(g, 0, n, *given))) == n + 1
    assert way(search(g, 0, n + 1, *given)) is None


def test_per_side_quirk(spark, where):
    n = bound()
    g = chain(spark, 2 * n + 3)
    assert not weighted.bidirectional_dijkstra(g, 0, n + 1, n).first()["found"]
    assert weighted.bidirectional_dijkstra(g, 0, 2 * n, n, per_side=True).first()["cost"] == 2 * n
    assert not weighted.bidirectional_dijkstra(g, 0, 2 * n + 1, n, per_side=True).first()["found"]


def test_visited_bound(spark, where):
    g = spark.createDataFrame([("s", f"x{i}") for i in range(50)] + [("x1", "t")], "src string, dst string")
    assert way(traverse.shortest_path(g, "s", "t", 12, most=20)) is None
    assert way(traverse.shortest_path(g, "s", "t", 12)) == ["s", "x1", "t"]


def test_random_graphs_agree(spark, where):
    rng = random.Random(4)
    for _ in range(2 if traverse.DRIVER_EDGES else 1):
        rows = list({(rng.randrange(25), rng.randrange(25)) for _ in range(45)})
        g = spark.createDataFrame(rows, "src bigint, dst bigint")
        nodes = sorted({x for r in rows for x in r})
        after = {}
        for a, b in rows:
            after.setdefault(a, []).append(b)
        s = nodes[0]
        dist, level = {s: 0}, [s]
        while level:
            level = [b for a in level for b in after.get(a, [])]
            level = list(dict.fromkeys(b for b in level if b not in dist))
            dist |= {b: 1 + max(dist.values()) for b in level}
        assert {r["id"]: r["dist"] for r in traverse.distances(g, spark.createDataFrame([(s,)], "id bigint")).collect()} == dist
        t = max(dist, key=lambda v: (dist[v], v))
        marks = weighted.landmarks(g, 2)
        found = [way(f) for f in (traverse.shortest_path(g, s, t, 20), traverse.bidirectional_path(g, s, t, 20), weighted.dijkstra(g, s, t), weighted.a_star(g, s, t, marks))]
        assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == dist[t] + 1
        mine = {r["id"]: r["scc"] for r in condense.strong_components(g).collect()}
        assert mine == {r["id"]: r["scc"] for r in condense.strong_components(g, driver_edges=0).collect()}


def test_weights(spark, where):
    g = spark.createDataFrame([("A", "B", 4.0), ("A", "C", 2.0), ("C", "B", 1.0), ("B", "D", 5.0), ("C", "D", 8.0), ("D", "E", 0.0), ("E", "D", 0.0)], "src string, dst string, weight double")
    row = weighted.dijkstra(g, "A", "E", 100).first()
    assert row["cost"] == 8 and list(row["path"]) == ["A", "C", "B", "D", "E"]
    assert weighted.bidirectional_dijkstra(g, "A", "E", 100).first()["cost"] == 8
    assert not weighted.dijkstra(g, "A", "E", 7).first()["found"]
    with pytest.raises(ValueError):
        weighted.dijkstra(g.withColumn("weight", -g["weight"]), "A", "B")


def test_neighborhood(spark):
    g = graph(spark, "A>B C>A B>C B>D D>E E>F")
    nodes, edges, cut = traverse.neighborhood(g, "A", 1)
    assert sorted(r["id"] for r in nodes.collect()) == ["A", "B", "C"] and not cut
    # B>C joins two nodes of the last ring.
    assert sorted(map(tuple, edges.collect())) == [("A", "B"), ("C", "A")]
    nodes, edges, cut = traverse.neighborhood(g, "A", 9, 3)
    assert nodes.count() == 3 and not cut
    nodes, edges, cut = traverse.neighborhood(g, "A", 1, 2)
    assert sorted(r["id"] for r in nodes.collect()) == ["A", "B"] and cut and edges.count() == 1
    assert traverse.neighborhood(g, "none", 2)[0].count() == 0


def test_describe(spark):
    from weft.model import EDGE

    raw = spark.createDataFrame([("A", "predecesseur", "B", None), ("B", "successeur", "A", "back"), ("B", "predecesseur", "C", "z"), ("B", "predecesseur", "C", "y"), ("C", "successeur", "B", "a"), ("C", "predecesseur", "D", None)], EDGE)
    rows = traverse.describe_path(traverse.path_row(spark, ["A", "B", "C", "D"]), raw).orderBy("index").collect()
    assert [tuple(r) for r in rows] == [(1, "A", "B", "back"), (2, "B", "C", "y"), (3, "C", "D", None)]
    assert traverse.describe_path(traverse.path_row(spark, ["A"]), raw).count() == 0
    nodes, edges = traverse.path_subgraph(traverse.path_row(spark, ["A", "B", "A"]))
    assert nodes.count() == 2 and edges.count() == 2


def test_islands(spark):
    g = to_edges(sources.islands(spark))
    weak, scc = condense.weak_components(g), condense.strong_components(g)
    assert sorted(r["size"] for r in condense.component_sizes(weak).collect()) == [3, 5]
    assert tuple(condense.component_summary(scc, "scc").first()) == (6, 3)
    dag = condense.condensed_edges(g, scc)
    assert dag.count() == 4
    assert condense.reachable(scc, dag, "X1", "X5") == "Reachable" and condense.reachable(scc, dag, "X5", "X1") == "Unreachable"
    assert condense.reachable(scc, dag, "X1", "N") == "Unavailable" and condense.reachable(None, dag, "X1", "X2") == "Unavailable"
    assert condense.compare(weak, "X5", "X1") == "SameComponent" and condense.compare(weak, "X1", "Y1") == "DifferentComponents"
    assert condense.compare(weak, "X1", "N") == condense.compare(None, "X1", "X2") == "ScanUnavailable"
    assert condense.has_cycle(g) and not condense.has_cycle(graph(spark, T4)) and condense.has_cycle(graph(spark, "A>A"))


def test_contraction_of_chains_and_stars(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1100)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for finish in (comp.FINISH, 5):
        got = {r["id"]: r["component"] for r in comp.components(df, finish).collect()}
        assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1100)}
    assert comp.components(df.limit(0)).count() == 0


def test_layers_and_positions(spark):
    g = graph(spark, "A>B A>C B>D C>D A>D")
    assert {r["id"]: r["layer"] for r in condense.topological_layers(g).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2}
    with pytest.raises(ValueError):
        condense.topological_layers(graph(spark, T1))
    at = {r["id"]: (r["x"], r["y"]) for r in layout.layered_positions(condense.topological_layers(g)).collect()}
    assert at == {"A": (0.0, 0.0), "B": (-0.5, -1.0), "C": (0.5, -1.0), "D": (0.0, -2.0)}
    nodes = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4)], "id string, pos int")
    arcs = spark.createDataFrame([(*e.split(">"), i) for i, e in enumerate((T1 + " B>B").split())], "src string, dst string, pos int")
    assert sorted(map(tuple, layout.back_edges(nodes, arcs).collect())) == [("B", "B"), ("C", "A"), ("E", "A")]
    assert {r["id"]: r["layer"] for r in layout.layers(nodes, arcs).collect()} == {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}
    assert layout.depth_first_back_edges(list(range(5000)), [(i, i + 1) for i in range(4999)]) == []


def test_history(spark):
    df = history.load(spark, '["A", {"id": "B", "via": "successeur"}, {"id": "A", "via": "predecesseur"}, "A", "C"]')
    assert [tuple(r) for r in df.orderBy("step").collect()] == [(0, "A", None), (1, "B", "successeur"), (2, "A", "predecesseur"), (3, "A", None), (4, "C", None)]
    assert sorted(map(tuple, history.graph(df).collect())) == [("A", "B"), ("A", "C")]
    assert history.recorded(df).count() == 4 and history.recorded(df, 2).count() == 2
    assert history.load(spark, "{broken").count() == 0 and history.load(spark, None).count() == 0


def test_degrees(spark):
    g = graph(spark, "A>B A>A C>A")
    nodes = spark.createDataFrame([("Z", 0), ("A", 1)], "id string, pos int")
    got = {r["id"]: tuple(r)[1:] for r in lookup.degrees(g, nodes).collect()}
    assert got == {"A": (2, 2, 4), "B": (1, 0, 1), "C": (0, 1, 1), "Z": (0, 0, 0)}
    assert tuple(lookup.max_degree(g, nodes, nodes).first()) == ("A", 4)
    row = lookup.compute_stats(g, nodes).first()
    assert row["isolated"] == 1 and row["components"] == 2 and row["has_cycle"] and row["avg_out"] == 0.75 and row["avg_degree"] == 1.5


def test_lookup(spark):
    g = spark.createDataFrame([("A", "B", "y"), ("A", "B", "x"), ("A", "B", None), ("A", "B", None), ("C", "A", "x")], NARROW)
    rows = [tuple(r) for r in lookup.node_detail(g, "A").collect()]
    assert rows == [("predecessor", "C", "x"), ("successor", "B", None), ("successor", "B", "x"), ("successor", "B", "y")]
    assert lookup.node_detail(g, "none") is None
    page = [tuple(r) for r in lookup.list_nodes(g, 1, 2).orderBy("id").collect()]
    assert page == [("A", ["x", "y"], 3), ("B", ["x", "y"], 3)]
    assert [r["id"] for r in lookup.search_nodes(g, "b").collect()] == ["B"]


def test_long_chain_components(spark):
    assert condense.component_summary(condense.weak_components(chain(spark, 2000))).first()["largest"] == 2001
