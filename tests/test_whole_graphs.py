"""The registered queries of derived graphs against brute force on a small fixture: they read every row of their tables."""

import random
import re
from collections import defaultdict
from datetime import datetime

import pytest

from weft.plans.queries import QUERIES, SQL

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate date, l_extendedprice double"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder of tables, edges of parts, brands of parts, edges of orders): 60 orders of one to four lines over 90 parts."""
    rng = random.Random(11)
    orders = {k: [rng.randint(1, 90) for _ in range(rng.randint(1, 4))] for k in range(1, 64) if k % 16}
    at = str(tmp_path_factory.mktemp("orders"))
    rows = [(k, i, p, 1, None, 1.0) for k, line in orders.items() for i, p in enumerate(line)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{at}/lineitem.parquet")
    brand = {p: f"Brand#{p % 9 + 8}" for p in range(1, 101)}
    spark.createDataFrame(list(brand.items()), "p_partkey bigint, p_brand string").write.parquet(f"{at}/part.parquet")
    of = [(k, rng.randint(1, 9), rng.choice("ABC"), datetime(2024, 1, rng.randint(1, 28))) for k in orders]
    spark.createDataFrame(of, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{at}/orders.parquet")
    chain = set()
    for c in range(1, 10):
        mine = sorted((d, k, p) for k, x, p, d in of if x == c)
        for (_, a, p), (_, b, q) in zip(mine, mine[1:]):
            chain |= {(a, b), (b, a)} if p == q else {(a, b)}
    return at, {(a, b) for line in orders.values() for a, b in zip(line, line[1:]) if a != b}, brand, chain


def found(spark, small, name):
    return sorted(map(tuple, QUERIES[name](spark, small[0]).collect()))


def reach(edges):
    """Nodes that can be reached from each node in at least one step."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        out[s] = seen
    return out


def hops(edges, starts, depth=10_000):
    dist = dict.fromkeys(starts, 0)
    for k in range(1, depth + 1):
        new = {b for a, b in edges if dist.get(a) == k - 1} - set(dist)
        if not new:
            break
        dist |= dict.fromkeys(new, k)
    return dist


def test_edges(spark, small):
    edges, brand = small[1:3]
    assert found(spark, small, "text_graph_edges") == sorted((str(a), str(b)) for a, b in edges)
    some = {p for p, b in brand.items() if b == "Brand#11"}
    assert found(spark, small, "edges_from") == sorted(e for e in edges if e[0] in some)
    assert found(spark, small, "edges_into") == sorted(e for e in edges if e[1] in some)
    assert found(spark, small, "edges_touching") == sorted(e for e in edges if some & set(e))


def test_components(spark, small):
    edges = small[3]
    both = reach(edges | {(b, a) for a, b in edges})
    want = sorted((x, min(there)) for x, there in both.items())
    assert found(spark, small, "weak_components") == found(spark, small, "components_contraction") == want
    there = reach(edges)
    scc = {x: min([x, *(y for y in there[x] if x in there[y])]) for x in there}
    assert len(set(scc.values())) < len(scc)
    assert found(spark, small, "scc_members") == sorted(scc.items())
    assert found(spark, small, "scc_distributed") == sorted(scc.items())
    assert found(spark, small, "scc_condensed_edges") == sorted({(scc[a], scc[b]) for a, b in edges} - {(x, x) for x in scc.values()})
    assert found(spark, small, "has_cycle") == [(any(x in t for x, t in there.items()),)]


def test_searches(spark, small):
    edges = small[1]
    s, t = min(a for a, _ in edges), max(b for _, b in edges)
    assert found(spark, small, "bfs_distances") == found(spark, small, "bfs_distributed") == sorted(hops(edges, [s], 40).items())
    assert found(spark, small, "bfs_multi_source") == sorted(hops(edges, {p for p, b in small[2].items() if b == "Brand#11"}, 5).items())
    path, ok = found(spark, small, "shortest_path_unbounded")[0]
    dist = hops(edges, [s]).get(t)
    assert ok == (dist is not None) and (not ok or len(path.split(">")) == dist + 1)
    cost = {s: 0.0}
    for _ in edges:
        for a, b in edges:
            if a in cost and cost[a] + (a + b) % 4 + 1 <= min(30, cost.get(b, 30)):
                cost[b] = cost[a] + (a + b) % 4 + 1
    assert found(spark, small, "dijkstra_costs") == found(spark, small, "dijkstra_distributed") == sorted(cost.items())
    up = {e for e in edges if e[0] < e[1]}
    layer = dict.fromkeys((x for e in up for x in e), 0)
    for x in sorted(layer):
        layer[x] = max([layer[a] + 1 for a, b in up if b == x], default=0)
    assert found(spark, small, "topo_layers") == sorted(layer.items())


def test_no_query_reads_a_part_of_its_tables():
    """Neither ids nor their remainders select rows of a table."""
    assert not [n for n, q in SQL.items() if re.search(r"WHERE [lo]_orderkey (%|<|>|=)|WHERE src %|% (16|64) = 0", q)]
