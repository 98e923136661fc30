"""Weighted shortest paths by relaxation of a frontier, in both directions, and with landmark bounds.

An edge without weight costs 1. A node's label is (cost, hops), smaller first, so
paths over free edges end too. A round joins the nodes whose label fell with the
edges and keeps the least new label of each end; rounds stop when none falls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import settling, traverse
from weft.operators.local import LocalGraph, ids_of
from weft.operators.settling import MAX_SETTLED
from weft.operators.traverse import _one, distances, exists, path_row
from weft.session import Workspace

#: Bound of a path's cost; landmarks of the lower bounds.
MAX_COST, LANDMARKS = 20.0, 6


def _weights(edges: DataFrame, forward: bool = True) -> DataFrame:
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), w.alias("w"))


def check_weights(edges: DataFrame) -> None:
    """Negative weights are an error."""
    if "weight" in edges.columns and not edges.where("weight < 0").limit(1).isEmpty():
        raise ValueError("weights must not be negative")


def costs(edges: DataFrame, starts: DataFrame, max_cost: float = MAX_COST, forward: bool = True, rounds: int = 10_000, bounds: DataFrame | None = None, driver_edges: int | None = None) -> DataFrame:
    """(id, cost, hops) of nodes within ``max_cost`` of the nearest of ``starts``.

    ``bounds`` (id, h) drops labels with cost + h above ``max_cost``.
    """
    space = Workspace(edges.sparkSession, "relax")
    edges = space.stored(edges, "edges")
    check_weights(edges)
    graph = LocalGraph.of(edges, traverse.DRIVER_EDGES if driver_edges is None else driver_edges)
    ids = ids_of(starts, traverse.DRIVER_EDGES) if graph else None
    if ids is not None:
        low = {graph.at[r["id"]]: r["h"] for r in bounds.toLocalIterator() if r["id"] in graph.at} if bounds is not None else None
        best = graph.costs(ids, max_cost, forward, low)
        at = np.array(list(best), np.int64)
        return graph.frame(edges.sparkSession, at, edges.schema["src"].dataType.simpleString(), cost=np.array([c for c, _ in best.values()], np.float64), hops=np.array([h for _, h in best.values()], np.int32))
    e = _weights(edges, forward)
    kind = e.schema["a"].dataType
    zero = starts.select(F.col(starts.columns[0]).cast(kind).alias("id")).distinct().select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    best = space.write(zero.withColumn("fell", F.lit(True)), "start")
    for k in range(rounds):
        moved = best.where("fell").select(F.col("id").alias("a"), "cost", "hops").join(e, "a")
        new = moved.select(F.col("b").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops")).where(F.col("cost") <= max_cost)
        if bounds is not None:
            new = new.join(bounds, "id", "left").where(F.col("cost") + F.coalesce("h", F.lit(0)) <= max_cost).drop("h")
        both = best.select("id", F.struct("cost", "hops").alias("old"), F.lit(None).cast("struct<cost: double, hops: int>").alias("new")).unionByName(
            new.select("id", F.lit(None).cast("struct<cost: double, hops: int>").alias("old"), F.struct("cost", "hops").alias("new"))
        )
        least = both.groupBy("id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        fell = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        label = F.when(fell, F.col("new")).otherwise(F.col("old"))
        old, best = best, space.write(least.select("id", label["cost"].alias("cost"), label["hops"].alias("hops"), fell.alias("fell")), f"round{k}")
        space.drop(old)
        if best.where("fell").isEmpty():
            break
    return best.select("id", "cost", "hops")


def dijkstra(edges: DataFrame, source, target, max_cost: float = MAX_COST, driver_edges: int | None = None, most: int = MAX_SETTLED) -> DataFrame:
    """(path, found, cost): cheapest path of at most ``max_cost``; of equal ones the one of fewest hops and smallest parents.

    Nodes are settled in order of cost. The search ends when the target is, and finds
    nothing if more than ``most`` nodes are settled before it.
    """
    return _search(edges, source, target, max_cost, None, driver_edges, most)


def _row(spark, path: list | None, cost: float | None) -> DataFrame:
    return path_row(spark, path).withColumn("cost", F.lit(cost).cast("double"))


def _search(edges: DataFrame, source, target, max_cost: float, bounds: DataFrame | None, driver_edges: int | None = None, most: int = MAX_SETTLED) -> DataFrame:
    spark = edges.sparkSession
    space = Workspace(spark, "weighted")
    edges = space.stored(edges, "edges")
    check_weights(edges)
    if not exists(edges, source) or not exists(edges, target):
        return _row(spark, None, None)
    if source == target:
        return _row(spark, [source], 0.0)
    graph = LocalGraph.of(edges, traverse.DRIVER_EDGES if driver_edges is None else driver_edges)
    if graph:
        low = {graph.at[r["id"]]: r["h"] for r in bounds.toLocalIterator() if r["id"] in graph.at} if bounds is not None else None
        path, cost = graph.cheapest(source, target, max_cost, low, most)
        return _row(spark, path, cost)
    found, _ = settling.cheapest(_stored_weights(edges, space), source, target, max_cost, space, bounds, most)
    return _row(spark, found["path"], found["cost"]) if found else _row(spark, None, None)


def _stored_weights(edges: DataFrame, space: Workspace) -> DataFrame:
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return space.write(settling.weighted_edges(edges, weight), "weights")


def bidirectional_dijkstra(edges: DataFrame, source, target, max_cost: float = MAX_COST, per_side: bool = False, driver_edges: int | None = None, most: int = MAX_SETTLED) -> DataFrame:
    """(found, cost, meeting): the cheapest path by a search from each end, and a node of it where both meet.

    The side with fewer settled nodes moves, and the search ends when the lowest open
    labels of both sides cost no less than the best path together. ``max_cost`` bounds
    the path; with ``per_side`` it bounds each side alone, so paths up to twice as
    long are found. ``most`` bounds the settled nodes of both sides.
    """
    spark = edges.sparkSession
    space = Workspace(spark, "weighted")
    edges = space.stored(edges, "edges")
    check_weights(edges)
    none = spark.createDataFrame([(False, None, None)], "found boolean, cost double, meeting string")
    if not exists(edges, source) or not exists(edges, target):
        return none
    graph = LocalGraph.of(edges, traverse.DRIVER_EDGES if driver_edges is None else driver_edges)
    if graph:
        met = graph.meeting(source, target, max_cost, not per_side, most)
    else:
        best, *_ = settling.meeting(_stored_weights(edges, space), source, target, max_cost, space, not per_side, most)
        met = (best["cost"], best["id"]) if best else None
    return spark.createDataFrame([(True, float(met[0]), str(met[1]))], none.schema) if met else none


def landmarks(edges: DataFrame, count: int = LANDMARKS, start=None, driver_edges: int | None = None) -> DataFrame:
    """(landmark, node, dist_from, dist_to): hops from and to landmarks, null where out of reach.

    The first is the node farthest from ``start`` (the smallest id if not given);
    each next one is farthest from those before. Ties go to the smaller id; the
    choice ends when no node is farther than 0.
    """
    spark = edges.sparkSession
    space = Workspace(spark, "landmarks")
    edges = space.stored(edges, "edges")
    kind = edges.schema["src"].dataType.simpleString()
    if start is None:
        start = edges.agg(F.min(F.least("src", "dst"))).first()[0]
    out = []
    if start is not None:
        near = distances(edges, _one(spark, edges, start), driver_edges=driver_edges)
        while len(out) < count:
            top = near.where("dist > 0").orderBy(F.desc("dist"), "id").first()
            if not top and out:
                break
            mark = top["id"] if top else start
            one = _one(spark, edges, mark)
            there, back = distances(edges, one, driver_edges=driver_edges), distances(edges, one, forward=False, driver_edges=driver_edges)
            both = there.select("id", F.col("dist").alias("dist_from")).join(back.select("id", F.col("dist").alias("dist_to")), "id", "full")
            out.append(space.write(both.select(F.lit(mark).cast(kind).alias("landmark"), F.col("id").alias("node"), "dist_from", "dist_to"), "landmark"))
            away = there if len(out) == 1 else near.unionByName(there).groupBy("id").agg(F.min("dist").alias("dist"))
            near = space.write(away, "near")
            if not top:
                break
    result = spark.createDataFrame([], f"landmark {kind}, node {kind}, dist_from int, dist_to int")
    for x in out:
        result = result.unionByName(x)
    return result


def heuristic(marks: DataFrame, target) -> DataFrame:
    """(id, h): the best triangle bound on the hops to ``target``; pairs with an unreachable leg are skipped, 0 at least."""
    goal = marks.where(F.col("node") == F.lit(target)).select("landmark", F.col("dist_from").alias("t_from"), F.col("dist_to").alias("t_to"))
    both = marks.join(F.broadcast(goal), "landmark")
    low = F.greatest(F.lit(0), F.col("t_from") - F.col("dist_from"), F.col("dist_to") - F.col("t_to"))
    return both.groupBy(F.col("node").alias("id")).agg(F.max(low).alias("h"))


def a_star(edges: DataFrame, source, target, marks: DataFrame | None = None, max_cost: float = MAX_COST, driver_edges: int | None = None, most: int = MAX_SETTLED) -> DataFrame:
    """(path, found, cost): as ``dijkstra``, nodes being settled in order of cost plus landmark bound.

    Labels whose cost plus bound exceed ``max_cost`` or the cost of a path already
    found are dropped. Bounds count hops, so they are used only where every weight is
    1 or more.
    """
    if marks is None or "weight" in edges.columns and not edges.where("weight < 1").limit(1).isEmpty():
        return dijkstra(edges, source, target, max_cost, driver_edges, most)
    space = Workspace(edges.sparkSession, "astar")
    h = space.write(heuristic(marks, target), "bounds")
    return _search(edges, source, target, max_cost, h, driver_edges, most)
