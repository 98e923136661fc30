"""Breadth-first operators: distances, bounded shortest paths, neighbourhoods, path description.

A graph of at most ``DRIVER_EDGES`` edges is searched on the driver (see
``weft.operators.local``). Of a larger one, loops run one level at a time; a level is an equi-join of the
frontier with the edges, of which Spark broadcasts the smaller side by its
measured size.  Levels are written to the shared folder, so plans stay short and
lost executors cost the level they ran.  Every loop is bounded or ends when no new
node turns up, and ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators.local import DRIVER_EDGES, LocalGraph, ids_of
from weft.session import Workspace

#: Bounds of searches.
DEFAULT_DEPTH, MAX_DEPTH = 12, 20
VISITED_ONE_SIDE, VISITED_IN_MEMORY = 30_000, 300_000
#: Levels after which the visited tables are merged into one.
MERGE = 12
PATH = "path array<string>, found boolean"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Search:
    """Levels of a breadth-first search: (id, parent, dist), parents being the smallest of the level before."""

    def __init__(self, edges: DataFrame, starts: DataFrame, space: Workspace, forward: bool = True):
        a, b = ("src", "dst") if forward else ("dst", "src")
        edges = space.stored(edges, "edges")
        self.edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        self.space = space
        kind = self.edges.schema["a"].dataType
        self.levels = [space.write(starts.select(F.col(starts.columns[0]).cast(kind).alias("id")).where("id is not null").distinct().select("id", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("dist")), "level0")]
        self.seen = [self.levels[0].select("id")]
        self.size = self.levels[0].count()
        self.last = self.size

    @property
    def frontier(self) -> DataFrame:
        return self.levels[-1]

    def step(self) -> int:
        """One level further; the number of new nodes."""
        new = (
            self.frontier.select(F.col("id").alias("a")).join(self.edges, "a").groupBy("b").agg(F.min("a").alias("parent"))
            .join(_union(self.seen).withColumnRenamed("id", "b"), "b", "left_anti")
            .select(F.col("b").alias("id"), "parent", F.lit(len(self.levels)).alias("dist"))
        )
        level = self.space.write(new, f"level{len(self.levels)}")
        self.last = level.count()
        self.levels.append(level)
        self.seen.append(level.select("id"))
        self.size += self.last
        if len(self.seen) > MERGE:
            self.seen = [self.space.write(_union(self.seen), "seen")]
        return self.last

    def visited(self) -> DataFrame:
        """(id, dist) of all levels."""
        if len(self.levels) <= 2 * MERGE:
            return _union([x.select("id", "dist") for x in self.levels])
        spark = self.frontier.sparkSession
        return spark.read.schema(self.frontier.schema).parquet(*(x._weft_path for x in self.levels)).select("id", "dist")


def distances(edges: DataFrame, starts: DataFrame, forward: bool = True, max_depth: int | None = None, driver_edges: int | None = None) -> DataFrame:
    """(id, dist): hops from the nearest of ``starts`` along (or against) edges (src, dst); nodes out of reach are left out."""
    space = Workspace(edges.sparkSession, "bfs")
    edges = space.stored(edges, "edges")
    graph = LocalGraph.of(edges, DRIVER_EDGES if driver_edges is None else driver_edges)
    ids = ids_of(starts, DRIVER_EDGES) if graph else None
    if ids is not None:
        local = graph.search(ids, forward)
        while local.last and (max_depth is None or local.depth < max_depth):
            local.step()
        found = np.flatnonzero(local.dist >= 0)
        kind = edges.schema["src"].dataType.simpleString()
        there = graph.frame(edges.sparkSession, found, kind, dist=local.dist[found])
        # Start nodes without edges are at distance 0 too.
        alone = [v for v in ids if v not in graph.at]
        return there.unionByName(edges.sparkSession.createDataFrame([(v, 0) for v in alone], f"id {kind}, dist int")) if alone else there
    search = Search(edges, starts, space, forward)
    while search.last and (max_depth is None or len(search.levels) <= max_depth):
        search.step()
    return search.visited()


def exists(edges: DataFrame, node) -> bool:
    """Whether a node stands at either end of an edge."""
    return not edges.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node))).limit(1).isEmpty()


def _one(spark: SparkSession, edges: DataFrame, node) -> DataFrame:
    return spark.createDataFrame([(node,)], f"id {edges.schema['src'].dataType.simpleString()}")


def path_row(spark: SparkSession, path: list | None) -> DataFrame:
    return spark.createDataFrame([([str(x) for x in path] if path else [], bool(path))], PATH)


def _back(levels: list[DataFrame], node) -> list:
    """The path from level 0 to a node of the last level, read backwards by parents."""
    out = [node]
    for level in reversed(levels[1:]):
        row = level.where(F.col("id") == F.lit(out[-1])).select("parent").first()
        out.append(row["parent"])
    return out[::-1]


def shortest_path(edges: DataFrame, source, target, max_depth: int | None = DEFAULT_DEPTH, most: int = VISITED_ONE_SIDE, driver_edges: int | None = None) -> DataFrame:
    """(path, found): breadth first from ``source`` alone, ``max_depth`` hops at most.

    The search stops once ``most`` nodes are visited, counted after each level. A
    node that is both ends is its own path if it exists. Of equally short paths the
    one of smallest parents, seen from the target, is returned.
    """
    spark = edges.sparkSession
    space = Workspace(spark, "path")
    edges = space.stored(edges, "edges")
    if not exists(edges, source) or not exists(edges, target):
        return path_row(spark, None)
    if source == target:
        return path_row(spark, [source])
    graph = LocalGraph.of(edges, DRIVER_EDGES if driver_edges is None else driver_edges)
    if graph:
        local, goal = graph.search([source]), graph.at[target]
        while local.last and local.size < (most or float("inf")) and (max_depth is None or local.depth < max_depth):
            local.step()
            if local.dist[goal] >= 0:
                return path_row(spark, graph.ids[local.path(goal)].tolist())
        return path_row(spark, None)
    search = Search(edges, _one(spark, edges, source), space)
    while search.last and search.size < (most or float("inf")) and (max_depth is None or len(search.levels) <= max_depth):
        search.step()
        if not search.frontier.where(F.col("id") == F.lit(target)).isEmpty():
            return path_row(spark, _back(search.levels, target))
    return path_row(spark, None)


def bidirectional_path(edges: DataFrame, source, target, max_depth: int = DEFAULT_DEPTH, most: int = VISITED_ONE_SIDE, driver_edges: int | None = None) -> DataFrame:
    """(path, found): both ends take turns; ``max_depth`` counts the steps of both.

    The step of a side that is exhausted or has visited ``most`` nodes is lost. The
    path is the one ``shortest_path`` returns.
    """
    spark = edges.sparkSession
    space = Workspace(spark, "bidirectional")
    edges = space.stored(edges, "edges")
    if not exists(edges, source) or not exists(edges, target):
        return path_row(spark, None)
    if source == target:
        return path_row(spark, [source])
    graph = LocalGraph.of(edges, DRIVER_EDGES if driver_edges is None else driver_edges)
    if graph:
        sides = graph.search([source]), graph.search([target], forward=False)
        for turn in range(max_depth):
            side, other = sides[turn % 2], sides[1 - turn % 2]
            if not side.last or side.size >= most:
                continue
            side.step()
            if (other.dist[side.frontier] >= 0).any():
                whole = graph.search([source])
                while whole.dist[graph.at[target]] < 0:
                    whole.step()
                return path_row(spark, graph.ids[whole.path(graph.at[target])].tolist())
        return path_row(spark, None)
    ahead, behind = Search(edges, _one(spark, edges, source), space), Search(edges, _one(spark, edges, target), space, forward=False)
    for turn in range(max_depth):
        side, other = (ahead, behind) if turn % 2 == 0 else (behind, ahead)
        if not side.last or side.size >= most:
            continue
        side.step()
        # Searches meet first at the deepest levels: anything nearer would have met before.
        met = side.frontier.join(other.frontier.select("id"), "id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return path_row(spark, None)
    # Forward levels go on inside the backward ones, so parents are the smallest on any shortest path.
    levels = ahead.levels[:-1] + [ahead.frontier.join(behind.frontier.select("id"), "id", "left_semi").select("id", "parent", "dist")]
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    for near in reversed(behind.levels[:-1]):
        step = levels[-1].select(F.col("id").alias("a")).join(pairs, "a").groupBy("b").agg(F.min("a").alias("parent"))
        levels.append(space.write(near.select(F.col("id").alias("b")).join(step, "b").select(F.col("b").alias("id"), "parent", F.lit(len(levels)).alias("dist")), "meet"))
    return path_row(spark, _back(levels, target))


def path_edges(path: DataFrame) -> DataFrame:
    """(index, from, to) of the consecutive pairs of ``path`` rows, from 1; shorter paths give none."""
    steps = path.select(F.posexplode("path").alias("k", "from"), F.col("path"))
    return steps.select((F.col("k") + 1).alias("index"), "from", F.try_element_at("path", F.col("k") + 2).alias("to")).where("to is not null")


def describe_path(path: DataFrame, raw: DataFrame) -> DataFrame:
    """(index, from, to, transformation): labels of a narrow edge table on each hop.

    A label on a forward row comes before one on a backward row; of several the
    smallest counts; a hop without label has null.
    """
    hops = path_edges(path)
    forward = F.coalesce(F.col("Direction") == "predecesseur", F.lit(False))
    ends = raw.where("Transformation is not null").select(
        F.when(forward, F.col("Nodes")).otherwise(F.col("NodesLie")).alias("from"), F.when(forward, F.col("NodesLie")).otherwise(F.col("Nodes")).alias("to"),
        F.struct((~forward).cast("int").alias("rank"), F.col("Transformation").alias("label")).alias("x"),
    )
    best = hops.select("from", "to").distinct().join(ends, ["from", "to"]).groupBy("from", "to").agg(F.min("x").alias("x"))
    return hops.join(best, ["from", "to"], "left").select("index", "from", "to", F.col("x.label").alias("transformation"))


def path_subgraph(path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (id) and edges (src, dst) of paths."""
    return path.select(F.explode("path").alias("id")).distinct(), path_edges(path).select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def neighborhood(edges: DataFrame, node, depth: int = 1, limit: int = 500) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes (id, dist), edges (src, dst), truncated) around a node, directions ignored.

    Depth is held to 1..4 and ``limit`` to 2000 nodes. Only the edges of expanded
    nodes are looked at, so edges between nodes of the last ring are missing. Nodes
    beyond the limit are dropped by ring and id, and mark the result truncated;
    reaching the limit exactly ends the search unmarked.
    """
    depth, limit = min(max(depth, 1), 4), max(1, min(limit, 2000))
    spark = edges.sparkSession
    space = Workspace(spark, "near")
    edges = space.stored(edges, "edges")
    pairs = edges.select("src", "dst")
    frontier = space.write(_one(spark, edges, node).withColumn("dist", F.lit(0)), "ring0")
    rings, touched, total, truncated = [frontier], [], 1, False
    if not exists(edges, node):
        empty = frontier.limit(0)
        return empty, pairs.limit(0), False
    for d in range(1, depth + 1):
        if total >= limit:
            break
        ids = frontier.select("id")
        touch = pairs.join(ids, pairs["src"] == ids["id"], "left_semi").union(pairs.join(ids, pairs["dst"] == ids["id"], "left_semi"))
        touch = space.write(touch.distinct(), "touched")
        touched.append(touch)
        seen = _union([r.select("id") for r in rings])
        new = touch.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(d))
        room = limit - total
        # One more than fits tells whether any is dropped.
        new = space.write(new.orderBy("id").limit(room + 1), f"ring{d}")
        n = new.count()
        if n > room:
            truncated = True
            new = space.write(new.orderBy("id").limit(room), "cut")
            n = room
        rings.append(new)
        frontier, total = new, total + n
        if not n:
            break
    nodes = _union(rings)
    kept = _union(touched).distinct()
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return nodes, kept.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"), truncated


def numbered_layers(layers: DataFrame) -> DataFrame:
    """(id, layer, rank, width): position of each node in its layer by id."""
    w = Window.partitionBy("layer")
    return layers.select("id", "layer", (F.row_number().over(w.orderBy("id")) - 1).alias("rank"), F.count(F.lit(1)).over(w).alias("width"))
