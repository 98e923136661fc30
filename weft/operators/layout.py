"""Back edges, layers, and coordinates of drawings."""

from __future__ import annotations

from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from weft.operators import ordered
from weft.operators.condense import topological_layers, weak_components
from weft.operators.traverse import distances, numbered_layers
from weft.session import Workspace, ship

#: Drawings are of graphs that a page can hold.
MAX_DRAWN = 20_000


def depth_first_back_edges(nodes: list, pairs: list[tuple]) -> list[tuple]:
    """Edges to a node on the current path, in the order of a depth-first search over nodes and edges as given; loops are included."""
    after: dict = {n: [] for n in nodes}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    state: dict = {}
    back = []
    for root in after:
        if root in state:
            continue
        state[root] = 1
        work = [(root, iter(after[root]))]
        while work:
            v, it = work[-1]
            for w in it:
                if state.get(w) == 1:
                    back.append((v, w))
                elif w not in state:
                    state[w] = 1
                    work.append((w, iter(after[w])))
                    break
            else:
                state[v] = 2
                work.pop()
    return back


def back_edges(nodes: DataFrame, edges: DataFrame, graph: str | None = None) -> DataFrame:
    """(src, dst), and ``graph``: back edges of each graph, nodes (id, pos) and edges (src, dst, pos) taken in order of ``pos``.

    Each graph is searched in one task, as its order is sequential. One graph alone may
    have ``MAX_DRAWN`` rows at most, more are an error; of many graphs each must fit a task.
    """
    if not graph and nodes.select("id").limit(MAX_DRAWN + 1).count() + edges.select("src").limit(MAX_DRAWN + 1).count() > MAX_DRAWN:
        raise ValueError(f"a graph of more than {MAX_DRAWN} nodes and edges is not drawn; name the column that tells graphs apart")
    kind = edges.schema["src"].dataType.simpleString()
    key = graph or "_g"
    n, e = (nodes, edges) if graph else (nodes.withColumn("_g", F.lit(0)), edges.withColumn("_g", F.lit(0)))
    rows = n.select(key, "pos", F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0).alias("t")).unionByName(e.select(key, "pos", "src", "dst", F.lit(1).alias("t")))
    key_kind = rows.schema[key].dataType.simpleString()

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in (key, "src", "src")]

    def found(batches):
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for g, part in groupby(each, itemgetter(0)):
            own, arcs = [], {}
            for _, t, a, b in part:
                if t:
                    arcs[a, b] = None
                else:
                    own.append(a)
            yield from ((g, a, b) for a, b in depth_first_back_edges(own, list(arcs)))

    def run(batches):
        out = found(batches)
        while chunk := list(islice(out, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], names=[key, "src", "dst"])

    # Graphs follow each other in a task: a call for each would cost more than most searches.
    ship(rows.sparkSession)
    met = rows.repartition(key).sortWithinPartitions(key, "t", F.asc_nulls_last("pos")).select(key, "t", "src", "dst")
    out = met.mapInArrow(run, f"{key} {key_kind}, src {kind}, dst {kind}")
    return out if graph else out.drop("_g")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): longest path from a source, back edges left out."""
    back = back_edges(nodes, edges)
    return topological_layers(edges.select("src", "dst").join(back, ["src", "dst"], "left_anti"), nodes)


def layered_positions(layered: DataFrame, sx: float = 1.0, sy: float = 1.0, down: bool = True) -> DataFrame:
    """(id, layer, x, y): nodes of a layer side by side around 0, by id; layers go down, or up the page."""
    w = numbered_layers(layered)
    return w.select("id", "layer", ((F.col("rank") - (F.col("width") - 1) / 2.0) * sx).alias("x"), (F.col("layer") * (-sy if down else sy)).cast("double").alias("y"))


def undirected_layers(edges: DataFrame, first, nodes: DataFrame) -> DataFrame:
    """(id, layer): hops from ``first``, directions ignored; 0 where out of reach."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hops = distances(both, nodes.where(F.col("id") == F.lit(first)).select("id"))
    return nodes.select("id").join(hops, "id", "left").select("id", F.coalesce("dist", F.lit(0)).alias("layer"))


#: Radius of a component's circle, least, for each node, and most; distance of circles on the grid.
CIRCLE_BASE, CIRCLE_STEP, CIRCLE_MOST, GRID = 24.0, 12.0, 92.0, 240.0


def circular_positions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component, x, y): each weak component on a circle of its own, circles on a square grid, first node on top."""
    comps = weak_components(edges, nodes)
    # Places count over ranges of (component, id), so neither a large component nor their number meets in one task.
    space = Workspace(edges.sparkSession, "circles")
    ranked = space.write(ordered.numbered(comps, [F.col("component"), F.col("id")]), "ranked")
    first = space.write(ranked.groupBy("component").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "components")
    cells = ordered.numbered(first, [F.col("component")], "c")
    side = first.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1))))).alias("side"))
    placed = ranked.join(cells, "component").crossJoin(F.broadcast(side)).withColumn("k", F.col("number") - F.col("first"))
    radius = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.least(F.lit(CIRCLE_MOST), CIRCLE_BASE + CIRCLE_STEP * F.col("n")))
    angle = 2 * F.pi() * F.col("k") / F.col("n") - F.pi() / 2
    return placed.select(
        "id", "component", ((F.col("c") % F.col("side")) * GRID + GRID / 2 + radius * F.cos(angle)).alias("x"), (F.floor(F.col("c") / F.col("side")) * GRID + GRID / 2 + radius * F.sin(angle)).alias("y")
    )
