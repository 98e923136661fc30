"""Node lookups and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.like import blank, contains_like
from weft.model import nodes_of
from weft.operators import stored
from weft.session import Workspace

#: Bounds of searches and pages.
MAX_SEARCH, MAX_PAGE = 100, 500


def search_nodes(edges: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id): the first ``limit`` nodes, 100 at most, that hold ``text``, by id."""
    return nodes_of(edges).where(contains_like(F.col("id").cast("string"), text)).orderBy("id").limit(max(1, min(limit, MAX_SEARCH)))


def transformations(edges: DataFrame) -> DataFrame:
    """(id, transformations): sorted distinct labels of the edges at each node, nulls left out."""
    ends = edges.where("transformation is not null").select(F.explode(F.array("src", "dst")).alias("id"), "transformation")
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("transformation")).alias("transformations"))


def list_nodes(edges: DataFrame, page: int = 1, page_size: int = 50, text: str | None = None) -> DataFrame:
    """(id, transformations, total): one page of nodes by id; the total is that of all pages."""
    page, page_size = max(1, page), max(1, min(page_size, MAX_PAGE))
    nodes = nodes_of(edges)
    if not blank(text):
        nodes = nodes.where(contains_like(F.col("id").cast("string"), text))
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    # The page first: labels are gathered for its nodes only.
    rows = nodes.orderBy("id").offset((page - 1) * page_size).limit(page_size)
    ids = F.broadcast(rows)
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    labels = transformations(near.distinct())
    kind = "array<string>"
    return rows.join(labels, "id", "left").select("id", F.coalesce("transformations", F.array().cast(kind)).alias("transformations")).crossJoin(total)


def stored_nodes(edges: DataFrame, root: str, rows: int = stored.ROWS) -> stored.RangeStore:
    """The nodes (id, transformations), ids as text, stored by id with an index of the parts' rows."""
    labels = transformations(edges).select(F.col("id").cast("string").alias("id"), "transformations")
    all_ = nodes_of(edges).select(F.col("id").cast("string").alias("id")).join(labels, "id", "left")
    kept = Workspace(edges.sparkSession, "nodes").write(all_.select("id", F.coalesce("transformations", F.array().cast("array<string>")).alias("transformations")), "nodes")
    return stored.RangeStore.write(kept, root, ("id",), rows)


def list_stored(store: stored.RangeStore, page: int = 1, page_size: int = 50, text: str | None = None) -> DataFrame:
    """As ``list_nodes``, from ``stored_nodes``: any page costs the part or two that hold it, and with ``text`` a count of each part's matches."""
    page, page_size = max(1, page), max(1, min(page_size, MAX_PAGE))
    rows, total = store.page((page - 1) * page_size, page_size, None if blank(text) else contains_like(F.col("id"), text))
    return rows.withColumn("total", F.lit(total).cast("bigint"))


def node_detail(edges: DataFrame, node) -> DataFrame | None:
    """(role, id, transformation): successors and predecessors, equal pairs once, by id and label; None if the node does not exist."""
    out = edges.where(F.col("src") == F.lit(node)).select(F.lit("successor").alias("role"), F.col("dst").alias("id"), "transformation")
    back = edges.where(F.col("dst") == F.lit(node)).select(F.lit("predecessor").alias("role"), F.col("src").alias("id"), "transformation")
    both = out.unionByName(back).distinct()
    if both.isEmpty():
        return None
    return both.orderBy("role", "id", F.coalesce("transformation", F.lit("")))


def edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that leave a node of ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def edges_into(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that enter a node of ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids``, once for each row of ``edges``: two equi-joins, as a join on either end would compare all pairs."""
    out = edges_from(edges, ids)
    # Those already found by their source are left out of the second join.
    rest = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(*edges.columns)
    return out.select(*edges.columns).unionByName(edges_into(rest, ids).select(*edges.columns))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(id, predecessors, successors): sorted distinct neighbours of each node, itself left out."""
    pair = edges.select("src", "dst").where("src != dst").distinct()
    there = pair.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("successors"))
    back = pair.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("predecessors"))
    none = F.array().cast(f"array<{edges.schema['src'].dataType.simpleString()}>")
    found = nodes_of(edges).join(back, "id", "left").join(there, "id", "left")
    return found.select("id", F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"))


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats, and the side that has them; empty if both hold the same rows."""
    side = lambda a, b, name: a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit(name))
    return side(left, right, "left").unionByName(side(right.select(*left.columns), left, "right"))


def global_stats(edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, average_degree): distinct edges; density m / (n (n - 1)) to 6 digits, 2 m / n to 2; 0 for graphs too small."""
    n = nodes_of(edges).agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    nodes, count = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return n.crossJoin(m).select(
        "nodes", "edges",
        F.when(F.col("nodes") > 1, F.bround(count / F.nullif(nodes * (nodes - 1), F.lit(0.0)), 6)).otherwise(0.0).alias("density"),
        F.when(F.col("nodes") > 0, F.bround(2 * count / F.nullif(nodes, F.lit(0.0)), 2)).otherwise(0.0).alias("average_degree"),
    )


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree): a loop counts twice; nodes without edges have 0."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), one.alias("o"), zero.alias("i")), F.struct(F.col("dst").alias("id"), zero.alias("o"), one.alias("i")))).alias("x")).select("x.*")
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", zero.alias("o"), zero.alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def max_degree(edges: DataFrame, nodes: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(id, degree) of the busiest node; the first in ``order`` (id, pos), or the smallest id, wins ties."""
    found = degrees(edges, nodes)
    if order is not None:
        return found.join(order, "id", "left").orderBy(F.desc("degree"), F.asc_nulls_last("pos"), "id").select("id", "degree").limit(1)
    return found.orderBy(F.desc("degree"), "id").select("id", "degree").limit(1)


def compute_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, isolated, max_degree, max_node, avg_out, avg_degree, density, has_cycle, components."""
    from weft.operators.condense import component_sizes, has_cycle, weak_components

    d = degrees(edges, nodes).agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"), F.coalesce(F.sum((F.col("degree") == 0).cast("bigint")), F.lit(0)).alias("isolated"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("max_node"),
    )
    parts = component_sizes(weak_components(edges, nodes)).agg(F.count(F.lit(1)).alias("components"))
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    safe = lambda x, by: F.coalesce(x / F.nullif(by, F.lit(0.0)), F.lit(0.0))
    return d.crossJoin(parts).select(
        "nodes", "edges", "isolated", "max_degree", "max_node", F.round(safe(m, n), 2).alias("avg_out"), F.round(safe(2 * m, n), 2).alias("avg_degree"),
        F.round(safe(m, n * (n - 1)), 3).alias("density"), F.lit(has_cycle(edges)).alias("has_cycle"), "components",
    )


def looks_layerable(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(layerable): fewer than 1.5 edges for each node; true for an empty graph."""
    d = degrees(edges, nodes).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("m"))
    return d.select(F.expr("n = 0 or m < 1.5 * n").alias("layerable"))
