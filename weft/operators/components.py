"""Connected components by randomised contraction.

Every round maps each vertex to the vertex of its closed neighbourhood whose
hash under that round's seed is smallest, and renames the edges; the edges
shrink by a constant factor in expectation, whatever the shape of the graph, so
chains need no more rounds than stars (Boegeholz, Brand and Todor 2020).  Each
partition first replaces its edges by a spanning forest.  Rounds are written to
the shared folder.  Once at most ``FINISH`` edges are left, one task joins them;
that is a bound, not a function of the input.  Edges that are more after ``ROUNDS``
rounds, which shrink them by a factor of thousands, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import Workspace, ship

FINISH = 200_000
ROUNDS = 60


def find(parent: dict, x):
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def forest(pairs: Iterator[tuple]) -> dict:
    """Parents after joining all pairs; the smaller root wins."""
    parent: dict = {}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            if b < a:
                a, b = b, a
            parent[b] = a
    return parent


def _local(names: tuple[str, str], whole: bool):
    """Edges of a partition to (vertex, root); ``whole`` keeps roots as (root, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, schema = {}, None
        for b in batches:
            schema = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(parent, x), find(parent, y)
                if x != y:
                    if y < x:
                        x, y = y, x
                    parent[y] = x
        if schema is not None:
            rows = [(v, find(parent, v)) for v in list(parent)]
            if not whole:
                rows = [r for r in rows if r[0] != r[1]]
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], schema.field(k).type) for k in (0, 1)], names=list(names))

    return run


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(id, component) for every vertex of ``edges``, whose first two columns are the ends.

    The component is its smallest id.  Null ends and loops to oneself join
    nothing; a vertex with loops only is not listed.  Equal edges count once.
    """
    spark = edges.sparkSession
    ship(spark)
    space = Workspace(spark, "components")
    a, b = edges.columns[:2]
    kind = edges.schema[a].dataType.simpleString()
    e = edges.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where(F.col("a") != F.col("b"))
    e = space.write(e.mapInArrow(_local(("a", "b"), False), f"a {kind}, b {kind}").distinct(), "edges")
    maps = []
    for k in range(ROUNDS + 1):
        n = e.count()
        if n > finish and k == ROUNDS:
            raise RuntimeError(f"{n} edges are left after {ROUNDS} rounds")
        if n <= finish:
            maps.append(space.write(e.coalesce(1).mapInArrow(_local(("v", "m"), True), f"v {kind}, m {kind}"), "last"))
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(h("b")).alias("n"))
        m = space.write(near.select(F.col("a").alias("v"), F.least(F.col("n"), h("a"))["v"].alias("m")), f"map{k}")
        maps.append(m)
        ends = (
            e.join(m.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
            .join(m.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
            .where(F.col("ma") != F.col("mb"))
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        )
        old, e = e, space.write(ends, f"edges{k}")
        space.drop(old)
    label = maps[-1].select("v", F.col("m").alias("root"))
    for m in reversed(maps[:-1]):
        up = label.select(F.col("v").alias("m"), "root")
        label = m.join(up, "m", "left").select("v", F.coalesce("root", "m").alias("root"))
    if len(maps) == 1:  # the last map already leads to the smallest id
        return label.select(F.col("v").alias("id"), F.col("root").alias("component"))
    label = space.write(label, "labels")
    least = label.groupBy("root").agg(F.min(F.least("v", "root")).alias("component"))
    return label.join(least, "root").select(F.col("v").alias("id"), "component")
