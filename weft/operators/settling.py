"""Searches that settle labels in order of cost, bucket by bucket, on tables of any size.

A label is (cost, hops, path); its key is its cost plus a lower bound ``h`` on what is
left.  A round relaxes all labels of the lowest bucket of keys that have not been
relaxed since they fell: one join with the edges and one aggregate over labels and
candidates.  Bounds must be consistent, so keys never fall along an edge, and every
label with a key below the lowest open one is settled.  Buckets are as wide as the
least weight, and a round then settles its bucket at once; lighter edges only make
rounds repeat.  Paths travel with their labels, since searches between two nodes have
few hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import Workspace

#: Fixed value: a search ends once so many nodes are settled.
MAX_SETTLED = 600_000
#: At most so many buckets up to the bound of the cost.
BUCKETS = 128
NEVER = float("inf")


def width_of(edges: DataFrame, max_cost: float) -> float:
    """Width of the buckets for edges (a, b, w): the least positive weight, or more where that made too many."""
    least = edges.where("w > 0").agg(F.min("w")).first()[0]
    return max(least or 1.0, max_cost / BUCKETS)


class Settling:
    """One search from a node over edges (a, b, w), written tables all."""

    def __init__(self, edges: DataFrame, start, space: Workspace, max_cost: float, width: float, bounds: DataFrame | None = None):
        self.edges, self.space, self.max_cost, self.width, self.bounds = edges, space, max_cost, width, bounds
        self.kind = edges.schema["a"].dataType.simpleString()
        first = edges.sparkSession.createDataFrame([(start, 0.0, 0, [start], 0.0, False)], f"id {self.kind}, cost double, hops int, path array<{self.kind}>, key double, relaxed boolean")
        self.labels = space.write(first, "start")
        #: Lowest open key, labels relaxed so far, all labels, labels of each round in turn.
        self.top, self.settled, self.size, self.rounds = 0.0, 0, 1, 0

    @property
    def open(self) -> bool:
        return self.top is not None

    def step(self, most: float) -> None:
        """Relax the lowest bucket; labels with a key above ``most`` are dropped."""
        due = ~F.col("relaxed") & (F.col("key") < self.top + self.width)
        moved = self.labels.where(due).select(F.col("id").alias("a"), "cost", "hops", "path").join(self.edges, "a")
        new = moved.select(F.col("b").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("b")).alias("path"))
        new = new.where(F.col("cost") <= min(most, self.max_cost))
        if self.bounds is not None:
            new = new.join(self.bounds, "id", "left").withColumn("key", F.col("cost") + F.coalesce("h", F.lit(0))).drop("h").where(F.col("key") <= min(most, self.max_cost))
        else:
            new = new.withColumn("key", F.col("cost"))
        # Of equal labels the one already there stands: it has been relaxed.
        both = self.labels.withColumn("fresh", ~F.col("relaxed") & ~due).drop("relaxed").unionByName(new.withColumn("fresh", F.lit(True)))
        parent = F.try_element_at("path", F.lit(-2))
        least = both.groupBy("id").agg(F.min(F.struct("cost", "hops", parent.alias("parent"), "path", "key", "fresh")).alias("x"))
        old = self.labels
        self.labels = self.space.write(least.select("id", "x.cost", "x.hops", "x.path", "x.key", (~F.col("x.fresh")).alias("relaxed")), f"round{self.rounds}")
        self.space.drop(old)
        self.rounds += 1
        r = self.labels.agg(F.min(F.when(~F.col("relaxed"), F.col("key"))).alias("top"), F.count(F.when(F.col("relaxed"), 1)).alias("done"), F.count(F.lit(1)).alias("size")).first()
        self.top, self.settled, self.size = r["top"], r["done"], r["size"]

    def label(self, node) -> dict | None:
        r = self.labels.where(F.col("id") == F.lit(node)).first()
        return r.asDict() if r else None

    def before(self, label: dict) -> int:
        """Labels that are settled before ``label``, in order of key, cost, hops and id."""
        order = F.struct("key", "cost", "hops", "id")
        return self.labels.where(order < F.struct(*(F.lit(label[c]).cast(k) for c, k in (("key", "double"), ("cost", "double"), ("hops", "int"), ("id", self.kind))))).count()


def cheapest(edges: DataFrame, source, target, max_cost: float, space: Workspace, bounds: DataFrame | None = None, most: int = MAX_SETTLED) -> tuple[dict | None, Settling]:
    """(label of the target or None, the search): labels above the target's are dropped once it has one, and the search ends when it is settled.

    Nothing is found if more than ``most`` nodes are settled before the target.
    """
    search = Settling(edges, source, space, max_cost, width_of(edges, max_cost), bounds)
    found = None
    while search.open and search.settled <= most:
        if found and found["key"] < search.top:
            break
        search.step(found["cost"] if found else NEVER)
        found = search.label(target)
    if found and (search.settled > most and search.open and found["key"] >= search.top or search.before(found) > most):
        found = None
    return found, search


def meeting(edges: DataFrame, source, target, max_cost: float, space: Workspace, whole: bool = True, most: int = MAX_SETTLED) -> tuple[dict | None, Settling, Settling]:
    """(cost and id where both searches meet on a cheapest path, or None; both searches).

    The side with fewer settled nodes moves. The search ends when the lowest open
    labels of both sides together cost no less than the best path, when both sides
    are done, or when more than ``most`` nodes are settled. ``whole``: ``max_cost``
    bounds the path, else each side alone.
    """
    width = width_of(edges, max_cost)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    sides = Settling(edges, source, space, max_cost, width), Settling(back, target, space, max_cost, width)
    best = None
    while any(s.open for s in sides) and sides[0].settled + sides[1].settled <= most:
        tops = [s.top if s.open else 0.0 for s in sides]
        if best and sum(tops) >= best["cost"]:
            break
        side = min((s for s in sides if s.open), key=lambda s: s.settled)
        other = sides[1] if side is sides[0] else sides[0]
        side.step(best["cost"] if best else NEVER)
        both = side.labels.select("id", "cost").join(other.labels.select("id", F.col("cost").alias("rest")), "id")
        row = both.select((F.col("cost") + F.col("rest")).alias("cost"), "id").orderBy("cost", "id").first()
        best = row.asDict() if row and (not whole or row["cost"] <= max_cost) else best
    return best, *sides


def weighted_edges(edges: DataFrame, weight: Column) -> DataFrame:
    """(a, b, w): the lightest edge of each pair."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("w")).where("a is not null and b is not null").groupBy("a", "b").agg(F.min("w").alias("w"))
