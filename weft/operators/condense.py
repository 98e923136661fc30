"""Weak and strong components, verdicts, condensation, cycles and layers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.model import nodes_of
from weft.operators import ordered
from weft.operators.components import components
from weft.operators.traverse import distances
from weft.session import Workspace, ship

#: Graphs of at most so many edges are condensed on the driver: about 16 bytes for each end.
DRIVER_EDGES = 500_000
#: Of larger ones, what is left of at most so many edges is finished in one task.
FINISH = 500_000
ROUNDS = 100_000


def in_one_task(edges: DataFrame, fn: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of all rows of a table, which the caller has counted."""
    names, kinds = zip(*((f.name, f.type) for f in _arrow(schema)))

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        found = list(fn(rows))
        for i in range(0, len(found), 50_000):
            columns = list(zip(*found[i : i + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    ship(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, schema)


def in_components(edges: DataFrame, fn: Callable[[list[tuple]], Iterable[tuple]], schema: str, space: Workspace, finish: int, more: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(the rows that ``fn`` makes of each weak component of at most ``finish`` edges (src, dst, ...), edges of the larger ones or None).

    A component's edges meet in one task, which takes one component at a time, so small
    ones need no rounds however many they are.  ``fn`` is given the columns ``more`` too.
    """
    names, kinds = zip(*((f.name, f.type) for f in _arrow(schema)))
    columns = edges.columns
    found = components(edges.select("src", "dst")).select(F.col("id").alias("src"), "component")
    tagged = space.write(edges.join(found, "src"), "tagged")
    # At most one row for each ``finish`` edges.
    large = space.write(tagged.groupBy("component").count().where(F.col("count") > finish).select("component"), "large")
    rest, small = None, tagged
    if not large.isEmpty():
        rest = space.write(tagged.join(F.broadcast(large), "component", "left_semi").select(*columns), "larger")
        small = tagged.join(F.broadcast(large), "component", "left_anti")

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = (x for _, part in groupby(rows, itemgetter(0)) for x in fn([r[1:] for r in part]))
        while chunk := list(islice(out, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], names=list(names))

    ship(edges.sparkSession)
    met = small.repartition("component").sortWithinPartitions("component").select("component", *columns, *more)
    return space.write(met.mapInArrow(run, schema), "of-components"), rest


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def chains(edges: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains of a graph without loops, contracted by doubling; None if there are none.

    A chain is a run of nodes with one predecessor and one successor each.  Returned
    are (id, first, last, back): the nodes before and after the chain and the hops
    from the first; (id, ring): the smallest id of rings, which are chains without
    ends; and (src, dst, w): the other edges, and one from the first to the last of
    each chain, of ``w`` hops.  Rounds grow with the logarithm of the longest chain.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("nxt"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("prv"))
    one = F.lit(1).cast("bigint")
    at = space.write(out.join(back, "id").where("o = 1 and i = 1").select("id", "nxt", one.alias("ahead"), "prv", one.alias("back"), F.col("id").alias("low")), "chain")
    if at.isEmpty():
        return None
    inner = at.select("id")
    for k in range(64):
        left = at.join(inner.withColumnRenamed("id", "nxt"), "nxt", "left_semi").count()
        # 2**k hops are known of every node; what is still inside a chain after as many hops as nodes are left is a ring.
        if not left or 1 << k > 2 * left:
            break
        t = at.select(F.col("id").alias("nxt"), F.col("nxt").alias("n2"), F.col("ahead").alias("a2"), F.col("low").alias("l2"))
        u = at.select(F.col("id").alias("prv"), F.col("prv").alias("p2"), F.col("back").alias("b2"))
        zero = F.lit(0).cast("bigint")
        new = at.join(t, "nxt", "left").join(u, "prv", "left").select(
            "id", F.coalesce("n2", "nxt").alias("nxt"), (F.col("ahead") + F.coalesce("a2", zero)).alias("ahead"), F.coalesce("p2", "prv").alias("prv"), (F.col("back") + F.coalesce("b2", zero)).alias("back"),
            F.least("low", "l2").alias("low"),
        )
        old, at = at, space.write(new, f"double{k}")
        if k:
            space.drop(old)
        else:
            inner = space.write(old.select("id"), "inner")
    ends = inner.withColumnRenamed("id", "nxt")
    paths = space.write(at.join(ends, "nxt", "left_anti").select("id", F.col("prv").alias("first"), F.col("nxt").alias("last"), "back", "ahead"), "paths")
    rings = space.write(at.join(ends, "nxt", "left_semi").select("id", F.col("low").alias("ring")), "rings")
    rest = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_anti").join(inner.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", one.alias("w"))
    whole = paths.where("back = 1 and first != last").select(F.col("first").alias("src"), F.col("last").alias("dst"), (F.col("ahead") + 1).alias("w"))
    rest = space.write(rest.unionByName(whole).groupBy("src", "dst").agg(F.max("w").alias("w")), "contracted")
    return paths, rings, rest


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id reachable when directions are ignored; nodes without edges are their own."""
    ids = nodes_of(edges) if nodes is None else nodes.select("id").union(nodes_of(edges)).distinct()
    found = components(edges.select("src", "dst"))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(comps: DataFrame, column: str = "component") -> DataFrame:
    return comps.groupBy(column).agg(F.count(F.lit(1)).alias("size"))


def component_summary(comps: DataFrame, column: str = "component") -> DataFrame:
    """(components, largest): 0 and 0 for an empty graph."""
    return component_sizes(comps, column).agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def compare(comps: DataFrame | None, source, target) -> str:
    """DifferentComponents, SameComponent, or ScanUnavailable if a node or the table is missing."""
    if comps is None:
        return "ScanUnavailable"
    found = {r["id"]: r["component"] for r in comps.where(F.col("id").isin(source, target)).collect()}
    if source not in found or target not in found:
        return "ScanUnavailable"
    return "SameComponent" if found[source] == found[target] else "DifferentComponents"


def tarjan(pairs: list[tuple]) -> dict:
    """Strong component of every node, named by its smallest id; iterative."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    out: dict = {}
    stack: list = []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    work.append((w, iter(after[w])))
                    break
                if w not in out:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    part = stack[at:]
                    del stack[at:]
                    name = min(part)
                    out.update((x, name) for x in part)
    return out


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, driver_edges: int = DRIVER_EDGES, finish: int = FINISH) -> DataFrame:
    """(id, scc): the smallest id of each strong component.

    Beyond ``driver_edges``, weak components of at most ``finish`` edges are done in one
    task each.  In larger ones, chains are contracted first: their nodes belong to the
    component of their ends if that is one, else each is its own.  Nodes without a
    predecessor or successor are trimmed in rounds; the component of the busiest node, which is the giant one if there
    is any, is what a forward and a backward search share; the rest is coloured:
    every node takes the largest id that reaches it, and the nodes of a colour
    that reach its root backwards are the root's component.  Once at most ``finish``
    edges are left, one task does the rest.
    """
    ids = nodes_of(edges) if nodes is None else nodes.select("id").union(nodes_of(edges)).distinct()
    spark = edges.sparkSession
    space = Workspace(spark, "scc")
    e = space.write(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    kind = e.schema["src"].dataType.simpleString()
    if e.count() <= driver_edges:
        found = tarjan([(r[0], r[1]) for r in e.collect()])
        named = spark.createDataFrame(list(found.items()), f"id {kind}, scc {kind}")
        return ids.join(named, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    done: list[DataFrame] = []
    paths = None
    if e.count() > finish > 0:
        small_ones, rest = in_components(e, lambda pairs: tarjan(pairs).items(), f"id {kind}, scc {kind}", space, finish)
        if rest is None:
            return ids.join(small_ones, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
        done.append(small_ones)
        e = rest
    if e.count() > finish and (found := chains(e, space)):
        paths, rings, rest = found
        done.append(rings.withColumnRenamed("ring", "scc"))
        e = rest.select("src", "dst")

    def small(e: DataFrame) -> bool:
        """Whether one task has finished the edges."""
        if e.isEmpty():
            return True
        if e.count() > finish:
            return False
        done.append(space.write(in_one_task(e, lambda pairs: tarjan(pairs).items(), f"id {kind}, scc {kind}"), "finished"))
        return True

    def without(e: DataFrame, gone: DataFrame, tag: str) -> DataFrame:
        g = gone.select("id")
        return space.write(e.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), tag)

    def trim(e: DataFrame) -> DataFrame:
        """Edges whose ends both have predecessors and successors; nodes that fall away are components of their own."""
        for k in range(ROUNDS):
            inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            new = space.write(inner, f"trim{k}")
            if new.count() == e.count():
                return new
            e = new
        return e

    over = small(e)
    if not over:
        e = trim(e)
        over = small(e)
    if not over:
        degree = e.groupBy(F.col("src").alias("id")).count().join(e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("back")), "id")
        pivot = degree.orderBy(F.desc(F.col("count") * F.col("back")), "id").select("id").limit(1)
        pivot = space.write(pivot, "pivot")
        both = space.write(distances(e, pivot).select("id").join(distances(e, pivot, forward=False).select("id"), "id"), "giant")
        done.append(both.crossJoin(both.agg(F.min("id").alias("scc"))))
        e = trim(without(e, both, "rest"))
        over = small(e)
    while not over:
        colour = space.write(nodes_of(e).withColumn("colour", F.col("id")).withColumn("fell", F.lit(True)), "colour")
        for _ in range(ROUNDS):
            push = colour.where("fell").select(F.col("id").alias("src"), "colour").join(e, "src").select(F.col("dst").alias("id"), "colour")
            top = push.groupBy("id").agg(F.max("colour").alias("new"))
            up = F.coalesce(F.col("new") > F.col("colour"), F.lit(False))
            old, colour = colour, space.write(colour.join(top, "id", "left").select("id", F.when(up, F.col("new")).otherwise(F.col("colour")).alias("colour"), up.alias("fell")), "colour")
            space.drop(old)
            if colour.where("fell").isEmpty():
                break
        c = colour.select("id", "colour")
        same = e.join(c.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        same = space.write(same, "same-colour")
        # Backward from all roots at once: a search stays inside its colour.
        reached = distances(same, c.where("id = colour").select("id"), forward=False).select("id").join(c, "id")
        part = space.write(reached.join(reached.groupBy("colour").agg(F.min("id").alias("scc")), "colour").select("id", "scc"), "coloured")
        done.append(part)
        e = trim(without(e, part, "rest"))
        over = small(e)
    if not done:
        named = ids.select("id", F.col("id").alias("scc")).limit(0)
    else:
        named = reduce(DataFrame.unionByName, [d.select("id", "scc") for d in done])
    if paths is not None:
        named = space.write(named, "named")
        end = lambda c: named.select(F.col("id").alias(c), F.col("scc").alias(f"{c}_scc"))
        there = paths.join(end("first"), "first", "left").join(end("last"), "last", "left")
        a, b = F.coalesce("first_scc", "first"), F.coalesce("last_scc", "last")
        # A chain's nodes join the component of both its ends, whose name may be smaller than theirs or not.
        inside = space.write(there.select("id", F.when(a == b, a).alias("scc")), "inside")
        named = named.unionByName(inside.where("scc is not null"))
        ends = named.unionByName(inside.where("scc is not null").select(F.col("scc").alias("id"), "scc"))
        least = ends.groupBy("scc").agg(F.min("id").alias("least"))
        named = named.unionByName(inside.where("scc is not null").select(F.col("scc").alias("id"), "scc")).distinct().join(least, "scc").select("id", F.col("least").alias("scc"))
        named = space.write(named, "renamed")
    return ids.join(named, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def condensed_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(from_scc, to_scc): edges between different strong components, once."""
    a, b = scc.select(F.col("id").alias("src"), F.col("scc").alias("from_scc")), scc.select(F.col("id").alias("dst"), F.col("scc").alias("to_scc"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("from_scc != to_scc").select("from_scc", "to_scc").distinct()


def reachable(scc: DataFrame | None, dag: DataFrame, source, target, driver_edges: int = DRIVER_EDGES) -> str:
    """Reachable, Unreachable or Unavailable, exactly: a search on the condensed graph, by levels; of a large graph only the weak component of both is searched."""
    if scc is None:
        return "Unavailable"
    found = {r["id"]: r["scc"] for r in scc.where(F.col("id").isin(source, target)).collect()}
    if source not in found or target not in found:
        return "Unavailable"
    if found[source] == found[target]:
        return "Reachable"
    start = scc.where(F.col("id") == F.lit(source)).select("scc")
    space = Workspace(dag.sparkSession, "reachable")
    dag = space.write(dag.select(F.col("from_scc").alias("src"), F.col("to_scc").alias("dst")), "dag")
    if dag.count() > driver_edges:
        weak = space.write(components(dag), "weak")
        ends = {r["id"]: r["component"] for r in weak.where(F.col("id").isin(found[source], found[target])).collect()}
        if len(ends) < 2 or len(set(ends.values())) > 1:
            return "Unreachable"
        dag = dag.join(weak.where(F.col("component") == F.lit(ends[found[source]])).select(F.col("id").alias("src")), "src", "left_semi")
    there = distances(dag, start)
    return "Unreachable" if there.where(F.col("id") == F.lit(found[target])).isEmpty() else "Reachable"


def _peeled(pairs: list[tuple]) -> list[tuple]:
    """Edges that are left when nodes without predecessors are removed, and their edges, until there are none."""
    after: dict = {}
    degree: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        degree[b] = degree.get(b, 0) + 1
    todo = [a for a in after if a not in degree]
    for a in todo:
        for b in after.pop(a, ()):
            degree[b] -= 1
            if not degree[b]:
                todo.append(b)
    return [(a, b) for a, bs in after.items() for b in bs]


def cycle_core(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """Edges that are left when nodes without predecessors, then their edges, are removed until none is: empty if and only if there is no directed cycle.

    Rounds remove one layer each; once at most ``finish`` edges are left, one task does the rest.
    """
    space = Workspace(edges.sparkSession, "peel")
    e = space.write(edges.select("src", "dst").distinct(), "edges")
    kind = e.schema["src"].dataType.simpleString()
    n = e.count()
    for k in range(ROUNDS):
        if n <= finish:
            return space.write(in_one_task(e, _peeled, f"src {kind}, dst {kind}"), "core")
        new = space.write(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), f"peel{k}")
        m = new.count()
        space.drop(e)
        e = new
        if m == n or not m:
            break
        n = m
    return e


def has_cycle(edges: DataFrame, finish: int = FINISH) -> bool:
    """Whether there is a directed cycle, loops included; chains are contracted first, so long ones take few rounds."""
    space = Workspace(edges.sparkSession, "cycle")
    e = space.write(edges.select("src", "dst").distinct(), "edges")
    if not e.where("src = dst").isEmpty():
        return True
    if e.count() > finish and (found := chains(e, space)):
        paths, rings, rest = found
        if not rings.isEmpty() or not paths.where("first = last").isEmpty():
            return True
        e = rest.select("src", "dst")
    return not cycle_core(e, finish).isEmpty()


def _longest(rows: list[tuple]) -> list[tuple]:
    """(id, layer) of the nodes of weighted edges; nothing if they hold a cycle."""
    after: dict = {}
    degree: dict = {}
    for a, b, w in rows:
        after.setdefault(a, []).append((b, w))
        degree[b] = degree.get(b, 0) + 1
    layer = {x: 0 for x in [*after, *degree]}
    todo = [a for a in layer if a not in degree]
    for a in todo:
        for b, w in after.get(a, ()):
            layer[b] = max(layer[b], layer[a] + w)
            degree[b] -= 1
            if not degree[b]:
                todo.append(b)
    return list(layer.items()) if len(todo) == len(layer) else []


def _longest_or_cycle(rows: list[tuple]) -> list[tuple]:
    """As ``_longest``; one layer below 0 if they hold a cycle."""
    return _longest(rows) or [(rows[0][0], -1)]


def topological_layers(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = ROUNDS, finish: int = FINISH) -> DataFrame:
    """(id, layer): 0, or one more than the highest layer of a predecessor; the graph must have no cycle.

    At most ``finish`` edges are done in one task, and so is each weak component of at
    most so many.  Of larger ones, chains are contracted to
    one edge each, of as many layers.  Layers then rise in rounds, as many as the
    longest path has edges; with a cycle they would not end, and ``max_rounds`` or the
    number of nodes stops them with an error.
    """
    ids = nodes_of(edges) if nodes is None else nodes.select("id").union(nodes_of(edges)).distinct()
    space = Workspace(edges.sparkSession, "layers")
    e = space.write(edges.select("src", "dst", F.lit(1).cast("bigint").alias("w")).distinct(), "edges")
    kind = e.schema["src"].dataType.simpleString()
    if not e.where("src = dst").isEmpty():
        raise ValueError("the graph has a cycle")
    paths, small = None, None
    if e.count() > finish > 0:
        small, rest = in_components(e, _longest_or_cycle, f"id {kind}, layer int", space, finish)
        if not small.where("layer < 0").isEmpty():
            raise ValueError("the graph has a cycle")
        e = e.limit(0) if rest is None else rest
    if e.count() > finish and (found := chains(e.select("src", "dst"), space)):
        paths, rings, e = found
        if not rings.isEmpty() or not paths.where("first = last").isEmpty():
            raise ValueError("the graph has a cycle")
    known = _layers(e, space, kind, max_rounds, finish)
    if paths is not None:
        known = space.write(known, "known")
        first = known.select(F.col("id").alias("first"), "layer")
        inside = paths.join(first, "first", "left").select("id", (F.coalesce("layer", F.lit(0)) + F.col("back")).cast("int").alias("layer"))
        known = known.unionByName(inside)
    if small is not None:
        known = known.unionByName(small)
    return ids.join(known, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def _layers(e: DataFrame, space: Workspace, kind: str, max_rounds: int, finish: int) -> DataFrame:
    if e.count() <= finish:
        found = space.write(in_one_task(e, _longest, f"id {kind}, layer int"), "layered")
        if found.isEmpty() and not e.isEmpty():
            raise ValueError("the graph has a cycle")
        return found
    layer = space.write(nodes_of(e).select("id", F.lit(0).alias("layer"), F.lit(True).alias("rose")), "layer0")
    for k in range(min(max_rounds, layer.count() + 1)):
        push = layer.where("rose").select(F.col("id").alias("src"), "layer").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("layer") + F.col("w")).cast("int").alias("new"))
        up = F.coalesce(F.col("new") > F.col("layer"), F.lit(False))
        new = space.write(layer.join(push, "id", "left").select("id", F.when(up, F.col("new")).otherwise(F.col("layer")).alias("layer"), up.alias("rose")), f"layer{k + 1}")
        space.drop(layer)
        layer = new
        if layer.where("rose").isEmpty():
            return layer.select("id", "layer")
    raise ValueError("the graph has a cycle")


def topological_numbers(scc: DataFrame, dag: DataFrame, finish: int = FINISH, rows: int = ordered.ROWS) -> DataFrame:
    """(scc, number) of each strong component: dense numbers from 0 that rise along every edge of ``dag`` (from_scc, to_scc); by layer, then smallest id."""
    pairs = dag.select(F.col("from_scc").alias("src"), F.col("to_scc").alias("dst"))
    layers = topological_layers(pairs, scc.select(F.col("scc").alias("id")).distinct(), finish=finish)
    return ordered.numbered(layers, [F.col("layer"), F.col("id")], rows=rows).select(F.col("id").alias("scc"), "number")
