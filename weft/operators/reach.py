"""Reachability of many pairs at once, by labels of a graph without cycles.

Nodes get ``MARKS`` random orders. A node's labels are, for each order, the first of
all nodes that it reaches (itself included) and the first of all that reach it, and its
layer.  If ``a`` reaches ``b``, whatever ``b`` reaches ``a`` does too, so the first node
that ``a`` reaches comes no later than that of ``b``, and the first one that reaches
``b`` no later than that of ``a``; and ``a`` lies on a lower layer.  So most pairs that
do not reach each other fail a comparison.  If for some order the first node that ``a``
reaches is the first one that reaches ``b``, the way leads through it.  Nodes also lie on
paths: an edge from a node to its smallest successor belongs to one if the node is that
one's smallest predecessor. On one path, places decide.  Pairs that no
comparison settles are searched, and every step of the search is settled or dropped by
the same comparisons.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.model import nodes_of
from weft.operators.condense import FINISH, ROUNDS, _longest, condensed_edges, in_components, in_one_task, topological_layers
from weft.session import Workspace

#: Random orders; labels of a node.
MARKS = 4
LABELS = ("layer", "down", "up", "path", "place")


def _ranks(node: str) -> list[Column]:
    """A node's place in each order: a hash, then the node itself, so no two share one."""
    return [F.struct(F.xxhash64(node, F.lit(k)).alias("h"), F.col(node).alias("id")) for k in range(MARKS)]


def _firsts(edges: DataFrame, nodes: DataFrame, space: Workspace, finish: int) -> DataFrame:
    """(id, marks): for each order the first of the nodes that reach ``id`` along edges (src, dst), itself included."""
    kind = nodes.schema["id"].dataType.simpleString()
    start = nodes.select("id", F.array(*_ranks("id")).alias("marks"))
    if edges.count() <= finish:
        mark = f"array<struct<h: bigint, id: {kind}>>"
        both = start.select(F.lit(None).cast(kind).alias("src"), F.col("id").alias("dst"), "marks").unionByName(edges.select("src", "dst", F.lit(None).cast(mark).alias("marks")))
        return space.write(in_one_task(both, _carried, f"id {kind}, marks {mark}"), "marks")
    at = space.write(start.withColumn("fell", F.lit(True)), "marks0")
    best = F.array(*(F.min(F.col("marks")[k]) for k in range(MARKS)))
    for k in range(ROUNDS):
        moved = at.where("fell").select(F.col("id").alias("src"), "marks").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(best.alias("new"))
        least = F.coalesce(F.zip_with("marks", "new", lambda a, b: F.least(a, b)), F.col("marks"))
        new = space.write(at.join(moved, "id", "left").select("id", least.alias("marks"), (least != F.col("marks")).alias("fell")), f"marks{k + 1}")
        space.drop(at)
        at = new
        if at.where("fell").isEmpty():
            return at.select("id", "marks")
    raise ValueError("the graph has a cycle")


def _carried(rows: list[tuple]) -> Iterable[tuple]:
    """Marks carried along the edges in topological order; rows are (null, node, marks) and (src, dst, null)."""
    marks = {b: [(m["h"], m["id"]) for m in x] for _, b, x in rows if x is not None}
    after: dict = {}
    degree = dict.fromkeys(marks, 0)
    for a, b, x in rows:
        if x is None:
            after.setdefault(a, []).append(b)
            degree[b] += 1
    todo = [v for v, n in degree.items() if not n]
    for a in todo:
        for b in after.get(a, ()):
            marks[b] = [min(x, y) for x, y in zip(marks[a], marks[b])]
            degree[b] -= 1
            if not degree[b]:
                todo.append(b)
    return [(v, [{"h": h, "id": i} for h, i in marks[v]]) for v in todo]


def paths(edges: DataFrame, nodes: DataFrame, space: Workspace) -> DataFrame:
    """(id, path, place): disjoint paths that cover all nodes, named by their first node; places by doubling, so rounds grow with the logarithm of the longest."""
    ahead = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    back = edges.groupBy("dst").agg(F.min("src").alias("src"))
    links = ahead.join(back, ["src", "dst"]).select(F.col("dst").alias("id"), F.col("src").alias("up"))
    at = space.write(nodes.join(links, "id", "left").select("id", "up", F.coalesce("up", "id").alias("path"), F.col("up").isNotNull().cast("int").alias("place")), "paths0")
    for k in range(ROUNDS):
        if at.where("up is not null").isEmpty():
            return at.select("id", "path", "place")
        far = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("place").alias("more"))
        new = at.join(far, "up", "left").select("id", F.col("next").alias("up"), F.coalesce("head", "path").alias("path"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        old, at = at, space.write(new, f"paths{k + 1}")
        space.drop(old)
    raise ValueError("the graph has a cycle")


def labels(edges: DataFrame, nodes: DataFrame | None = None, finish: int = FINISH) -> DataFrame:
    """(id, layer, down, up, path, place) of a graph (src, dst) without cycles: the labels that ``answer`` compares."""
    space = Workspace(edges.sparkSession, "reach")
    e = space.write(edges.select("src", "dst").distinct(), "edges")
    ids = space.write(nodes_of(e) if nodes is None else nodes.select("id").union(nodes_of(e)).distinct(), "nodes")
    small = None
    if e.count() > finish > 0:
        kind = e.schema["src"].dataType.simpleString()
        mark = f"array<struct<h: bigint, id: {kind}>>"
        schema = f"id {kind}, layer int, down {mark}, up {mark}, path {kind}, place int"
        small, e = in_components(e, _labelled, schema, space, finish, tuple(F.array(*_ranks(c)).alias(f"{c}_marks") for c in ("src", "dst")))
        if not small.where("layer < 0").isEmpty():
            raise ValueError("the graph has a cycle")
        if nodes is not None:
            alone = ids.join(small.select("id"), "id", "left_anti")
            alone = alone if e is None else alone.join(nodes_of(e), "id", "left_anti")
            own, none = F.array(*_ranks("id")).cast(mark), F.lit(0).cast("int")
            small = small.unionByName(alone.select("id", none.alias("layer"), own.alias("down"), own.alias("up"), F.col("id").alias("path"), none.alias("place")))
        if e is None:
            return space.write(small, "labels") if nodes is not None else small
        ids = space.write(nodes_of(e), "larger-nodes")
    up = _firsts(e, ids, space, finish).withColumnRenamed("marks", "up")
    down = _firsts(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids, space, finish).withColumnRenamed("marks", "down")
    rows = topological_layers(e, ids, finish=finish).join(down, "id").join(up, "id").join(paths(e, ids, space), "id").select("id", *LABELS)
    return space.write(rows if small is None else rows.unionByName(small), "labels")


def _labelled(rows: list[tuple]) -> Iterable[tuple]:
    """All labels of a graph given as (src, dst, marks of src, marks of dst), in topological order; one layer below 0 if it holds a cycle."""
    own = {v: m for a, b, x, y in rows for v, m in ((a, x), (b, y))}
    layer = dict(_longest([(a, b, 1) for a, b, *_ in rows]))
    if not layer:
        return [(rows[0][0], -1, None, None, None, None)]
    starts = [(None, v, m) for v, m in own.items()]
    up = dict(_carried([*starts, *((a, b, None) for a, b, *_ in rows)]))
    down = dict(_carried([*starts, *((b, a, None) for a, b, *_ in rows)]))
    ahead: dict = {}
    back: dict = {}
    for a, b, *_ in rows:
        ahead[a] = min(b, ahead.get(a, b))
        back[b] = min(a, back.get(b, a))
    at: dict = {}
    for v in sorted(layer, key=layer.get):
        before = back.get(v)
        head, place = at[before] if before is not None and ahead[before] == v else (v, -1)
        at[v] = head, place + 1
    return [(v, layer[v], down[v], up[v], *at[v]) for v in layer]


def _verdict(a: str, b: str) -> Column:
    """True or false where labels settle whether ``a`` reaches ``b``, else null; columns are ``a``_down and so on."""
    some = lambda test: F.exists(F.sequence(F.lit(0), F.lit(MARKS - 1)), test)
    at = lambda side, k: F.element_at(F.col(side), k + 1)
    through = some(lambda k: at(f"{a}_down", k) == at(f"{b}_up", k))
    barred = some(lambda k: (at(f"{a}_down", k) > at(f"{b}_down", k)) | (at(f"{b}_up", k) > at(f"{a}_up", k)))
    same = F.col(f"{a}_path") == F.col(f"{b}_path")
    return F.when(same, F.col(f"{a}_place") <= F.col(f"{b}_place")).when(through, True).when(barred | (F.col(f"{a}_layer") >= F.col(f"{b}_layer")), False)


def _with_labels(df: DataFrame, known: DataFrame, node: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return df.join(known.select(F.col("id").alias(node), *(F.col(c).alias(f"{node}_{c}") for c in labels)), node)


def answer(pairs: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, reaches) of distinct ``pairs`` (a, b) of nodes of ``known``, the labels of ``edges``; pairs with other nodes are left out.

    One plan compares the layers and paths of all pairs, a second one the longer labels of
    those that this leaves; the pairs left then go on to the
    successors of their first node, as many steps as the longest path has.
    """
    space = Workspace(pairs.sparkSession, "pairs")
    short = ("layer", "path", "place")
    # Dealt by the first node once, for telling equal pairs and for the first join.
    near = _with_labels(_with_labels(pairs.select("a", "b").repartition("a").distinct(), known, "a", short), known, "b", short)
    same = F.col("a_path") == F.col("b_path")
    near = near.select("a", "b", F.when(same, F.col("a_place") <= F.col("b_place")).when(F.col("a_layer") >= F.col("b_layer"), False).alias("reaches"))
    near = space.write(near, "near")
    told = space.write(_with_labels(_with_labels(near.where("reaches is null").select("a", "b"), known, "a"), known, "b").withColumn("reaches", _verdict("a", "b")), "told")
    found = [told.where("reaches").select("a", "b")]
    ends = [f"b_{c}" for c in LABELS]
    left = told.where("reaches is null").select("a", "b", *ends, F.col("a").alias("at"))
    for k in range(ROUNDS):
        step = left.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("x")), "at").select("a", "b", *ends, "x").distinct()
        step = space.write(_with_labels(step, known, "x").withColumn("reaches", _verdict("x", "b")).where("reaches is null or reaches"), f"step{k}")
        if step.isEmpty():
            break
        here = step.where("reaches").select("a", "b").distinct()
        found.append(here)
        left = step.where("reaches is null").select("a", "b", *ends, F.col("x").alias("at")).join(here, ["a", "b"], "left_anti")
    yes = found[0]
    for x in found[1:]:
        yes = yes.unionByName(x)
    searched = told.select("a", "b").join(yes.distinct().withColumn("reaches", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("reaches", F.lit(False)).alias("reaches"))
    return near.where("reaches is not null").unionByName(searched)


def settled_share(pairs: DataFrame, known: DataFrame) -> float:
    """Share of ``pairs`` that the comparisons of labels settle."""
    told = _with_labels(_with_labels(pairs.select("a", "b").distinct(), known, "a"), known, "b").withColumn("reaches", _verdict("a", "b"))
    r = told.agg(F.count("reaches").alias("k"), F.count(F.lit(1)).alias("n")).first()
    return r["k"] / r["n"] if r["n"] else 1.0


def verdicts(pairs: DataFrame, edges: DataFrame, weak: DataFrame, scc: DataFrame) -> DataFrame:
    """(a, b, verdict) of distinct ``pairs``: Unavailable, DifferentComponents, Reachable or Unreachable, exactly.

    ``weak`` (id, component) and ``scc`` (id, scc) are those of ``edges``. Weak
    components spare most pairs, strong ones some; the rest compares labels of the
    condensed graph, a strong component standing for its nodes.
    """
    space = Workspace(pairs.sparkSession, "verdicts")
    known = weak.join(scc, "id").select("id", "component", "scc")
    at = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_w"), F.col("scc").alias(f"{c}_s"))
    both = space.write(pairs.select("a", "b").repartition("a").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left"), "both")
    none, apart = F.col("a_w").isNull() | F.col("b_w").isNull(), F.col("a_w") != F.col("b_w")
    early = F.when(none, "Unavailable").when(apart, "DifferentComponents").when(F.col("a_s") == F.col("b_s"), "Reachable")
    both = both.withColumn("early", early)
    dag = space.write(condensed_edges(edges, scc).select(F.col("from_scc").alias("src"), F.col("to_scc").alias("dst")), "dag")
    asked = both.where("early is null").select(F.col("a_s").alias("a"), F.col("b_s").alias("b"))
    told = answer(asked, dag, labels(dag)).select(F.col("a").alias("a_s"), F.col("b").alias("b_s"), "reaches")
    late = F.when(F.col("reaches"), "Reachable").otherwise("Unreachable")
    return both.join(told, ["a_s", "b_s"], "left").select("a", "b", F.coalesce("early", late).alias("verdict"))
