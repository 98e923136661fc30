"""The registered queries of the lineage engine, each with SQL of the same meaning where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.like import contains_like
from weft.model import duplicate_keys, nodes_of, to_edges, wide_to_edges
from weft.operators import condense, history, layout, lookup, procs, reach, traverse, weighted
from weft.operators.components import components
from weft.plans import derived as D
from weft.operators.stored import StoredWide
from weft.session import Workspace, own_folder
from weft.sources import catalog, edges as sources, sinks, tabular, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


#: Nodes of a graph named g.
NODES = "n AS (SELECT src AS id FROM g UNION SELECT dst FROM g)"
DEPTH, COST = 20, 30


def ends(edges: DataFrame):
    """The smallest source and the largest target of a graph."""
    r = edges.agg(F.min("src").alias("s"), F.max("dst").alias("t")).first()
    return r["s"], r["t"]


def one(spark: SparkSession, value, kind: str) -> DataFrame:
    return spark.createDataFrame([(value,)], f"id {kind}")


@query("edge_normalize", f"WITH {D.FULL} SELECT src, dst, transformation FROM g")
def edge_normalize(spark, sf):
    return D.full(spark, sf)


@query("node_universe", f"WITH {D.FULL}, {NODES} SELECT id FROM n")
def node_universe(spark, sf):
    return nodes_of(D.full(spark, sf))


@query("edges_distinct", f"WITH {D.FULL} SELECT DISTINCT src, dst FROM g")
def edges_distinct(spark, sf):
    return D.full(spark, sf).select("src", "dst").distinct()


@query("raw_pairs", f"WITH {D.FULL_RAW} SELECT Nodes, NodesLie, count(*) AS n FROM raw GROUP BY 1, 2")
def raw_pairs(spark, sf):
    return sources.raw_pairs(D.full_table(spark, sf)).groupBy("Nodes", "NodesLie").agg(F.count(F.lit(1)).alias("n"))


@query("adjacency", f"WITH {D.FULL} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM g GROUP BY 1")
def adjacency(spark, sf):
    from weft.model import LineageGraph

    return LineageGraph(D.full(spark, sf)).adjacency().select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query("approximate_bytes", f"WITH {D.FULL}, {NODES} SELECT CAST(4 * (2 * (count(*) + 1) + 2 * (SELECT count(*) FROM g)) + sum(24 + 2 * length(id) + 56) AS BIGINT) AS bytes FROM n")
def approximate_bytes(spark, sf):
    from weft.model import LineageGraph

    return LineageGraph(D.full(spark, sf)).approximate_bytes()


@query("node_search", f"WITH {D.FULL}, {NODES} SELECT id FROM n WHERE lower(id) LIKE '%p1%' ORDER BY id LIMIT 20")
def node_search(spark, sf):
    return lookup.search_nodes(D.full(spark, sf), "p1")


@query("node_search_pattern", f"WITH {D.FULL}, {NODES} SELECT id FROM n WHERE regexp_matches(id, '(?i)^.*p[12].5.*$') ORDER BY id LIMIT 50")
def node_search_pattern(spark, sf):
    return lookup.search_nodes(D.full(spark, sf), "p[12]_5", 50)


LABELS = "t AS (SELECT id, string_agg(DISTINCT transformation, '|' ORDER BY transformation) AS transformations FROM (SELECT src AS id, transformation FROM g UNION ALL SELECT dst, transformation FROM g) WHERE transformation IS NOT NULL GROUP BY id)"


@query("node_transformations", f"WITH {D.FULL}, {LABELS} SELECT * FROM t")
def node_transformations(spark, sf):
    return lookup.transformations(D.full(spark, sf)).select("id", F.array_join("transformations", "|").alias("transformations"))


@query("node_list_page", f"WITH {D.FULL}, {NODES}, {LABELS}, f AS (SELECT id FROM n WHERE id ILIKE '%1%'), p AS (SELECT id FROM f ORDER BY id LIMIT 25 OFFSET 50) SELECT p.id, coalesce(transformations, '') AS transformations, (SELECT count(*) FROM f) AS total FROM p LEFT JOIN t ON t.id = p.id")
def node_list_page(spark, sf):
    return lookup.list_nodes(D.full(spark, sf), 3, 25, "1").select("id", F.array_join("transformations", "|").alias("transformations"), "total")


@query("node_list_deep_page", f"WITH {D.FULL}, {NODES}, {LABELS}, f AS (SELECT id FROM n WHERE id ILIKE '%1%'), p AS (SELECT id FROM f ORDER BY id LIMIT 7 OFFSET 7 * (SELECT count(*) // 9 FROM f)) SELECT p.id, coalesce(transformations, '') AS transformations, (SELECT count(*) FROM f) AS total FROM p LEFT JOIN t ON t.id = p.id")
def node_list_deep_page(spark, sf):
    """A page near the end, read from the one part that holds it."""
    store = lookup.stored_nodes(D.full(spark, sf), own_folder(spark, "nodes"), 500)
    total = store.page(0, 1, contains_like(F.col("id"), "1"))[1]
    return lookup.list_stored(store, total // 9 + 1, 7, "1").select("id", F.array_join("transformations", "|").alias("transformations"), "total")


@query("node_detail", f"WITH {D.FULL}, {NODES}, k AS (SELECT min(id) AS k FROM n) SELECT DISTINCT 'successor' AS role, dst AS id, transformation FROM g, k WHERE src = k UNION SELECT 'predecessor', src, transformation FROM g, k WHERE dst = k")
def node_detail(spark, sf):
    g = D.full(spark, sf)
    return lookup.node_detail(g, nodes_of(g).agg(F.min("id")).first()[0])


@query("neighbour_lists", f"""WITH {D.EVENT}, {NODES} SELECT id, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM g WHERE dst = id AND src <> id), '') AS predecessors,
coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM g WHERE src = id AND dst <> id), '') AS successors FROM n""")
def neighbour_lists(spark, sf):
    return lookup.neighbour_lists(D.event(spark, sf)).select("id", F.array_join("predecessors", ",").alias("predecessors"), F.array_join("successors", ",").alias("successors"))


#: The parts that lookups and searches of several nodes start from.
_SOME = "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11'"


def _some(spark, sf):
    return D.table(spark, sf, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("id"))


@query("edges_from", f"WITH {D.PARTS} SELECT src, dst FROM g WHERE src IN ({_SOME})")
def edges_from(spark, sf):
    g = D.parts(spark, sf)
    return lookup.edges_from(g, _some(spark, sf))


@query("edges_into", f"WITH {D.PARTS} SELECT src, dst FROM g WHERE dst IN ({_SOME})")
def edges_into(spark, sf):
    g = D.parts(spark, sf)
    return lookup.edges_into(g, _some(spark, sf)).select("src", "dst")


@query("edges_touching", f"WITH {D.PARTS} SELECT src, dst FROM g WHERE src IN ({_SOME}) OR dst IN ({_SOME})")
def edges_touching(spark, sf):
    g = D.parts(spark, sf)
    return lookup.edges_touching(g, _some(spark, sf))


@query("row_difference", f"WITH {D.PARTS}, r AS (SELECT dst AS src, src AS dst FROM g) SELECT *, 'left' AS side FROM (FROM g EXCEPT ALL FROM r) UNION ALL SELECT *, 'right' FROM (FROM r EXCEPT ALL FROM g)")
def row_difference(spark, sf):
    """What the part graph and its reverse do not share."""
    g = D.parts(spark, sf)
    return lookup.row_difference(g, g.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("node_exists", f"WITH {D.PARTS} SELECT (SELECT min(src) FROM g) AS id, true AS found UNION ALL SELECT -1, false")
def node_exists(spark, sf):
    g = D.parts(spark, sf)
    return spark.createDataFrame([(x, traverse.exists(g, x)) for x in (ends(g)[0], -1)], "id bigint, found boolean")


@query("global_stats", f"WITH {D.FULL}, {NODES}, c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM g)) AS edges) SELECT nodes, edges, round_even(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 6) AS density, round_even(2.0 * edges / CAST(nodes AS DOUBLE), 2) AS average_degree FROM c")
def global_stats(spark, sf):
    return lookup.global_stats(D.full(spark, sf))


DEGREES = "d AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT dst, 0, 1 FROM g) GROUP BY id)"


@query("degree_stats", f"WITH {D.FULL}, {DEGREES} SELECT * FROM d")
def degree_stats(spark, sf):
    return lookup.degrees(D.full(spark, sf))


@query("max_degree", f"WITH {D.FULL}, {DEGREES} SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 1")
def max_degree(spark, sf):
    return lookup.max_degree(D.full(spark, sf))


@query("isolated_nodes", f"WITH {D.SEQUENCES}, e AS (SELECT a, b FROM h WHERE p = q), n AS (SELECT a AS id FROM e UNION SELECT b FROM e) SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n)")
def isolated_nodes(spark, sf):
    """Orders whose neighbours among the customer's orders have other priorities."""
    same = D.sequences(spark, sf).where("p = q").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = lookup.degrees(same, D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return found.where("degree = 0").select("id")


@query("graph_statistics", f"""WITH RECURSIVE {D.EVENT}, {NODES}, {DEGREES}, reach(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM reach r JOIN g ON r.b = g.src),
und AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), link(a, b) AS (SELECT a, b FROM und UNION SELECT l.a, u.b FROM link l JOIN und u ON l.b = u.a),
comp AS (SELECT id, least(id, coalesce((SELECT min(b) FROM link WHERE a = id), id)) AS c FROM n)
SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, CAST(sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated, max(degree) AS max_degree, arg_min(id, (-degree, id)) AS max_node,
round(sum(out_degree) / CAST(count(*) AS DOUBLE), 2) AS avg_out, round(2.0 * sum(out_degree) / CAST(count(*) AS DOUBLE), 2) AS avg_degree, round(sum(out_degree) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 3) AS density,
(SELECT count(*) > 0 FROM reach WHERE a = b) AS has_cycle, (SELECT count(DISTINCT c) FROM comp) AS components FROM d""")
def graph_statistics(spark, sf):
    return lookup.compute_stats(D.event(spark, sf))


@query("looks_layerable", f"WITH {D.PARTS}, {NODES} SELECT (SELECT count(*) FROM g) < 1.5 * count(*) AS layerable FROM n")
def looks_layerable(spark, sf):
    return lookup.looks_layerable(D.parts(spark, sf))


# The wide table.

KEY4 = "DTA_1, DTA_2, DTA_3, DTA_4"
ORDER4 = ", ".join(f"DTA_{i} NULLS FIRST" for i in (1, 2, 3, 4))


def _nodes_list(where: str, total: str, rows: int, key: str = KEY4) -> str:
    return f"""WITH {D.WIDE}, r AS (SELECT LNA_UID, LIN_UID, EDG_DIR, {KEY4}, row_number() OVER (PARTITION BY {key} ORDER BY LIN_UID, LNA_UID, EDG_DIR) AS rn FROM wide WHERE {where})
SELECT LNA_UID, LIN_UID, EDG_DIR, {KEY4}, (SELECT count(*) FROM (SELECT DISTINCT {KEY4} FROM wide WHERE {total})) AS TotalLignes FROM r WHERE rn = 1 ORDER BY {ORDER4} LIMIT {rows}"""


@query("nodes_list_default", _nodes_list("lower(DTA_1) LIKE 'f%'", "true", 100))
def nodes_list_default(spark, sf):
    return D.stored_wide(spark, sf).nodes_list()


@query("nodes_list_scanned", _nodes_list("lower(DTA_1) LIKE 'f%'", "true", 100))
def nodes_list_scanned(spark, sf):
    return procs.nodes_list(D.wide(spark, sf))


@query("nodes_list_cached", _nodes_list("lower(DTA_1) LIKE 'f%'", "true", 10))
def nodes_list_cached(spark, sf):
    wide = D.wide(spark, sf)
    return procs.nodes_list(wide, " ", "", max_rows=10, cached=procs.stats(wide))


@query("nodes_list_filtered", _nodes_list("lower(DTA_2) LIKE '%eco%' AND lower(DTA_4) LIKE '%1%'", "lower(DTA_2) LIKE '%eco%' AND lower(DTA_4) LIKE '%1%'", 100))
def nodes_list_filtered(spark, sf):
    return D.stored_wide(spark, sf).nodes_list(table="Eco", env="1")


PATTERN = "regexp_matches(DTA_1, '(?i)^.*d.b.*#[2-4][^13].*$')"


@query("nodes_list_pattern", _nodes_list(PATTERN, PATTERN, 50))
def nodes_list_pattern(spark, sf):
    return D.stored_wide(spark, sf).nodes_list(column="d_b%#[2-4][^13]", max_rows=50)


@query("nodes_list_prefix_key", _nodes_list("lower(DTA_1) LIKE 'f%'", "true", 100, "substring(DTA_1, 1, 150), substring(DTA_2, 1, 80), substring(DTA_3, 1, 500), substring(DTA_4, 1, 150)"))
def nodes_list_prefix_key(spark, sf):
    return procs.nodes_list(D.wide(spark, sf), prefix=True)


HEADER_SQL = "coalesce(RON_APP, '') AS RON_APP, coalesce(PCK_PGM_NME, '') AS PCK_PGM_NME, coalesce(EXE_PGM_NME, '') AS EXE_PGM_NME, coalesce(VRS_EXE_PGM, '') AS VRS_EXE_PGM, coalesce(APP_ENV, '') AS APP_ENV, coalesce(DLY_PGM_TSP, TIMESTAMP '1900-01-01') AS DLY_PGM_TSP, coalesce(LNA_TSP, TIMESTAMP '1900-01-01') AS LNA_TSP, coalesce(PGM_TEC, '') AS PGM_TEC, coalesce(VRS_LNA_TOO, '') AS VRS_LNA_TOO, coalesce(TUS_IND, 0) AS TUS_IND"
_P = [f"trim(coalesce(EDG_{i}, ''))" for i in (4, 3, 2, 1)]
NODE_SQL = f"{_P[0]} || " + " || ".join(f"CASE WHEN {a} <> '' AND {b} <> '' THEN '.' || {b} ELSE '' END" for a, b in zip(_P, _P[1:])) + " AS CURRENT_NODE"
WIDE_LIST = ", ".join(f"w.{c}" for c in D.WIDE_COLUMNS)
START = "SELECT * FROM wide WHERE LNA_UID = 'LNA_A' AND EDG_DIR = 'O' ORDER BY LIN_UID LIMIT 1"


def _succ_pred(kind: str, columns: str, start: str = START, rows: int = 100) -> str:
    match = " AND ".join(f"((SELECT {columns}_{i} FROM s) IS NULL OR w.DTA_{i} = (SELECT {columns}_{i} FROM s))" for i in (1, 2, 3, 4))
    return f"""WITH {D.WIDE}, {D.HEA}, s AS ({start}), w AS (SELECT * FROM wide w WHERE EDG_DIR = '{kind}' AND LNA_UID IN (SELECT LNA_UID FROM hea) AND {match}),
page AS (SELECT * FROM w ORDER BY {ORDER4}, LNA_UID, LIN_UID, EDG_DIR LIMIT {rows})
SELECT {WIDE_LIST}, {HEADER_SQL}, {NODE_SQL}, (SELECT count(*) FROM w) AS TotalLignes FROM page w JOIN hea h ON h.LNA_UID = w.LNA_UID"""


def _succ(spark, sf, kind, use_edg=False, known=True, rows=100, direction="O"):
    store = D.stored_wide(spark, sf)
    start = store.keys().where((F.col("LNA_UID") == "LNA_A") & (F.col("EDG_DIR") == direction)).agg(F.min("LIN_UID")).first() if known else None
    return store.successors_predecessors(D.headers(spark), "LNA_A", start[0] if start else "none", direction, kind, use_edg, rows)


@query("succ_pred_resolved", _succ_pred("O", "DTA"))
def succ_pred_resolved(spark, sf):
    return _succ(spark, sf, "O")


@query("succ_pred_other_direction", _succ_pred("I", "DTA", START.replace("'O'", "'I'")))
def succ_pred_other_direction(spark, sf):
    return _succ(spark, sf, "I", direction="I")


@query("succ_pred_use_edg", _succ_pred("O", "EDG"))
def succ_pred_use_edg(spark, sf):
    return _succ(spark, sf, "O", use_edg=True)


@query("succ_pred_unknown", _succ_pred("O", "DTA", "SELECT * FROM wide WHERE false", 50))
def succ_pred_unknown(spark, sf):
    return _succ(spark, sf, "O", known=False, rows=50)


#: The key whose coordinates have the most rows.
SHARED = f"SELECT w.* FROM wide w JOIN (SELECT {KEY4}, count(*) AS c FROM wide GROUP BY ALL) USING ({KEY4}) ORDER BY c DESC, LNA_UID, LIN_UID, EDG_DIR LIMIT 1"


@query("succ_pred_shared", _succ_pred("O", "DTA", SHARED))
def succ_pred_shared(spark, sf):
    store = D.stored_wide(spark, sf)
    rows = store.rows.read().select(*procs.DATA, F.struct("LNA_UID", "LIN_UID", "EDG_DIR").alias("key"))
    top = rows.groupBy(*procs.DATA).agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key")).orderBy(F.desc("c"), "key").select("key.*").first()
    return store.successors_predecessors(D.headers(spark), *top, "O")


@query("succ_pred_scanned", _succ_pred("O", "EDG"))
def succ_pred_scanned(spark, sf):
    wide = D.wide(spark, sf)
    start = wide.where("LNA_UID = 'LNA_A' and EDG_DIR = 'O'").agg(F.min("LIN_UID")).first()
    return procs.successors_predecessors(wide, D.headers(spark), "LNA_A", start[0] or "none", "O", "O", True)


MERGED = f"""{D.WIDE}, moved AS (SELECT LNA_UID, LIN_UID, EDG_DIR, CASE WHEN m THEN 'moved_' || DTA_1 ELSE DTA_1 END AS DTA_1, DTA_2, DTA_3, CASE WHEN m THEN NULL ELSE DTA_4 END AS DTA_4
FROM (SELECT *, LNA_UID = 'LNA_R' AND DTA_4 = 'NATION_7' AS m FROM wide)), merged AS (SELECT * FROM moved UNION ALL SELECT LNA_UID, LIN_UID || '_new', EDG_DIR, DTA_1, DTA_2, 'new', DTA_4 FROM wide WHERE EDG_DIR = 'O' AND DTA_4 = 'NATION_3')"""


@query("wide_merged", f"""WITH {MERGED}, f AS (SELECT DISTINCT ON ({KEY4}) {KEY4}, LIN_UID FROM merged ORDER BY {KEY4}, LIN_UID, LNA_UID, EDG_DIR),
c AS (SELECT DTA_1, DTA_4, count(*) AS coordinates, min(LIN_UID) AS first, max(LIN_UID) AS last FROM f GROUP BY 1, 2), r AS (SELECT DTA_1, DTA_4, count(*) AS n FROM merged GROUP BY 1, 2)
SELECT c.DTA_1, c.DTA_4, n, coordinates, first, last FROM c JOIN r ON r.DTA_1 = c.DTA_1 AND r.DTA_4 IS NOT DISTINCT FROM c.DTA_4""")
def wide_merged(spark, sf):
    """Two change sets of the wide table: coordinates that move, then new rows; the second one twice, as after a failure."""
    store, space = StoredWide.write(D.wide_pieces(spark, sf), own_folder(spark, "merged")), Workspace(spark, "changes")
    # Both are taken from the stored rows before one of them is merged.
    wide = store.rows.read().select(*D.WIDE_COLUMNS)
    moved = wide.where("LNA_UID = 'LNA_R' and DTA_4 = 'NATION_7'").withColumns({"DTA_1": F.concat(F.lit("moved_"), "DTA_1"), "DTA_4": F.lit(None).cast("string")})
    added = wide.where("EDG_DIR = 'O' and DTA_4 = 'NATION_3'").withColumns({"LIN_UID": F.concat("LIN_UID", F.lit("_new")), "DTA_3": F.lit("new")})
    moved, added = space.write(moved, "moved"), space.write(added, "added")
    for changes in (moved, added, added):
        store.merge(changes)
    firsts = store.coordinates.read().groupBy("DTA_1", "DTA_4").agg(F.count(F.lit(1)).alias("coordinates"), F.min("LIN_UID").alias("first"), F.max("LIN_UID").alias("last"))
    rows = store.rows.read().groupBy(F.col("DTA_1").alias("a"), F.col("DTA_4").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return firsts.join(rows, F.col("DTA_1").eqNullSafe(F.col("a")) & F.col("DTA_4").eqNullSafe(F.col("b"))).select("DTA_1", "DTA_4", "n", "coordinates", "first", "last")


@query("stored_stats", f"WITH {D.WIDE} SELECT 1 AS Id, CAST((SELECT count(*) FROM (SELECT DISTINCT {KEY4} FROM wide)) AS INTEGER) AS DistinctDTACount, count(*) AS RowCountTotal FROM wide")
def stored_stats(spark, sf):
    return D.stored_wide(spark, sf).stats().drop("RefreshedAt")


@query("refresh_stats", f"WITH {D.WIDE} SELECT 1 AS Id, CAST((SELECT count(*) FROM (SELECT DISTINCT {KEY4} FROM wide)) AS INTEGER) AS DistinctDTACount, count(*) AS RowCountTotal FROM wide")
def refresh_stats(spark, sf):
    return procs.stats(D.wide(spark, sf)).drop("RefreshedAt")


@query("derived_keys", f"WITH {D.WIDE} SELECT LNA_UID, LIN_UID, EDG_DIR, substring(DTA_1, 1, 150) AS DTA_1_k, substring(DTA_2, 1, 80) AS DTA_2_k, substring(DTA_3, 1, 500) AS DTA_3_k, substring(DTA_4, 1, 150) AS DTA_4_k FROM wide")
def derived_keys(spark, sf):
    return procs.with_keys(D.wide(spark, sf)).select("LNA_UID", "LIN_UID", "EDG_DIR", "DTA_1_k", "DTA_2_k", "DTA_3_k", "DTA_4_k")


@query("derived_keys_changed", f"WITH {D.WIDE} SELECT LIN_UID, EDG_DIR, LNA_UID FROM (SELECT *, CASE WHEN length(LIN_UID) % 3 = 0 THEN NULL ELSE substring(DTA_1, 1, 150) END AS k FROM wide) WHERE k IS DISTINCT FROM substring(DTA_1, 1, 150)")
def derived_keys_changed(spark, sf):
    keyed = procs.with_keys(D.wide(spark, sf)).withColumn("DTA_1_k", F.when(F.length("LIN_UID") % 3 == 0, None).otherwise(F.col("DTA_1_k")))
    return procs.changed_keys(keyed).select("LIN_UID", "EDG_DIR", "LNA_UID")


@query("primary_key_check", f"WITH {D.WIDE} SELECT DTA_1, EDG_DIR, count(*) AS n FROM wide GROUP BY 1, 2 HAVING count(*) > 1")
def primary_key_check(spark, sf):
    return duplicate_keys(D.wide(spark, sf), ("DTA_1", "EDG_DIR"))


JOINED = "concat_ws('.', nullif(trim({0}_4), ''), nullif(trim({0}_3), ''), nullif(trim({0}_2), ''), nullif(trim({0}_1), ''))"
WIDE_EDGES = f"{D.WIDE}, b AS (SELECT {JOINED.format('DTA')} AS d, {JOINED.format('EDG')} AS e, EDG_DIR AS w FROM wide), g AS (SELECT CASE w WHEN 'I' THEN d ELSE e END AS src, CASE w WHEN 'I' THEN e ELSE d END AS dst FROM b WHERE d <> '' AND e <> '')"


@query("wide_to_edges", f"WITH {WIDE_EDGES} SELECT src, dst, count(*) AS n FROM g GROUP BY 1, 2")
def wide_edges(spark, sf):
    return wide_to_edges(D.wide(spark, sf)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# Searches.


def _bfs(a: str, b: str, start: str, depth: int) -> str:
    return f"WITH RECURSIVE {D.PARTS}, d(id, k) AS (SELECT {start}, 0 FROM g UNION SELECT {b}, k + 1 FROM d JOIN g ON {a} = id WHERE k < {depth}) SELECT id, CAST(min(k) AS INTEGER) AS dist FROM d GROUP BY id"


@query("bfs_distances", _bfs("src", "dst", "min(src)", 40))
def bfs_distances(spark, sf):
    g = D.parts(spark, sf)
    return traverse.distances(g, one(spark, ends(g)[0], "bigint"), max_depth=40)


@query("bfs_backward", _bfs("dst", "src", "max(dst)", 6))
def bfs_backward(spark, sf):
    g = D.parts(spark, sf)
    return traverse.distances(g, one(spark, ends(g)[1], "bigint"), forward=False, max_depth=6)


@query("bfs_multi_source", f"WITH RECURSIVE {D.PARTS}, d(id, k) AS (SELECT DISTINCT p_partkey, 0 FROM part WHERE p_brand = 'Brand#11' UNION SELECT dst, k + 1 FROM d JOIN g ON src = id WHERE k < 5) SELECT id, CAST(min(k) AS INTEGER) AS dist FROM d GROUP BY id")
def bfs_multi_source(spark, sf):
    g = D.parts(spark, sf)
    return traverse.distances(g, _some(spark, sf), max_depth=5)


@query("bfs_distributed", _bfs("src", "dst", "min(src)", 40))
def bfs_distributed(spark, sf):
    g = D.parts(spark, sf)
    return traverse.distances(g, one(spark, ends(g)[0], "bigint"), max_depth=40, driver_edges=0)


def _path(base: str, depth: int, s: str = "min(src)", t: str = "max(dst)") -> str:
    return f"""WITH RECURSIVE {base}, z AS (SELECT {s} AS s, {t} AS t FROM g), d(id, k) AS (SELECT s, 0 FROM z UNION SELECT dst, k + 1 FROM d JOIN g ON src = id WHERE k < {depth}),
m AS (SELECT id, min(k) AS k FROM d GROUP BY id), par AS (SELECT v.id, min(u.id) AS p FROM m v JOIN g ON g.dst = v.id JOIN m u ON u.id = g.src AND u.k = v.k - 1 GROUP BY v.id),
walk(id, p) AS (SELECT m.id, CAST(m.id AS VARCHAR) FROM m, z WHERE m.id = z.t UNION ALL SELECT par.p, CAST(par.p AS VARCHAR) || '>' || walk.p FROM walk JOIN par ON par.id = walk.id)
SELECT coalesce(max(p), '') AS path, count(p) > 0 AS found FROM walk, z WHERE walk.id = z.s"""


def _shown(path: DataFrame) -> DataFrame:
    return path.select(F.array_join("path", ">").alias("path"), "found")


@query("shortest_path_one_sided", _path(D.PARTS, DEPTH))
def shortest_path_one_sided(spark, sf):
    g = D.parts(spark, sf)
    return _shown(traverse.shortest_path(g, *ends(g), max_depth=DEPTH))


@query("shortest_path_bidirectional", _path(D.PARTS, DEPTH))
def shortest_path_bidirectional(spark, sf):
    g = D.parts(spark, sf)
    return _shown(traverse.bidirectional_path(g, *ends(g), max_depth=DEPTH))


@query("shortest_path_distributed", _path(D.PARTS, DEPTH))
def shortest_path_distributed(spark, sf):
    g = D.parts(spark, sf)
    return _shown(traverse.bidirectional_path(g, *ends(g), max_depth=DEPTH, driver_edges=0))


@query("shortest_path_one_sided_distributed", _path(D.PARTS, DEPTH))
def shortest_path_one_sided_distributed(spark, sf):
    g = D.parts(spark, sf)
    return _shown(traverse.shortest_path(g, *ends(g), max_depth=DEPTH, driver_edges=0))


@query("shortest_path_unbounded", _path(D.PARTS, 60))
def shortest_path_unbounded(spark, sf):
    g = D.parts(spark, sf)
    return _shown(traverse.shortest_path(g, *ends(g), max_depth=None, most=0))


DESCRIBED = _path(D.FULL, 8).rsplit("SELECT coalesce", 1)[0] + """, w AS (SELECT walk.p AS path FROM walk, z WHERE walk.id = z.s),
hop AS (SELECT i AS index, string_split(path, '>')[i] AS "from", string_split(path, '>')[i + 1] AS "to" FROM w, range(1, 40) r(i) WHERE i < len(string_split(path, '>')))
"""


@query("path_edges", DESCRIBED + 'SELECT CAST(index AS INTEGER) AS index, "from", "to" FROM hop')
def path_edges(spark, sf):
    g = D.full(spark, sf)
    return traverse.path_edges(traverse.bidirectional_path(g, *ends(g), max_depth=8))


@query("path_describe", DESCRIBED + """, l AS (SELECT h.index, h."from", h."to", Transformation AS x, CASE WHEN Direction = 'predecesseur' THEN 0 ELSE 1 END AS rank FROM hop h JOIN raw ON Transformation IS NOT NULL AND
((Direction = 'predecesseur' AND Nodes = h."from" AND NodesLie = h."to") OR (Direction <> 'predecesseur' AND NodesLie = h."from" AND Nodes = h."to")))
SELECT CAST(h.index AS INTEGER) AS index, h."from", h."to", (SELECT x FROM l WHERE l.index = h.index ORDER BY rank, x LIMIT 1) AS transformation FROM hop h""")
def path_describe(spark, sf):
    g = D.full(spark, sf)
    return traverse.describe_path(traverse.bidirectional_path(g, *ends(g), max_depth=8), D.full_table(spark, sf))


@query("path_subgraph", DESCRIBED + 'SELECT DISTINCT unnest(["from", "to"]) AS id FROM hop')
def path_subgraph(spark, sf):
    g = D.full(spark, sf)
    return traverse.path_subgraph(traverse.bidirectional_path(g, *ends(g), max_depth=8))[0]


RINGS = "u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r(id, k) AS (SELECT min(src), 0 FROM g UNION SELECT b, k + 1 FROM r JOIN u ON a = id WHERE k < {k}), ring AS (SELECT id, CAST(min(k) AS INTEGER) AS dist FROM r GROUP BY id)"


#: The order graph is thin enough for three rings to stay below the operator's bound of 2000 nodes.
@query("neighborhood_nodes", f"WITH RECURSIVE {D.ORDERS}, {RINGS.format(k=3)} SELECT id, dist FROM ring")
def neighborhood_nodes(spark, sf):
    g = D.orders(spark, sf)
    return traverse.neighborhood(g, ends(g)[0], 3, 2000)[0]


@query("neighborhood_edges", f"WITH RECURSIVE {D.ORDERS}, {RINGS.format(k=3)} SELECT src, dst FROM g JOIN ring a ON a.id = src JOIN ring b ON b.id = dst WHERE a.dist < 3 OR b.dist < 3")
def neighborhood_edges(spark, sf):
    g = D.orders(spark, sf)
    return traverse.neighborhood(g, ends(g)[0], 3, 2000)[1]


WEIGHTED = D.PARTS.replace(" g AS", " s AS", 1) + ", g AS (SELECT src, dst, CAST((src + dst) % 4 + 1 AS DOUBLE) AS weight FROM s)"
COSTS = f"c(id, cost) AS (SELECT min(src), CAST(0 AS DOUBLE) FROM g UNION SELECT dst, cost + weight FROM c JOIN g ON src = id WHERE cost + weight <= {COST}), best AS (SELECT id, min(cost) AS cost FROM c GROUP BY id)"


def _weighted(spark, sf):
    return D.parts(spark, sf).withColumn("weight", ((F.col("src") + F.col("dst")) % 4 + 1).cast("double"))


@query("dijkstra_costs", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT id, cost FROM best")
def dijkstra_costs(spark, sf):
    g = _weighted(spark, sf)
    return weighted.costs(g, one(spark, ends(g)[0], "bigint"), COST).select("id", "cost")


@query("dijkstra_distributed", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT id, cost FROM best")
def dijkstra_distributed(spark, sf):
    g = _weighted(spark, sf)
    return weighted.costs(g, one(spark, ends(g)[0], "bigint"), COST, driver_edges=0).select("id", "cost")


FAR = "(SELECT max(id) FROM best)"


def _far(spark, sf):
    g = _weighted(spark, sf)
    s = ends(g)[0]
    return g, s, weighted.costs(g, one(spark, s, "bigint"), COST).agg(F.max("id")).first()[0]


@query("dijkstra_weighted", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT true AS found, cost FROM best WHERE id = {FAR}")
def dijkstra_weighted(spark, sf):
    return weighted.dijkstra(*_far(spark, sf), COST).select("found", "cost")


@query("dijkstra_bidirectional", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT true AS found, cost FROM best WHERE id = {FAR}")
def dijkstra_bidirectional(spark, sf):
    return weighted.bidirectional_dijkstra(*_far(spark, sf), COST).select("found", "cost")


@query("dijkstra_weighted_distributed", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT true AS found, cost FROM best WHERE id = {FAR}")
def dijkstra_weighted_distributed(spark, sf):
    return weighted.dijkstra(*_far(spark, sf), COST, driver_edges=0).select("found", "cost")


@query("dijkstra_bidirectional_distributed", f"WITH RECURSIVE {WEIGHTED}, {COSTS} SELECT true AS found, cost FROM best WHERE id = {FAR}")
def dijkstra_bidirectional_distributed(spark, sf):
    return weighted.bidirectional_dijkstra(*_far(spark, sf), COST, driver_edges=0).select("found", "cost")


@query("astar_alt", _path(D.PARTS, DEPTH))
def astar_alt(spark, sf):
    g = D.parts(spark, sf)
    s, t = ends(g)
    return _shown(weighted.a_star(g, s, t, weighted.landmarks(g, 2), DEPTH))


@query("astar_distributed", _path(D.PARTS, DEPTH))
def astar_distributed(spark, sf):
    g = D.parts(spark, sf)
    s, t = ends(g)
    return _shown(weighted.a_star(g, s, t, weighted.landmarks(g, 2, driver_edges=0), DEPTH, driver_edges=0))


LANDMARK = f"""WITH RECURSIVE {D.PARTS}, {NODES}, d(id, k) AS (SELECT min(id), 0 FROM n UNION SELECT dst, k + 1 FROM d JOIN g ON src = id WHERE k < 60), m AS (SELECT id, min(k) AS k FROM d GROUP BY id),
l AS (SELECT id FROM m WHERE k > 0 ORDER BY k DESC, id LIMIT 1), f(id, k) AS (SELECT id, 0 FROM l UNION SELECT dst, k + 1 FROM f JOIN g ON src = id WHERE k < 60), t(id, k) AS (SELECT id, 0 FROM l UNION SELECT src, k + 1 FROM t JOIN g ON dst = id WHERE k < 60),
f1 AS (SELECT id, min(k) AS k FROM f GROUP BY id), t1 AS (SELECT id, min(k) AS k FROM t GROUP BY id)
SELECT (SELECT id FROM l) AS landmark, coalesce(f1.id, t1.id) AS node, CAST(f1.k AS INTEGER) AS dist_from, CAST(t1.k AS INTEGER) AS dist_to FROM f1 FULL JOIN t1 ON f1.id = t1.id"""


@query("landmark_distances", LANDMARK)
def landmark_distances(spark, sf):
    return weighted.landmarks(D.parts(spark, sf), 1)


@query("landmarks_distributed", LANDMARK)
def landmarks_distributed(spark, sf):
    return weighted.landmarks(D.parts(spark, sf), 1, driver_edges=0)


# Components.

LINKS = "u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), link(a, b) AS (SELECT a, b FROM u UNION SELECT l.a, u.b FROM link l JOIN u ON l.b = u.a), comp AS (SELECT a AS id, min(b) AS component FROM link GROUP BY a)"
REACH = "reach(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM reach r JOIN g ON r.b = g.src), sc AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS scc FROM n LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a) x ON x.a = n.id GROUP BY n.id)"


@query("weak_components", f"WITH RECURSIVE {D.ORDERS}, {LINKS} SELECT id, component FROM comp")
def weak_components(spark, sf):
    return condense.weak_components(D.orders(spark, sf))


@query("component_sizes", f"WITH RECURSIVE {D.ORDERS}, {LINKS} SELECT component, count(*) AS size FROM comp GROUP BY 1")
def component_sizes(spark, sf):
    return condense.component_sizes(condense.weak_components(D.orders(spark, sf)))


@query("component_summary", f"WITH RECURSIVE {D.ORDERS}, {LINKS}, s AS (SELECT count(*) AS size FROM comp GROUP BY component) SELECT count(*) AS components, max(size) AS largest FROM s")
def component_summary(spark, sf):
    return condense.component_summary(condense.weak_components(D.orders(spark, sf)))


@query("component_verdict", f"WITH RECURSIVE {D.ORDERS}, {LINKS} SELECT CASE WHEN (SELECT component FROM comp WHERE id = (SELECT min(src) FROM g)) = (SELECT component FROM comp WHERE id = (SELECT max(dst) FROM g)) THEN 'SameComponent' ELSE 'DifferentComponents' END AS verdict")
def component_verdict(spark, sf):
    g = D.orders(spark, sf)
    return spark.createDataFrame([(condense.compare(condense.weak_components(g), *ends(g)),)], "verdict string")


@query("components_contraction", f"WITH RECURSIVE {D.ORDERS}, {LINKS} SELECT id, component FROM comp")
def components_contraction(spark, sf):
    return components(D.orders(spark, sf), finish=100)


@query("scc_members", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT id, scc FROM sc")
def scc_members(spark, sf):
    return condense.strong_components(D.orders(spark, sf))


@query("scc_distributed", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT id, scc FROM sc")
def scc_distributed(spark, sf):
    return condense.strong_components(D.orders(spark, sf), driver_edges=0, finish=0)


@query("part_components", f"WITH RECURSIVE {D.PARTS}, {LINKS} SELECT id, component FROM comp")
def part_components(spark, sf):
    return condense.weak_components(D.parts(spark, sf))


@query("part_scc", f"WITH RECURSIVE {D.PARTS}, {NODES}, {REACH} SELECT id, scc FROM sc")
def part_scc(spark, sf):
    return condense.strong_components(D.parts(spark, sf))


@query("scc_sizes", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT scc, count(*) AS size FROM sc GROUP BY 1")
def scc_sizes(spark, sf):
    return condense.component_sizes(condense.strong_components(D.orders(spark, sf)), "scc")


@query("scc_condensed_edges", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT DISTINCT a.scc AS from_scc, b.scc AS to_scc FROM g JOIN sc a ON a.id = src JOIN sc b ON b.id = dst WHERE a.scc <> b.scc")
def scc_condensed_edges(spark, sf):
    g = D.orders(spark, sf)
    return condense.condensed_edges(g, condense.strong_components(g))


TOPO = f"""sc2 AS (SELECT DISTINCT scc FROM sc), ce AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM g JOIN sc a ON a.id = src JOIN sc b ON b.id = dst WHERE a.scc <> b.scc),
y(id, k) AS (SELECT scc, 0 FROM sc2 UNION SELECT dst, k + 1 FROM y JOIN ce ON src = id), lay AS (SELECT id, max(k) AS k FROM y GROUP BY id)"""


@query("scc_numbers", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH}, {TOPO} SELECT id AS scc, row_number() OVER (ORDER BY k, id) - 1 AS number FROM lay")
def scc_numbers(spark, sf):
    """Numbers of strong components that rise along every edge, by ranges of layers."""
    g = D.orders(spark, sf)
    scc = condense.strong_components(g)
    return condense.topological_numbers(scc, condense.condensed_edges(g, scc), rows=2000)


@query("reach_pairs", f"""WITH RECURSIVE {D.ORDER_DAG}, {NODES}, p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority),
r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src)
SELECT DISTINCT p.a, p.b, r.a IS NOT NULL AS reaches FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b LEFT JOIN r ON r.a = p.a AND r.b = p.b""")
def reach_pairs(spark, sf):
    """Whether an order leads to another of the same customer and priority, for all such pairs at once."""
    e = D.order_dag(spark, sf)
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    pairs = o.withColumnRenamed("o_orderkey", "a").join(o.withColumnRenamed("o_orderkey", "b"), ["o_custkey", "o_orderpriority"]).select("a", "b")
    return reach.answer(pairs, e, reach.labels(e))


@query("path_verdicts", f"""WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH}, {LINKS}, p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
UNION SELECT o_orderkey, o_orderkey + 1 FROM orders)
SELECT a, b, CASE WHEN x.component IS NULL OR y.component IS NULL THEN 'Unavailable' WHEN x.component <> y.component THEN 'DifferentComponents' WHEN a = b OR EXISTS (SELECT 1 FROM reach r WHERE r.a = p.a AND r.b = p.b) THEN 'Reachable' ELSE 'Unreachable' END AS verdict
FROM p LEFT JOIN comp x ON x.id = p.a LEFT JOIN comp y ON y.id = p.b""")
def path_verdicts(spark, sf):
    """What is known of many pairs before any search: components first, then labels of the condensed graph."""
    g = Workspace(spark, "orders").write(D.orders(spark, sf), "edges")
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    pairs = o.withColumnRenamed("o_orderkey", "a").join(o.withColumnRenamed("o_orderkey", "b"), ["o_custkey", "o_orderpriority"]).select("a", "b")
    pairs = pairs.unionByName(o.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b")))
    return reach.verdicts(pairs, g, condense.weak_components(g), condense.strong_components(g))


@query("scc_reachability", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT CASE WHEN count(*) > 0 THEN 'Reachable' ELSE 'Unreachable' END AS verdict FROM reach WHERE a = (SELECT min(src) FROM g) AND b = (SELECT max(dst) FROM g)")
def scc_reachability(spark, sf):
    g = D.orders(spark, sf)
    scc = condense.strong_components(g)
    return spark.createDataFrame([(condense.reachable(scc, condense.condensed_edges(g, scc), *ends(g)),)], "verdict string")


@query("has_cycle", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT count(*) > 0 AS cyclic FROM reach WHERE a = b")
def has_cycle(spark, sf):
    return spark.createDataFrame([(condense.has_cycle(D.orders(spark, sf)),)], "cyclic boolean")


LAYERS = f"{NODES}, y(id, k) AS (SELECT id, 0 FROM n UNION SELECT dst, k + 1 FROM y JOIN g ON src = id), layer AS (SELECT id, CAST(max(k) AS INTEGER) AS layer FROM y GROUP BY id)"


@query("topo_layers", f"WITH RECURSIVE {D.DAG}, {LAYERS} SELECT id, layer FROM layer")
def topo_layers(spark, sf):
    return condense.topological_layers(D.dag(spark, sf))


@query("topo_layers_distributed", f"WITH RECURSIVE {D.ORDER_DAG}, {LAYERS} SELECT id, layer FROM layer")
def topo_layers_distributed(spark, sf):
    return condense.topological_layers(D.order_dag(spark, sf), finish=0)


@query("layout_positions", f"WITH RECURSIVE {D.DAG}, {LAYERS} SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) - 1 - (count(*) OVER (PARTITION BY layer) - 1) / 2.0 AS x, CAST(-layer AS DOUBLE) AS y FROM layer".replace("row_number()", "CAST(row_number()", 1).replace("/ 2.0 AS x", "/ 2.0 AS DOUBLE) AS x"))
def layout_positions(spark, sf):
    return layout.layered_positions(condense.topological_layers(D.dag(spark, sf)))


@query("undirected_layers", f"WITH RECURSIVE {D.PARTS}, {NODES}, {RINGS.format(k=40)} SELECT n.id, coalesce(ring.dist, 0) AS layer FROM n LEFT JOIN ring ON ring.id = n.id")
def undirected_layers(spark, sf):
    g = D.parts(spark, sf)
    return layout.undirected_layers(g, ends(g)[0], nodes_of(g))


@query("circular_layout", """WITH e AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation), m AS (SELECT src AS id, src AS r FROM e UNION SELECT dst, src FROM e),
c AS (SELECT id, min(id) OVER (PARTITION BY r) AS component, row_number() OVER (PARTITION BY r ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY r) AS n FROM m),
o AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS c FROM (SELECT DISTINCT component FROM c)), z AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM o)
SELECT id, c.component, round((o.c % side) * 240 + 120 + least(92, 24 + 12 * n) * cos(2 * pi() * k / n - pi() / 2), 4) + 0 AS x, round((o.c // side) * 240 + 120 + least(92, 24 + 12 * n) * sin(2 * pi() * k / n - pi() / 2), 4) + 0 AS y FROM c JOIN o ON o.component = c.component, z""")
def circular_layout(spark, sf):
    found = layout.circular_positions(*D.places(spark, sf))
    return found.select("id", "component", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y"))


@query("back_edges", f"WITH {D.SEQUENCES} SELECT cust, b AS src, a AS dst FROM h WHERE b IS NOT NULL AND p = q")
def back_edges(spark, sf):
    """A graph for each customer, searched from the first order on: the edges back are those against the dates."""
    h = D.sequences(spark, sf)
    edges = h.where("b is not null").select("cust", F.col("a").alias("src"), F.col("b").alias("dst"), (2 * F.col("k")).alias("pos"))
    back = h.where("b is not null and p = q").select("cust", F.col("b").alias("src"), F.col("a").alias("dst"), (2 * F.col("k") + 1).alias("pos"))
    return layout.back_edges(h.select("cust", F.col("a").alias("id"), F.col("k").alias("pos")), edges.unionByName(back), "cust")


# Sources.


@query("complete_graph", "SELECT a.n_name AS \"from\", b.n_name AS \"to\" FROM nation a JOIN nation b ON a.n_name < b.n_name")
def complete_graph(spark, sf):
    return catalog.complete_pairs(D.table(spark, sf, "nation").select(F.col("n_name").alias("n")))


_SAMPLES = "s(k, slug, src, dst, weight) AS (VALUES " + ", ".join(f"({k}, '{s[0]}', '{a}', '{b}', CAST({'NULL' if w is None else w} AS INTEGER))" for k, s in enumerate(catalog.SAMPLES) for a, b, w in s[6]) + ")"


@query("sample_catalog", f"WITH {_SAMPLES} SELECT p_partkey AS part, slug, src, dst, weight FROM part JOIN s ON p_partkey % {len(catalog.SAMPLES)} = k")
def sample_catalog(spark, sf):
    """The edges of the sample graph of each part: one of the catalogue, by its key."""
    place = F.array_position(F.lit([s[0] for s in catalog.SAMPLES]), F.col("slug")) - 1
    part = D.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % len(catalog.SAMPLES)).alias("k"))
    return part.join(F.broadcast(catalog.sample_edges(spark).withColumn("k", place)), "k").drop("k")


def _tabular(spark, sf):
    o, c = D.table(spark, sf, "orders"), D.table(spark, sf, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("DTA 1"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus")).alias("dta_02"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("c_mktsegment")).alias("edg-1"), F.when(F.col("o_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("edg4"),
        F.when(F.col("o_orderkey") % 3 == 0, "in").when(F.col("o_orderkey") % 3 == 1, " Out").otherwise("x").alias("EDG_DIR"), F.col("o_orderkey").cast("string").alias("txn_dta"),
    )


TABULAR = """t AS (SELECT o_orderkey AS pos, concat_ws('.', CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END, o_orderpriority) AS d,
concat_ws('.', CASE WHEN o_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END, CASE WHEN o_custkey % 5 <> 0 THEN c_mktsegment END) AS e,
CASE o_orderkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'O' ELSE 'X' END AS w, CAST(o_orderkey AS VARCHAR) AS txn FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("tabular_graph_nodes", f"WITH {TABULAR}, s AS (SELECT d AS id, 'dta' AS kind, pos FROM t WHERE d <> '' UNION ALL SELECT e, 'edg', pos FROM t WHERE e <> '') SELECT id, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'both' END AS kind, min(pos) AS pos FROM s GROUP BY id")
def tabular_graph_nodes(spark, sf):
    return tabular.rows_to_graph(_tabular(spark, sf), "pos", check=False)[0]


@query("tabular_graph_edges", f"WITH {TABULAR}, l AS (SELECT CASE w WHEN 'I' THEN d ELSE e END AS source, CASE w WHEN 'I' THEN e ELSE d END AS target, txn, pos FROM t WHERE d <> '' AND e <> '' AND w <> 'X') SELECT source, target, arg_min(txn, pos) AS txn FROM l GROUP BY 1, 2")
def tabular_graph_edges(spark, sf):
    return tabular.rows_to_graph(_tabular(spark, sf), "pos", check=False)[1]


@query("history_graph", """WITH v AS (SELECT user_id, event_type AS id, event_id % 2 = 1 AS back, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT DISTINCT user_id, CASE WHEN back THEN id ELSE prev END AS src, CASE WHEN back THEN prev ELSE id END AS dst FROM v WHERE prev IS NOT NULL AND prev <> id""")
def history_graph(spark, sf):
    return history.graph(D.event_visits(spark, sf), ["user_id"])


@query("history_recorded", """WITH v AS (SELECT user_id, event_type AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
k AS (SELECT user_id, step, id, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS r FROM v WHERE prev IS NULL OR prev <> id) SELECT user_id, step, id FROM k WHERE r <= 200""")
def history_recorded(spark, sf):
    return history.recorded(D.event_visits(spark, sf), by=["user_id"]).select("user_id", "step", "id")


@query("generated_wide", """SELECT 'LNA_' || (id % 5) AS LNA_UID, 'LIN_' || id AS LIN_UID, CASE id % 3 WHEN 0 THEN 'FIADODSWRK' WHEN 1 THEN 'fld_' || (id % 500) ELSE 'COL_' || (id % 500) END AS DTA_1, 'ZJ' AS DTA_2,
upper(substring(md5(CAST(id AS VARCHAR)), 1, 8)) || '_SCHEMA' AS DTA_3, 'ENV' || (id % 4) AS DTA_4, CASE id % 2 WHEN 0 THEN 'O' ELSE 'I' END AS EDG_DIR, 'EDG_' || (id % 500) AS EDG_1,
CASE WHEN id % 2 <> 0 THEN 'TAB_' || (id % 97) END AS EDG_2, CASE WHEN id % 3 <> 0 THEN 'SCH_' || (id % 97) END AS EDG_3, CASE WHEN id % 4 <> 0 THEN 'ENV_' || (id % 97) END AS EDG_4,
CASE WHEN id % 5 <> 0 THEN '{"n":' || id || '}' END AS TXN_DTA, '<t>' || id || '</t>' AS PRX_TXN_DTA FROM (SELECT 200000 + row_number() OVER () AS id FROM lineitem)""")
def generated_wide(spark, sf):
    """As many generated rows as there are order lines."""
    return sources.generate_wide(spark, 200_001, 200_000 + D.table(spark, sf, "lineitem").count())


_FLAGS = ", ".join(f"('LNA_{x}', {zlib.crc32(f'LNA_{x}'.encode())})" for x in "ANR")


@query("generated_headers", f"""WITH c(uid, h) AS (VALUES {_FLAGS}) SELECT uid AS LNA_UID, 'APP_' || uid AS RON_APP, 'PCK_' || uid AS PCK_PGM_NME, 'PGM_' || uid AS EXE_PGM_NME, 'v' || (h % 9) AS VRS_EXE_PGM,
CASE h % 2 WHEN 0 THEN 'PROD' ELSE 'TEST' END AS APP_ENV, TIMESTAMP '2024-01-01' - to_days(CAST(h % 30 AS INTEGER)) AS DLY_PGM_TSP, TIMESTAMP '2024-01-01' - to_hours(h % 24) AS LNA_TSP,
CASE h % 3 WHEN 0 THEN 'COBOL' ELSE 'SQL' END AS PGM_TEC, '1.0' AS VRS_LNA_TOO, CAST(h % 2 AS INTEGER) AS TUS_IND FROM c WHERE uid IN (SELECT 'LNA_' || l_returnflag FROM lineitem)""")
def generated_headers(spark, sf):
    return sources.generate_headers(D.wide(spark, sf))


@query("generated_edges", "SELECT (SELECT count(*) FROM part) AS nodes, CAST(2 AS BIGINT) AS least, CAST(6 AS BIGINT) AS most, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS repeated")
def generated_edges(spark, sf):
    """The shape of a generated graph of as many nodes as there are parts: degrees of 2 to 6, no loops, no repeated pairs."""
    g = to_edges(sources.generate(spark, D.table(spark, sf, "part").count()))
    by = g.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("d"), F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("loops"))
    return by.agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("loops").alias("loops"), F.sum(F.col("n") - F.col("d")).alias("repeated"))


def _texts(edges):
    """One text for each source node."""
    lines = edges.select(F.concat_ws(" ", "src", "dst").alias("line"), F.col("src").cast("string").alias("file"))
    return lines.groupBy("file").agg(F.concat(F.lit("# edges\nARETES\n"), F.array_join(F.collect_list("line"), "\n")).alias("text"))


@query("text_graph_edges", f"WITH {D.PARTS} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM g")
def text_graph_edges(spark, sf):
    return text.parse(_texts(D.pairs(spark, sf)))[1].select("src", "dst")


@query("text_graph_parallel", f"WITH {D.PAIRS} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, count(*) AS n FROM pairs GROUP BY 1, 2")
def text_graph_parallel(spark, sf):
    """The lenient reader keeps parallel edges."""
    return text.parse(_texts(D.pairs(spark, sf)), dedupe=False)[1].groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


_VISITS = "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step, event_type AS id, CASE WHEN event_id % 2 = 1 THEN 'predecesseur' END AS via FROM events"


@query("history_loaded", _VISITS)
def history_loaded(spark, sf):
    """The events of each user as a JSON text, loaded again: plain ids where nothing else is known."""
    e = D.event_visits(spark, sf)
    entry = F.when(F.col("via").isNull(), F.to_json(F.struct("id"))).otherwise(F.to_json(F.struct("id", "via")))
    texts = e.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", entry.alias("x")))), lambda s: s["x"]), ","), F.lit("]")).alias("text"))
    return history.load_all(texts, ["user_id"])


@query("history_of_all", "WITH v AS (SELECT event_id AS step, event_type AS id, event_id % 2 = 1 AS back, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) SELECT DISTINCT CASE WHEN back THEN id ELSE prev END AS src, CASE WHEN back THEN prev ELSE id END AS dst FROM v WHERE prev <> id")
def history_of_all(spark, sf):
    """One history of all events: the visit before comes over ranges of steps, not through one task."""
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("id"), F.when(F.col("event_id") % 2 == 1, "predecesseur").alias("via"))
    return history.graph(e)


@query("text_graph_split", f"WITH {D.PARTS} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM g")
def text_graph_split(spark, sf):
    """Section files, one for each task that has edges, read by their splits."""
    # The header of a column is that of the section.
    lines = D.pairs(spark, sf).select(F.spark_partition_id().alias("p"), F.concat_ws(" ", "src", "dst").alias("ARETES"))
    path = own_folder(spark, "texts")
    lines.write.partitionBy("p").option("header", True).csv(path)
    return text.read_split(spark, path)[1].select("src", "dst").distinct()


@query("components_sink", f"WITH RECURSIVE {D.ORDERS}, {LINKS} SELECT id AS NodeId, component AS ComponentId FROM comp")
def components_sink(spark, sf):
    """Weak components written, replaced and read back."""
    path = f"{Workspace(spark, 'sink').root}/components"
    found = condense.weak_components(D.orders(spark, sf))
    for _ in range(2):
        sinks.replace_components(found, path)
    return spark.read.parquet(path)


@query("condensation_sink", f"WITH RECURSIVE {D.ORDERS}, {NODES}, {REACH} SELECT DISTINCT a.scc AS FromScc, b.scc AS ToScc FROM g JOIN sc a ON a.id = src JOIN sc b ON b.id = dst WHERE a.scc <> b.scc")
def condensation_sink(spark, sf):
    root = Workspace(spark, "sink").root
    g = D.orders(spark, sf)
    scc = condense.strong_components(g)
    sinks.replace_condensation(scc, condense.condensed_edges(g, scc), f"{root}/nodes", f"{root}/edges")
    return spark.read.parquet(f"{root}/edges")


@query("stats_sink", f"WITH {D.WIDE} SELECT 1 AS Id, CAST((SELECT count(*) FROM (SELECT DISTINCT {KEY4} FROM wide)) AS INTEGER) AS DistinctDTACount, count(*) AS RowCountTotal FROM wide")
def stats_sink(spark, sf):
    path = f"{Workspace(spark, 'sink').root}/stats"
    sinks.upsert_stats(procs.stats(D.wide(spark, sf)), path)
    return sinks.read_stats(spark, path).drop("RefreshedAt")


@query("islands_scc", "SELECT s_suppkey || '/' || id AS id, s_suppkey || '/' || scc AS scc FROM supplier, (VALUES ('X1', 'X1'), ('X2', 'X1'), ('X3', 'X1'), ('X4', 'X4'), ('X5', 'X5'), ('Y1', 'Y1'), ('Y2', 'Y2'), ('Y3', 'Y3')) v(id, scc)")
def islands_scc(spark, sf):
    """Strong components of the islands, one copy of them for each supplier."""
    e = to_edges(sources.islands(spark))
    copy = lambda c: F.concat_ws("/", F.col("s_suppkey").cast("string"), c)
    return condense.strong_components(D.table(spark, sf, "supplier").crossJoin(F.broadcast(e)).select(copy("src").alias("src"), copy("dst").alias("dst")))


