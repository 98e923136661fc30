from weft.functions.like import blank, like_regex
from weft.model import EDGE, LineageGraph, WIDE, duplicate_keys, to_edges, wide_to_edges
from weft.functions.labels import current_node


def test_directions_and_catch_all(spark):
    rows = [("A", "predecesseur", "B", None), ("A", "successeur", "B", "t"), ("A", None, "B", None), ("A", "PREDECESSEUR", "B", None)]
    got = [tuple(r) for r in to_edges(spark.createDataFrame(rows, EDGE)).collect()]
    assert got == [("A", "B", None), ("B", "A", "t"), ("B", "A", None), ("B", "A", None)]


def test_nodes_adjacency_and_bytes(spark):
    g = LineageGraph.from_table(spark.createDataFrame([("A", "predecesseur", "B", None), ("A", "predecesseur", "B", None)], EDGE))
    assert sorted(r[0] for r in g.nodes.collect()) == ["A", "B"]
    assert g.adjacency().first()["neighbours"] == ["B", "B"]
    assert g.approximate_bytes().first()[0] == 4 * (2 * 3 + 2 * 2) + 2 * (24 + 2 + 56)


def test_like_patterns():
    import re

    hit = lambda p, s: re.match(like_regex(p).replace("(?isu)", "(?is)"), s) is not None
    assert hit("%a_c%", "xxABCyy") and not hit("a_c", "abbc")
    assert hit("[a-c]%", "bz") and not hit("[^a-c]%", "bz") and hit("a.b", "a.b") and not hit("a.b", "axb")


def test_like_in_spark(spark):
    from weft.functions.like import contains_like, like
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Alpha",), ("beta[1]",), ("G_mma",), (None,)], "s string")
    assert [r[0] for r in df.where(contains_like(F.col("s"), "LPH")).collect()] == ["Alpha"]
    assert [r[0] for r in df.where(contains_like(F.col("s"), "[h-m]a")).collect()] == ["Alpha", "G_mma"]
    assert df.where(like(F.col("s"), "b%")).count() == 1 and df.where(like(F.col("s"), "%")).count() == 3


def test_blank():
    assert blank(None) and blank("") and blank("  ") and not blank(" x")


def test_current_node(spark):
    row = lambda *e: ("L", "1", None, None, None, None, "O", *e, None, None)
    df = spark.createDataFrame([row("n1", "n2", "n3", "n4"), row(None, "e2", "e3", None), row("e1", None, "e3", "e4"), row(None, None, None, None), row("e1", "e2", "e3", "")], WIDE)
    assert [r[0] for r in df.select(current_node()).collect()] == ["n4.n3.n2.n1", ".e2", "e4.e3", "", ".e2.e1"]


def test_wide_edges_skip_gaps_and_keys(spark):
    rows = [("L", "1", "a", None, "c", " d ", "I", "w", None, None, "z", "t", None), ("L", "2", "a", None, None, None, "O", None, None, None, None, None, None), ("L", "1", "a", "", "", "", "O", "w", None, None, None, None, None)]
    wide = spark.createDataFrame(rows, WIDE)
    assert [tuple(r) for r in wide_to_edges(wide).collect()] == [("d.c.a", "z.w", "t"), ("w", "a", None)]
    assert duplicate_keys(wide).count() == 0 and duplicate_keys(wide, ("LNA_UID", "LIN_UID")).count() == 1
