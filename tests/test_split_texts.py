"""Section files of a query and their splits: no task's share grows with a file or a split."""

import os

import pytest

from test_ordered_reach import big_text
from weft.plans import queries as plans
from weft.sources import text


def test_each_task_writes_a_file(spark, sf, tmp_path, monkeypatch):
    """As many files as tasks: not four, however many rows there are."""
    path = str(tmp_path / "texts")
    monkeypatch.setattr(plans, "own_folder", lambda *_: path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = plans.text_graph_split(spark, sf)
        files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert len(files) == 9
        assert all(open(f).readline() == "ARETES\n" for f in files)
        assert got.count() == plans.D.parts(spark, sf).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("size", [0, 1, 4])
def test_pieces_of_a_split(spark, tmp_path, monkeypatch, size):
    """Sections and places go on across pieces of a split, with headers in some of them."""
    monkeypatch.setattr(text, "PIECE", size)
    whole = big_text(3, ["\n", "\x0b", "\r", "\x85"])
    (tmp_path / "g.txt").write_bytes(whole.encode())
    for a, b in zip(text.read_split(spark, str(tmp_path)), text.parse_text(spark, whole)):
        assert sorted(map(tuple, a.drop("file").collect())) == sorted(map(tuple, b.collect()))


def test_no_edges_no_text(spark, sf, tmp_path, monkeypatch):
    """Orders of one line have no edges: the graph is empty, as in SQL."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber = 1").dropDuplicates(["l_orderkey"])
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(plans, "own_folder", lambda *_: str(tmp_path / "texts"))
    assert plans.text_graph_split(spark, str(tmp_path)).collect() == []
