import pytest

from weft.model import EDGE, HEADER, WIDE
from weft.operators import layout, procs, render
from weft.service import Cache, LineageService, NotFound
from weft.sources import edges as sources


def wide(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (13 - len(r))) for r in rows], WIDE)


@pytest.fixture(scope="module")
def listed(spark):
    a, b, c = ("FIADODSWRK", "ZJ", "S1", "ENV1"), ("fld", "ZJ", "S2", "ENV1"), ("COL", "ZJ", "S3", "ENV2")
    return wide(spark, [("LNA_B", "L002", *a, "O"), ("LNA_A", "L001", *a, "O"), ("LNA_A", "L001", *a, "I"), ("LNA_A", "L003", *b, "O"), ("LNA_A", "L004", *c, "O")])


@pytest.mark.parametrize("prefix", [False, True])
def test_nodes_list(spark, listed, prefix):
    run = lambda **k: procs.nodes_list(listed, prefix=prefix, **k).collect()
    rows = run()
    assert [(r["LIN_UID"], r["LNA_UID"], r["EDG_DIR"], r["TotalLignes"]) for r in rows] == [("L001", "LNA_A", "I", 3), ("L003", "LNA_A", "O", 3)]
    assert [r["LIN_UID"] for r in run(column="fiadodswrk")] == ["L001"]
    assert [(r["LIN_UID"], r["TotalLignes"]) for r in run(env="ENV1", max_rows=1)] == [("L001", 2)]
    assert [r["TotalLignes"] for r in run(table="ZJ", max_rows=2)] == [3, 3]
    assert len(run(column=" ", table="")) == 2 and run(column="none") == []
    stale = procs.stats(listed).selectExpr("Id", "99 as DistinctDTACount", "RowCountTotal", "RefreshedAt")
    assert run(cached=stale)[0]["TotalLignes"] == 99


@pytest.fixture(scope="module")
def succ(spark):
    n, c1, c2 = ("n1", "n2", "n3", "n4"), ("c1", "m", "m", "m"), ("c2", "m", "m", "m")
    rows = [
        ("LNA_A", "L1", *n, "O", *n), ("LNA_A", "L2", *n, "O"), ("LNA_B", "L3", *n, "I"), ("LNA_B", "L4", *c2, "O"), ("LNA_C", "L5", *n, "O"), ("LNA_A", "L6", *c1, "O"),
    ]
    heads = spark.createDataFrame([("LNA_A", "A1", None, None, None, "PROD", None, None, None, None, 1), ("LNA_B", *[None] * 10)], HEADER)
    return wide(spark, rows), heads


def test_successors_predecessors(spark, succ):
    run = lambda kind, uid="L1", **k: procs.successors_predecessors(*succ, "LNA_A", uid, "O", kind, **k).collect()
    rows = run("O")
    assert [(r["LIN_UID"], r["CURRENT_NODE"], r["TotalLignes"]) for r in rows] == [("L1", "n4.n3.n2.n1", 2), ("L2", "", 2)]
    assert (rows[0]["RON_APP"], rows[0]["APP_ENV"], rows[0]["TUS_IND"], str(rows[0]["LNA_TSP"]), rows[0]["PGM_TEC"]) == ("A1", "PROD", 1, "1900-01-01 00:00:00", "")
    assert len(rows[0]) == 25
    assert [(r["LIN_UID"], r["TUS_IND"], r["TotalLignes"]) for r in run("I")] == [("L3", 0, 1)]
    assert [(r["LIN_UID"], r["TotalLignes"]) for r in run("O", max_rows=1)] == [("L1", 2)]
    assert [r["DTA_1"] for r in run("O", "unknown")] == ["c1", "c2", "n1", "n1"]
    assert [r["LIN_UID"] for r in run("O", use_edg=True)] == ["L1", "L2"]
    assert run(None) == []


def test_stats_and_keys(spark, listed):
    row = procs.stats(wide(spark, [("L", "1", None, "a", None, None, "O"), ("L", "2", None, "a", None, None, "O")])).first()
    assert (row["Id"], row["DistinctDTACount"], row["RowCountTotal"]) == (1, 1, 2)
    keyed = procs.with_keys(listed)
    assert procs.changed_keys(keyed).count() == 0
    broken = keyed.selectExpr("*", "if(LIN_UID = 'L004', null, DTA_2_k) as k").drop("DTA_2_k").withColumnRenamed("k", "DTA_2_k")
    assert procs.changed_keys(broken).count() == 1 and procs.changed_keys(procs.backfill_keys(broken)).count() == 0


def test_cache():
    now = [0.0]
    cache = Cache(ttl=10, size=2, clock=lambda: now[0])
    assert cache.get("a", lambda: 1) == (1, False) and cache.get("a", lambda: 2) == (1, True)
    now[0] = 11
    assert cache.get("a", lambda: 3) == (3, False)
    cache.get("b", lambda: 4)
    cache.get("c", lambda: 5)
    assert "a" not in cache.held


def test_service(spark):
    s = LineageService(sources.islands(spark))
    assert s.health() == {"status": "ok", "source": True} and s.stats() == {"nodes": 8, "edges": 7, "density": 0.125, "average_degree": 1.75}
    assert s.search("x1") == ["X1"] and s.nodes(2, 3)["total"] == 8 and [n["id"] for n in s.nodes(2, 3)["nodes"]] == ["X4", "X5", "Y1"]
    assert s.node("X3")["successors"] == [{"id": "X1", "transformation": "T3"}, {"id": "X4", "transformation": "T4"}]
    for bad in (lambda: s.node("N"), lambda: s.neighborhood("N")):
        with pytest.raises(NotFound):
            bad()
    assert s.neighborhood("Y2")["nodes"] == ["Y1", "Y2", "Y3"]
    assert s.find_path(None, " ") is None and s.find_path("X1", "").error
    for algo in ("bfs", "dijkstra", "dijkstra-bi", "astar", "other"):
        assert s.find_path(" X1", "X5 ", algo).path == ["X1", "X2", "X3", "X4", "X5"]
    assert s.find_path("X1", "X5").from_cache
    assert s.scan() == {"components": 2, "largest": 5}
    assert s.find_path("X1", "Y1").skipped_by_scan
    assert s.scan_strong() == {"components": 6, "largest": 3, "edges": 4}
    assert s.find_path("X5", "X1").skipped_by_scc
    assert not s.find_path("X1", "X5", max_depth=3).found and s.prepare_landmarks(2) >= 1
    assert [r["transformation"] for r in s.describe(["X1", "X2", "X3"])] == ["T1", "T2"]


def test_render(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B<", 3)], "src string, dst string, weight int")
    nodes = spark.createDataFrame([("A",), ("B<",)], "id string")
    at = layout.circular_positions(edges, nodes)
    text = render.svg(at, edges)
    assert text == render.svg(at, edges) and "B&lt;" in text and "marker-end" in text and ">3<" in text and "marker-end" not in render.svg(at, edges, directed=False)
    page = render.page("T", at, edges)
    assert "2 nodes, 1 edges" in page and '"source": "A"' in page
    assert [open(p).read() for p in render.save_catalogue({"a": text}, str(tmp_path / "svg"))] == [text]
    assert render.number(1.0) == "1" and render.number(-0.001) == "0" and render.number(2.345) in ("2.35", "2.34")
    assert render.sizes(1)["node"] == 1200 and render.sizes(10_000)["font"] == 5


def test_streaming_ingest(spark, tmp_path):
    from weft.streaming.ingest import edge_counts, ingest

    sources.islands(spark).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(EDGE).parquet(str(tmp_path / "in"))
        query = ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(120)
    assert tuple(edge_counts(spark.read.parquet(str(tmp_path / "out"))).first()) == (7, 7)
