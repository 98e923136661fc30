import io
import zipfile

import pytest

from weft.operators import condense, lookup
from weft.sources import catalog, edges, sinks, tabular, text, xlsx

MINIMAL = "NOEUDS\nA\nB\nC\n\nARETES\nA B\nB C\nA C\n"
SMALL = "NOEUDS\nA\nB\nC\nD\nE\n\nARETES\nA B\nB C\nC A\nC D\nD E\nE A\n"


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_text_minimal(spark):
    nodes, found = text.parse_text(spark, MINIMAL)
    assert sorted(r["id"] for r in nodes.collect()) == ["A", "B", "C"]
    assert pairs(found) == [("A", "B"), ("A", "C"), ("B", "C")]


def test_text_sections_repeat_comments_and_loops(spark):
    t = "# c\n  Edges \nA B extra words\nA B\n\nnœuds\nnode with spaces\n# x\nARÊTES\r\nB B\r\n"
    nodes, found = text.parse_text(spark, t)
    assert sorted(r["id"] for r in nodes.collect()) == ["A", "B", "node with spaces"]
    assert pairs(found) == [("A", "B"), ("B", "B")]
    assert pairs(text.parse_text(spark, t, dedupe=False)[1]) == [("A", "B"), ("A", "B"), ("B", "B")]


@pytest.mark.parametrize("bad", ["", "NOEUDS\n\nARETES\n", "A\nNOEUDS\nB\n", "ARETES\nA\n"])
def test_text_errors(spark, bad):
    with pytest.raises(text.GraphTextError):
        text.parse_text(spark, bad)


def test_text_file(spark, tmp_path):
    (tmp_path / "g.txt").write_text(SMALL, encoding="utf-8")
    nodes, found = text.read(spark, str(tmp_path))
    assert nodes.count() == 5 and found.count() == 6


HEAD = ["dta_1", "dta_2", "dta_3", "dta_4", "edg_dir", "edg_1", "edg_2", "edg_3", "edg_4", "txn_dta"]


def test_sheet_rules(spark):
    sheet = [HEAD, ["a", "", "", "b", " in", "x", "", "", "", "first"], ["a", "", "", "b", "Input", "x", "", "", "", "second"], ["x", "", "", "", "o", "a", "", "", "b", "t"], ["solo"], [], ["q", "", "", "", "?", "r"]]
    nodes, found = tabular.sheet_to_graph(spark, sheet)
    assert {r["id"]: r["kind"] for r in nodes.collect()} == {"b.a": "both", "x": "both", "solo": "dta", "q": "dta", "r": "edg"}
    assert sorted(tuple(r) for r in found.collect()) == [("b.a", "x", "first")]


def test_sheet_errors(spark):
    for bad in ([HEAD], [["x"], ["y"]], [HEAD, [""] * 10], [["dta_1"], ["a"]]):
        with pytest.raises(tabular.TabularError):
            tabular.sheet_to_graph(spark, bad)
    assert tabular.header_map(["DTA-01", "Edg 4", "Direction", "txn", "dta_1"]) == {"dta_1": 4, "edg_4": 1, "dir": 2, "txn": 3}


def workbook(rows) -> bytes:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([HEAD[:1] + HEAD[4:6], ["a", "I", "x"], ["", "", ""], ["b", "O", "x"]]))
    spark.dataSource.register(xlsx.XlsxDataSource)
    rows = [list(r["cells"]) for r in spark.read.format("weft_xlsx").load(str(tmp_path / "a.xlsx")).orderBy("row_no").collect()]
    assert len(rows) == 3
    assert sorted(tuple(r)[:2] for r in tabular.sheet_to_graph(spark, rows)[1].collect()) == [("a", "x"), ("x", "b")]
    assert xlsx.read(spark, str(tmp_path)).count() == 3


def test_generator(spark):
    g = edges.generate(spark, 500)
    rows = [tuple(r) for r in g.collect()]
    assert rows == [tuple(r) for r in edges.generate(spark, 500).collect()]
    per = {}
    for a, d, b, t in rows:
        assert a != b and d == "predecesseur" and t in edges.LABELS
        per.setdefault(a, []).append(b)
    assert len(per) == 500 and all(2 <= len(v) <= 6 and len(set(v)) == len(v) for v in per.values())
    assert edges.generate(spark, 0).select("Nodes").distinct().count() == 2


def test_source_modes(spark, tmp_path):
    assert edges.GraphSource(spark, mode="memoire").mode == "generated"
    assert edges.GraphSource(spark, mode="nonsense", table=lambda: edges.read_parquet(spark, str(tmp_path / "none"))).mode == "generated"
    sinks.replace_table(edges.islands(spark), str(tmp_path / "e"))
    source = edges.GraphSource(spark, lambda: edges.read_parquet(spark, str(tmp_path / "e")))
    assert source.mode == "sql" and source.load().count() == 7 and source.describe() == "edge table"


def test_wide_generator(spark):
    wide = edges.generate_wide(spark, 1, 100)
    assert wide.count() == 100 and wide.where("EDG_2 is null").count() == 50 and wide.where("TXN_DTA is null").count() == 20
    assert edges.generate_headers(wide).count() == 5


def test_catalogue(spark):
    s = catalog.samples(spark).collect()
    assert [r["slug"] for r in s] == ["connexe", "non-connexe", "complet", "compact", "creux", "non-pondere", "pondere", "oriente-dag", "cyclique", "arbre"]
    assert catalog.by_slug(spark, "pondere").first()["weighted"] and catalog.by_slug(spark, "none").count() == 0
    assert catalog.complete_pairs(spark.createDataFrame([(x,) for x in "ABCDE"], "n string")).count() == 10
    g = catalog.sample_edges(spark)
    assert condense.has_cycle(g.where("slug = 'cyclique'")) and not condense.has_cycle(g.where("slug = 'oriente-dag'"))
    assert condense.component_summary(condense.weak_components(g.where("slug = 'non-connexe'"))).first()["components"] == 3


def test_stats_sink(spark, tmp_path):
    from weft.operators import procs

    path = str(tmp_path / "stats")
    assert sinks.read_stats(spark, path) is None
    for n in (10, 20):
        sinks.upsert_stats(procs.stats(edges.generate_wide(spark, 1, n)), path)
        assert sinks.read_stats(spark, path).first()["RowCountTotal"] == n
    assert sinks.read_stats(spark, path).count() == 1


def test_empty_graph_statistics(spark):
    e = spark.createDataFrame([], "src string, dst string, transformation string")
    assert tuple(lookup.global_stats(e).first()) == (0, 0, 0.0, 0.0)
    row = lookup.compute_stats(e).first()
    assert row["nodes"] == row["edges"] == row["components"] == 0 and not row["has_cycle"]
    assert lookup.looks_layerable(e).first()[0] and condense.component_summary(condense.weak_components(e)).first()["largest"] == 0


#: Data item, direction and edge item of an example sheet; A stands for A1..A4.
EXAMPLE = "DA O EA/DB I EA/DC I EA/DA I EB/DD O EB/DE O EB/DD I EC/DF O EC/DE I ED/DG O ED/DF I EE/DH O EE/DG I EF/DH I EF/DC O EF/DB O EC/DA I EE/DH O EA/DF I EB/DG I EA"


def test_example_sheet(spark):
    rows = [r.split() for r in EXAMPLE.split("/")]
    sheet = [HEAD, *([*(f"{d}{i}" for i in range(1, 5)), w, *(f"{e}{i}" for i in range(1, 5)), "t"] for d, w, e in rows)]
    nodes, found = tabular.sheet_to_graph(spark, sheet)
    edges = found.withColumnsRenamed({"source": "src", "target": "dst"})
    row = lookup.compute_stats(edges, nodes).first()
    assert (row["nodes"], row["edges"], row["max_node"], row["max_degree"], row["avg_out"], row["density"], row["components"], row["has_cycle"]) == (14, 20, "EA4.EA3.EA2.EA1", 5, 1.43, 0.11, 1, True)
    assert condense.component_summary(condense.strong_components(edges), "scc").first()["largest"] == 14


def test_command_line(spark, tmp_path):
    from weft import cli

    (tmp_path / "g.txt").write_text(MINIMAL, encoding="utf-8")
    for name in ("a.svg", "a.html"):
        assert cli.draw(spark, str(tmp_path / "g.txt"), str(tmp_path / name))["edges"] == 3
    assert "<svg" in (tmp_path / "a.svg").read_text() and "3 nodes, 3 edges" in (tmp_path / "a.html").read_text()


def test_jdbc_in_parallel(spark):
    """An edge table of an embedded database, read by ranges of its key."""
    url, options = "jdbc:derby:memory:weft;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"a{i}", "predecesseur" if i % 2 else "successeur", f"b{i % 7}", None if i % 3 else "T") for i in range(60)]
    table = spark.createDataFrame(rows, "n int, Nodes string, Direction string, NodesLie string, Transformation string")
    table.write.format("jdbc").options(url=url, dbtable="EDGES", **options).mode("overwrite").save()
    found = edges.read_jdbc(spark, url, "EDGES", partitionColumn="n", lowerBound="0", upperBound="60", numPartitions="4", **options)
    assert found.rdd.getNumPartitions() == 4 and sorted(map(str, found.collect())) == sorted(map(str, table.drop("n").collect()))
    assert edges.can_connect(lambda: edges.read_jdbc(spark, url, "EDGES", **options)) and not edges.can_connect(lambda: edges.read_jdbc(spark, url, "NONE", **options))
