"""Graphs from spreadsheet-like rows: data and edge columns in four levels, a direction, a transformation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import joined_label


class TabularError(ValueError):
    """The rows are no graph."""


#: Header patterns.
DATA_HEADER = re.compile(r"^dta[ _-]?0*([1-4])$")
EDGE_HEADER = re.compile(r"^edg[ _-]?0*([1-4])$")


def header_map(names: Sequence[str]) -> dict[str, int]:
    """Column index of each role (dta_1..4, edg_1..4, dir, txn); data headers win over edge headers, then a direction, then a transformation; of equal roles the last."""
    found: dict[str, int] = {}
    for i, name in enumerate(names):
        low = str(name).strip().lower()
        if m := DATA_HEADER.match(low):
            found[f"dta_{m[1]}"] = i
        elif m := EDGE_HEADER.match(low):
            found[f"edg_{m[1]}"] = i
        elif "dir" in low:
            found["dir"] = i
        elif "txn" in low:
            found["txn"] = i
    if not any(k.startswith("dta") for k in found) or not any(k.startswith("edg") for k in found):
        raise TabularError("at least one data column and one edge column are needed")
    return found


def rows_to_graph(rows: DataFrame, order: str | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, pos) and edges (source, target, txn) of a table whose column names are headers.

    ``order`` names the column that numbers the rows; without it rows are ordered
    as Spark reads them. Kind is dta, edg or both. A row with one side gives a node
    only, as does a row without direction I or O; of equal edges the first row's
    transformation stands.
    """
    names = [c for c in rows.columns if c != order]
    at = header_map(names)
    col = lambda k: F.coalesce(F.col(f"`{names[at[k]]}`").cast("string"), F.lit("")) if k in at else F.lit("")
    label = lambda s: joined_label([col(f"{s}_{i}") for i in (4, 3, 2, 1)])
    way = F.substring(F.upper(F.trim(col("dir"))), 1, 1)
    pos = F.col(order) if order else F.monotonically_increasing_id()
    base = rows.select(pos.cast("bigint").alias("pos"), label("dta").alias("d"), label("edg").alias("e"), way.alias("w"), F.trim(col("txn")).alias("txn"))
    base = base.where("d != '' or e != ''")
    if check and base.isEmpty():
        raise TabularError("no row can be used")
    sides = base.select("pos", F.explode(F.array(F.struct(F.lit("dta").alias("kind"), F.col("d").alias("id")), F.struct(F.lit("edg").alias("kind"), F.col("e").alias("id")))).alias("x"))
    nodes = sides.select("pos", "x.*").where("id != ''").groupBy("id").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"), F.min("pos").alias("pos"))
    nodes = nodes.select("id", F.expr("if(lo = hi, lo, 'both')").alias("kind"), "pos")
    linked = base.where("d != '' and e != '' and w in ('I', 'O')").select("pos", F.expr("if(w = 'I', d, e)").alias("source"), F.expr("if(w = 'I', e, d)").alias("target"), "txn")
    edges = linked.groupBy("source", "target").agg(F.min_by("txn", "pos").alias("txn"))
    return nodes, edges


def sheet_to_graph(spark: SparkSession, sheet: Sequence[Sequence]) -> tuple[DataFrame, DataFrame]:
    """Graph of a sheet: its header row and the rows below; blank rows are skipped."""
    rows = [[("" if v is None else str(v)) for v in r] for r in sheet]
    rows = [r for r in rows if any(v.strip() for v in r)]
    if len(rows) < 2:
        raise TabularError("a header and one row are needed")
    width = len(rows[0])
    names = [f"c{i}" for i in range(width)]
    header_map(rows[0])
    data = [(n, *(r + [""] * width)[:width]) for n, r in enumerate(rows[1:])]
    df = spark.createDataFrame(data, "pos bigint, " + ", ".join(f"{n} string" for n in names))
    # Of equal headers the last one counts.
    last = {h.strip().lower(): n for n, h in zip(names, rows[0])}
    return rows_to_graph(df.select("pos", *(F.col(n).alias(h) for h, n in last.items() if h)), "pos")
