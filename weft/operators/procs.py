"""Parameterised queries over the wide lineage table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.labels import PREFIXES, current_node, prefix_keys
from weft.functions.like import blank, contains_like, like
from weft.model import HEADER

DATA = ("DTA_1", "DTA_2", "DTA_3", "DTA_4")
#: Fixed value: the pattern on DTA_1 where no parameter is given.
DEFAULT_PATTERN = "f%"


def with_keys(wide: DataFrame) -> DataFrame:
    """The wide table with its prefix keys, derived anew."""
    return wide.withColumns(prefix_keys())


def changed_keys(keyed: DataFrame) -> DataFrame:
    """Rows whose stored prefix keys differ from what they should be, nulls compared as values."""
    same = [F.col(k).eqNullSafe(F.substring(c, 1, n)) for k, c, n in PREFIXES]
    return keyed.where(~(same[0] & same[1] & same[2] & same[3]))


def backfill_keys(keyed: DataFrame) -> DataFrame:
    """The table with every prefix key set right; idempotent."""
    return with_keys(keyed)


def stats(wide: DataFrame) -> DataFrame:
    """(Id, DistinctDTACount, RowCountTotal, RefreshedAt): tuples with nulls count."""
    distinct = wide.select(*DATA).distinct().agg(F.count(F.lit(1)).cast("int").alias("DistinctDTACount"))
    total = wide.agg(F.count(F.lit(1)).alias("RowCountTotal"))
    return distinct.crossJoin(total).select(F.lit(1).alias("Id"), "DistinctDTACount", "RowCountTotal", F.current_timestamp().alias("RefreshedAt"))


def nodes_list(wide: DataFrame, column: str | None = None, table: str | None = None, schema: str | None = None, env: str | None = None, max_rows: int = 100, cached: DataFrame | None = None, prefix: bool = False) -> DataFrame:
    """One row for each coordinate DTA_1..4, by coordinate, with the total of all coordinates that match.

    Blank parameters count as not given. Without any, rows are those of DTA_1 like
    ``f%``, and the total is that of the whole table: from ``cached`` statistics if
    given, else counted. Otherwise each parameter must be contained, ignoring case,
    wildcards allowed. Of the rows of a coordinate the first by LIN_UID, LNA_UID,
    EDG_DIR stands. ``prefix`` compares coordinates by their prefix keys.
    """
    given = [contains_like(F.col(c), v) for c, v in zip(DATA, (column, table, schema, env)) if not blank(v)]
    key = [F.substring(c, 1, n) for _, c, n in PREFIXES] if prefix else [F.col(c) for c in DATA]
    rows = wide
    if given:
        for g in given:
            rows = rows.where(g)
        total = rows.select(*DATA).distinct().agg(F.count(F.lit(1)).alias("TotalLignes"))
    else:
        total = wide.select(*DATA).distinct().agg(F.count(F.lit(1)).alias("TotalLignes")) if cached is None else cached.select(F.col("DistinctDTACount").cast("bigint").alias("TotalLignes"))
        rows = rows.where(like(F.col("DTA_1"), DEFAULT_PATTERN))
    w = Window.partitionBy(*key).orderBy("LIN_UID", "LNA_UID", "EDG_DIR")
    first = rows.select("LNA_UID", "LIN_UID", "EDG_DIR", *DATA).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    page = first.orderBy(*(F.asc_nulls_first(k) for k in key), *(F.asc_nulls_first(c) for c in DATA)).limit(max_rows)
    return page.crossJoin(F.broadcast(total))


def successors_predecessors(wide: DataFrame, headers: DataFrame, lna_uid: str, lin_uid: str, edg_dir: str, type: str | None, use_edg: bool = False, max_rows: int = 100) -> DataFrame:
    """Edges of direction ``type`` at the coordinates of the start row, with their headers, and the total of them.

    The start row is found by its key; its DTA (or, with ``use_edg``, EDG) columns
    are the coordinates. A null coordinate matches anything, so an unknown start
    row matches every edge of the direction. Edges without header are left out of
    rows and total. The page is cut before the header's columns are joined.
    """
    start = wide.where((F.col("LNA_UID") == lna_uid) & (F.col("LIN_UID") == lin_uid) & (F.col("EDG_DIR") == edg_dir)).select(*(f"{'EDG' if use_edg else 'DTA'}_{i}" for i in (1, 2, 3, 4))).first()
    rows = wide.where(F.col("EDG_DIR") == F.lit(type).cast("string"))
    for c, v in zip(DATA, start or ()):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    known = rows.join(headers.select("LNA_UID").distinct(), "LNA_UID", "left_semi")
    total = known.agg(F.count(F.lit(1)).alias("TotalLignes"))
    order = (*DATA, "LNA_UID", "LIN_UID", "EDG_DIR")
    page = known.orderBy(*(F.asc_nulls_first(c) for c in order)).limit(max_rows)
    return headed_page(page, headers, total, wide.columns[:13], order)


def headed_page(page: DataFrame, headers: DataFrame, total: DataFrame, columns, order) -> DataFrame:
    """The rows of a page with their headers' columns, the current node and the one-row ``total``."""
    full = page.join(headers, "LNA_UID").withColumns({c: _default(c) for c in HEADER.names[1:]}).withColumn("CURRENT_NODE", current_node())
    return full.crossJoin(F.broadcast(total)).select(*columns, *HEADER.names[1:], "CURRENT_NODE", "TotalLignes").orderBy(*(F.asc_nulls_first(c) for c in order))


def _default(name: str) -> Column:
    """A header column with the default that stands for null: empty text, 0, or the first of 1900."""
    kind = HEADER[name].dataType.simpleString()
    text = {"timestamp_ntz": "1900-01-01 00:00:00", "int": "0"}.get(kind, "")
    return F.coalesce(F.col(name).cast(kind), F.lit(text).cast(kind))
