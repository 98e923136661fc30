"""Data model: schemas, direction of edges, node universe, the graph facade."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the direction under which an edge runs from ``Nodes`` to ``NodesLie``.
FORWARD = "predecesseur"

EDGE = T.StructType([
    T.StructField("Nodes", T.StringType(), False), T.StructField("Direction", T.StringType()),
    T.StructField("NodesLie", T.StringType(), False), T.StructField("Transformation", T.StringType()),
])
#: Columns of the wide lineage table.
WIDE_COLUMNS = ("LNA_UID", "LIN_UID", "DTA_1", "DTA_2", "DTA_3", "DTA_4", "EDG_DIR", "EDG_1", "EDG_2", "EDG_3", "EDG_4", "TXN_DTA", "PRX_TXN_DTA")
WIDE = T.StructType([T.StructField(c, T.StringType(), c not in ("LNA_UID", "LIN_UID", "EDG_DIR")) for c in WIDE_COLUMNS])
WIDE_KEY = ("LNA_UID", "LIN_UID", "EDG_DIR")
HEADER = T.StructType([
    T.StructField("LNA_UID", T.StringType(), False), T.StructField("RON_APP", T.StringType()), T.StructField("PCK_PGM_NME", T.StringType()),
    T.StructField("EXE_PGM_NME", T.StringType()), T.StructField("VRS_EXE_PGM", T.StringType()), T.StructField("APP_ENV", T.StringType()),
    T.StructField("DLY_PGM_TSP", T.TimestampNTZType()), T.StructField("LNA_TSP", T.TimestampNTZType()), T.StructField("PGM_TEC", T.StringType()),
    T.StructField("VRS_LNA_TOO", T.StringType()), T.StructField("TUS_IND", T.IntegerType()),
])
STATS = T.StructType([
    T.StructField("Id", T.IntegerType(), False), T.StructField("DistinctDTACount", T.IntegerType()), T.StructField("RowCountTotal", T.LongType()),
    T.StructField("RefreshedAt", T.TimestampType()),
])


def to_edges(raw: DataFrame) -> DataFrame:
    """(src, dst, transformation) of a narrow edge table; every direction but ``FORWARD`` runs backwards. Duplicates stay."""
    ahead = F.coalesce(F.col("Direction") == FORWARD, F.lit(False))
    return raw.select(
        F.when(ahead, F.col("Nodes")).otherwise(F.col("NodesLie")).alias("src"),
        F.when(ahead, F.col("NodesLie")).otherwise(F.col("Nodes")).alias("dst"),
        F.col("Transformation").alias("transformation"),
    )


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id): every value at either end of an edge, once."""
    return edges.select(F.explode(F.array(src, dst)).alias("id")).where(F.col("id").isNotNull()).distinct()


def duplicate_keys(wide: DataFrame, key: tuple[str, ...] = WIDE_KEY) -> DataFrame:
    """Keys of a wide table that more than one row has; empty if its primary key holds."""
    return wide.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def joined_label(parts: list[Column]) -> Column:
    """Non-empty trimmed parts joined by dots; an empty string if there is none."""
    return F.concat_ws(".", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def wide_to_edges(wide: DataFrame) -> DataFrame:
    """(src, dst, transformation) of a wide table: direction I runs from data to edge columns, O the other way, others give none."""
    data, edge = (joined_label([F.col(f"{c}_{i}") for i in (4, 3, 2, 1)]) for c in ("DTA", "EDG"))
    way = F.substring(F.upper(F.trim("EDG_DIR")), 1, 1)
    rows = wide.select(data.alias("d"), edge.alias("e"), way.alias("w"), F.col("TXN_DTA").alias("transformation")).where("d != '' and e != '' and w in ('I', 'O')")
    return rows.select(F.expr("if(w = 'I', d, e)").alias("src"), F.expr("if(w = 'I', e, d)").alias("dst"), "transformation")


@dataclass
class LineageGraph:
    """Edges (src, dst, transformation) and nodes, the latter derived unless given."""

    edges: DataFrame
    declared: DataFrame | None = None

    @classmethod
    def from_table(cls, raw: DataFrame) -> LineageGraph:
        return cls(to_edges(raw))

    @classmethod
    def from_wide(cls, wide: DataFrame) -> LineageGraph:
        return cls(wide_to_edges(wide))

    @cached_property
    def nodes(self) -> DataFrame:
        found = nodes_of(self.edges)
        return found if self.declared is None else found.union(self.declared.select("id")).distinct()

    def adjacency(self, forward: bool = True) -> DataFrame:
        """(id, neighbours): sorted arrays, parallel edges kept."""
        a, b = ("src", "dst") if forward else ("dst", "src")
        return self.edges.groupBy(F.col(a).alias("id")).agg(F.sort_array(F.collect_list(b)).alias("neighbours"))

    def approximate_bytes(self) -> DataFrame:
        """(bytes): what an integer adjacency of both directions with node names would take in memory."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(24 + 2 * F.length("id") + 56), F.lit(0)).alias("names"))
        m = self.edges.agg(F.count(F.lit(1)).alias("m"))
        return n.crossJoin(m).select((4 * (2 * (F.col("n") + 1) + 2 * F.col("m")) + F.col("names")).alias("bytes"))
