"""Sinks: tables that are replaced as a whole, and the single row of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.model import STATS


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of what ``path`` holds; ``df`` must not read ``path``."""
    df.write.mode("overwrite").parquet(path)


def replace_components(components: DataFrame, path: str) -> None:
    """(NodeId, ComponentId), ids whole, not clipped."""
    replace_table(components.selectExpr("id as NodeId", "component as ComponentId"), path)


def replace_condensation(scc: DataFrame, edges: DataFrame, node_path: str, edge_path: str) -> None:
    """(NodeId, SccId) and (FromScc, ToScc)."""
    replace_table(scc.selectExpr("id as NodeId", "scc as SccId"), node_path)
    replace_table(edges.selectExpr("from_scc as FromScc", "to_scc as ToScc"), edge_path)


def upsert_stats(stats: DataFrame, path: str) -> None:
    """The one row with Id 1 is replaced, or written if there was none."""
    stats.select(*STATS.names).coalesce(1).write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """The row of statistics, or None if nothing was written yet."""
    try:
        found = spark.read.schema(STATS).parquet(path)
        return None if found.isEmpty() else found
    except Exception:
        return None
