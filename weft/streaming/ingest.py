"""Streaming ingest of edge rows: each micro-batch is normalised and appended, and counts follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weft.model import to_edges


def ingest(stream: DataFrame, edge_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append (src, dst, transformation, batch) of a stream of narrow edge rows below ``edge_path``.

    A batch goes to a folder of its own that a retry overwrites, so each row is
    stored once though executors or the driver are lost in between.
    """

    def write(batch: DataFrame, number: int) -> None:
        to_edges(batch).write.mode("overwrite").parquet(f"{edge_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def edge_counts(edges: DataFrame) -> DataFrame:
    """(edges, distinct_edges) of what was ingested."""
    return edges.select("src", "dst").agg(F.count(F.lit(1)).alias("edges")).crossJoin(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("distinct_edges")))
