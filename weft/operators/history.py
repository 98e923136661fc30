"""Navigation history: loading, recording, and the graph of its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import ordered

#: Fixed value: visits that a history keeps.
CAP = 200


def load(spark: SparkSession, text: str | None) -> DataFrame:
    """(step, id, via) of a JSON list of ids or of objects {id, via}; anything else gives an empty history."""
    raw = spark.createDataFrame([(text,)], "text string").select(F.from_json("text", "array<string>").alias("items"))
    return _entries(raw.select(F.posexplode(F.coalesce("items", F.array().cast("array<string>"))).alias("step", "item")), [])


def load_all(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by`` and (step, id, via) of many histories, one JSON text in each row, read as ``load`` reads one."""
    items = texts.select(*by, F.posexplode(F.from_json(text, "array<string>")).alias("step", "item"))
    return _entries(items, by)


def _entries(items: DataFrame, by: list[str]) -> DataFrame:
    inner = F.from_json("item", "struct<id: string, via: string>")
    entry = F.when(F.startswith("item", F.lit("{")), inner).otherwise(F.struct(F.col("item").alias("id"), F.lit(None).cast("string").alias("via")))
    return items.select(*by, "step", entry.alias("e")).select(*by, "step", F.col("e.id").alias("id"), F.col("e.via").alias("via")).where("id is not null")


def _before(visits: DataFrame, by: list[str], name: str) -> DataFrame:
    """Visits with the id of the one before: in its own task for each history, or over ranges of steps if there is but one."""
    if not by:
        return ordered.previous(visits, [F.col("step")], "id", name)
    return visits.withColumn(name, F.lag("id").over(Window.partitionBy(*by).orderBy("step")))


def recorded(visits: DataFrame, cap: int = CAP, by: list[str] | None = None) -> DataFrame:
    """Visits (step, id, via) without those that repeat the one before, the last ``cap`` of them; one history for each ``by``."""
    by = by or []
    kept = _before(visits, by, "_p").where(F.col("_p").isNull() | (F.col("_p") != F.col("id"))).drop("_p")
    if not by:
        return kept.orderBy(F.desc("step")).limit(cap)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("step")))).where(F.col("_r") <= cap).drop("_r")


def graph(visits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(src, dst), and ``by``: edges between consecutive visits of different nodes, once; a visit via a predecessor is the source."""
    by = by or []
    pairs = _before(visits, by, "prev").where("prev is not null and prev != id")
    back = F.coalesce(F.col("via") == "predecesseur", F.lit(False))
    return pairs.select(*by, F.when(back, F.col("id")).otherwise(F.col("prev")).alias("src"), F.when(back, F.col("prev")).otherwise(F.col("id")).alias("dst")).distinct()
