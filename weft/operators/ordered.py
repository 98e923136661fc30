"""Numbers and neighbours of rows in a total order, without gathering the rows in one task.

Rows are range-partitioned and sorted; a row's number is its place in its partition
plus the rows of the partitions before, and the row before the first of a partition is
the last of the nearest partition before that has rows.  Only one row for each
partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.session import Workspace

#: Rows of a partition, about.
ROWS = 1_000_000
PART, PLACE = "_part", "_place"


def parted(df: DataFrame, order: list[Column], rows: int = ROWS, space: Workspace | None = None) -> DataFrame:
    """``df`` written in order, with the partition and the place in it of each row."""
    space = space or Workspace(df.sparkSession, "ordered")
    df = space.stored(df)
    n = max(1, -(-df.count() // rows))
    # After sorting, this id is the partition in its high bits and the place in the low 33.
    numbered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    return space.write(numbered.withColumns({PART: F.shiftright(PLACE, 33).cast("int"), PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))}), "parted")


def numbered(df: DataFrame, order: list[Column], name: str = "number", rows: int = ROWS) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 0; of rows that tie, either comes first."""
    held = parted(df, order, rows)
    sizes = held.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(PART, (F.sum("_n").over(Window.orderBy(PART)) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), PART).withColumn(name, F.col("_before") + F.col(PLACE)).drop(PART, PLACE, "_before")


def previous(df: DataFrame, order: list[Column], column: str, name: str = "prev", rows: int = ROWS) -> DataFrame:
    """``df`` with the ``column`` of the row before in ``order``, null for the first."""
    held = parted(df, order, rows)
    last = held.groupBy(PART).agg(F.max_by(F.struct(F.col(column).alias("v")), PLACE).alias("_last"))
    carried = last.select(PART, F.lag("_last").over(Window.orderBy(PART)).alias("_carried"))
    own = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(PART).orderBy(PLACE))
    return held.withColumn("_own", own).join(F.broadcast(carried), PART).withColumn(name, F.coalesce("_own", "_carried")["v"]).drop(PART, PLACE, "_own", "_carried")
