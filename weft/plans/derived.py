"""Lineage graphs derived from the order tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.model import HEADER, WIDE_COLUMNS, to_edges
from weft.operators import stored
from weft.operators.stored import StoredWide
from weft.session import exists, own_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow edge table: parts and suppliers, directions by line status."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("Nodes"), F.when(F.col("l_linestatus") == "O", "predecesseur").otherwise("successeur").alias("Direction"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("NodesLie"), F.col("l_returnflag").alias("Transformation"),
    )


FULL_RAW = "raw AS (SELECT 'P' || l_partkey AS Nodes, CASE WHEN l_linestatus = 'O' THEN 'predecesseur' ELSE 'successeur' END AS Direction, 'S' || l_suppkey AS NodesLie, l_returnflag AS Transformation FROM lineitem)"
FULL = FULL_RAW + ", g AS (SELECT CASE WHEN Direction = 'predecesseur' THEN Nodes ELSE NodesLie END AS src, CASE WHEN Direction = 'predecesseur' THEN NodesLie ELSE Nodes END AS dst, Transformation AS transformation FROM raw)"


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_edges(full_table(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that follow each other in an order, each time."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and dst != src")


PAIRS = (
    "pairs AS (SELECT a AS src, b AS dst FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS b"
    " FROM lineitem) WHERE b IS NOT NULL AND b <> a)"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph: (src, dst) of parts that follow each other in an order, once."""
    return pairs(spark, sf_dir).distinct()


PARTS = PAIRS + ", g AS (SELECT DISTINCT src, dst FROM pairs)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cust, k, a, b, p, q): the orders of each customer by date, the next one, and the priorities of both."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust"), F.row_number().over(w).alias("k"), F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"),
        F.col("o_orderpriority").alias("p"), F.lead("o_orderpriority").over(w).alias("q"),
    )


SEQUENCES = (
    "h AS (SELECT o_custkey AS cust, row_number() OVER w AS k, o_orderkey AS a, lead(o_orderkey) OVER w AS b, o_orderpriority AS p, lead(o_orderpriority) OVER w AS q"
    " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order graph: from each order to the customer's next, and back where both have one priority; a weak component for each customer, strong ones of any length."""
    h = sequences(spark, sf_dir).where("b is not null")
    return h.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(h.where("p = q").select(F.col("b").alias("src"), F.col("a").alias("dst")))


ORDERS = SEQUENCES + ", g AS (SELECT a AS src, b AS dst FROM h WHERE b IS NOT NULL UNION SELECT b, a FROM h WHERE b IS NOT NULL AND p = q)"


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, step, id, via): events of a user as visits, in order of time; odd events came through a predecessor."""
    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", step.alias("step"), F.col("event_type").alias("id"), F.when(F.col("event_id") % 2 == 1, "predecesseur").alias("via"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): event types that follow each other, loops included, once."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()


EVENT = "g AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


#: Suppliers that are broadcast at most, with their nations.
BROADCAST_ROWS = 1_000_000
#: Columns of ``lineitem`` that the wide table takes.
WIDE_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def wide(spark: SparkSession, sf_dir: str, piece: int = 0, pieces: int = 1) -> DataFrame:
    """The wide lineage table of order lines: coordinates from part and supplier, edge columns from the order's next line.

    Of several ``pieces``, which are the whole together, each holds whole orders.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    if pieces > 1:
        line = line.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(pieces)) == piece)
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    # By a shuffle the lines would carry the parts' texts once more.
    supplier = F.broadcast(supplier) if table(spark, sf_dir, "supplier").count() <= BROADCAST_ROWS else supplier
    same = Window.partitionBy("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").orderBy("l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    # Both windows hold the order's key, so rows dealt by it once serve both.
    rows = rows.select(*(c for c in line.columns if c in WIDE_LINE), "p_brand", "p_type", "p_name", "n_name").repartition("l_orderkey").withColumn("occ", F.row_number().over(same))
    rows = rows.withColumns({"d1": F.when(F.col("l_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("FIAD_"), F.col("p_brand"))), "d2": F.col("p_type"), "d3": F.col("p_name"), "d4": F.col("n_name")})
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    gap = lambda k, c: F.when(F.col("l_partkey") % k == 0, None).otherwise(F.lead(c).over(w))
    return rows.select(
        F.concat(F.lit("LNA_"), "l_returnflag").alias("LNA_UID"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "occ").alias("LIN_UID"),
        F.col("d1").alias("DTA_1"), F.col("d2").alias("DTA_2"), F.col("d3").alias("DTA_3"), F.col("d4").alias("DTA_4"),
        F.when(F.col("l_linestatus") == "O", "O").otherwise("I").alias("EDG_DIR"),
        F.lead("d1").over(w).alias("EDG_1"), gap(2, "d2").alias("EDG_2"), gap(3, "d3").alias("EDG_3"), gap(4, "d4").alias("EDG_4"),
        F.lit(None).cast("string").alias("TXN_DTA"), F.lit(None).cast("string").alias("PRX_TXN_DTA"),
    ).select(*WIDE_COLUMNS)


def wide_pieces(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The wide table in as many pieces as it has ``SLICE_ROWS`` lines."""
    n = max(1, -(-table(spark, sf_dir, "lineitem").count() // stored.SLICE_ROWS))
    return [wide(spark, sf_dir, i, n) for i in range(n)]


def stored_wide(spark: SparkSession, sf_dir: str) -> StoredWide:
    """The wide table as a store, written once for each application and input."""
    held = spark.sparkContext.__dict__.setdefault("_weft_stores", {})
    store = held.get(sf_dir)
    if not store or not exists(spark, f"{store.root}/totals/_SUCCESS"):
        store = held[sf_dir] = StoredWide.write(wide_pieces(spark, sf_dir), own_folder(spark, "wide-store"))
    return store


WIDE = """w0 AS (
  SELECT l.*, p_brand, p_type, p_name, n_name,
         row_number() OVER (PARTITION BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus
                            ORDER BY l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS occ
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
w1 AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN p_brand ELSE 'FIAD_' || p_brand END AS d1, p_type AS d2, p_name AS d3, n_name AS d4 FROM w0),
wide AS (SELECT 'LNA_' || l_returnflag AS LNA_UID,
       l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || occ AS LIN_UID,
       d1 AS DTA_1, d2 AS DTA_2, d3 AS DTA_3, d4 AS DTA_4,
       CASE l_linestatus WHEN 'O' THEN 'O' ELSE 'I' END AS EDG_DIR,
       lead(d1) OVER w AS EDG_1,
       CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE lead(d2) OVER w END AS EDG_2,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE lead(d3) OVER w END AS EDG_3,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE lead(d4) OVER w END AS EDG_4,
       CAST(NULL AS VARCHAR) AS TXN_DTA, CAST(NULL AS VARCHAR) AS PRX_TXN_DTA
FROM w1
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax))"""

#: Headers of two of the three LNA_UIDs; one has gaps.
HEADERS = (("LNA_A", "APP_A", "PCK_A", "PGM_A", "v1", "PROD", "2024-01-02 03:04:05", None, "SQL", "1.0", 1), ("LNA_N", None, "PCK_N", None, "v2", None, None, "2024-06-01 00:00:00", None, "1.1", None))


def headers(spark: SparkSession) -> DataFrame:
    from datetime import datetime

    at = lambda x: datetime.fromisoformat(x) if x else None
    return spark.createDataFrame([(*r[:6], at(r[6]), at(r[7]), *r[8:]) for r in HEADERS], HEADER)


def _literal(v, kind: T.DataType) -> str:
    text = "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    name = {"timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}.get(kind.simpleString(), "VARCHAR")
    return f"CAST({text} AS {name})"


HEA = "hea AS (" + " UNION ALL ".join("SELECT " + ", ".join(f"{_literal(v, f.dataType)} AS {f.name}" for v, f in zip(r, HEADER)) for r in HEADERS) + ")"


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the part graph that lead to larger ids."""
    return parts(spark, sf_dir).where("src < dst")


DAG = PAIRS + ", g AS (SELECT DISTINCT src, dst FROM pairs WHERE src < dst)"


def order_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each order to the customer's next: chains."""
    return sequences(spark, sf_dir).where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))


ORDER_DAG = SEQUENCES + ", g AS (SELECT a AS src, b AS dst FROM h WHERE b IS NOT NULL)"


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges from regions to nations, and the nodes of both."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"))
    return edges, n.select(name("N", "n_nationkey").alias("id")).union(r.select(name("R", "r_regionkey")))
