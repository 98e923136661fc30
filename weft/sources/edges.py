"""Edge tables: Parquet or JDBC connectors, deterministic generators, automatic choice of a source."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.model import EDGE, FORWARD, to_edges


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Edge table of a database; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*EDGE.names)


def raw_pairs(raw: DataFrame) -> DataFrame:
    """(Nodes, NodesLie) as stored, directions ignored."""
    return raw.select("Nodes", "NodesLie")


def directed_pairs(raw: DataFrame) -> DataFrame:
    """(src, dst) with directions applied; duplicates stay."""
    return to_edges(raw).select("src", "dst")


#: Fixed value: seconds that a source has to answer.
PROBE_SECONDS = 3.0


def can_connect(load: Callable[[], DataFrame], seconds: float = PROBE_SECONDS) -> bool:
    """Whether a source can be read and has a row within ``seconds``; any failure counts as no.

    The probe's jobs bear a tag of their own and are cancelled when time is up.
    """
    context, tag = SparkSession.active().sparkContext, f"weft-probe-{uuid.uuid4().hex}"
    found: list[bool] = []
    late = threading.Event()

    def probe() -> None:
        context.addJobTag(tag)
        try:
            table = load()
            found.append(not late.is_set() and not table.isEmpty())
        except Exception:
            found.append(False)
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=probe, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        late.set()
        context.cancelJobsWithTag(tag)
        return False
    return bool(found) and found[0]


#: Labels of generated edges.
LABELS = ("SELECT", "JOIN", "FILTER", "AGGREGATE", "MERGE", "CAST", "PIVOT", "UNION_ALL")


def generate(spark: SparkSession, n: int = 5000, seed: int = 12345, least: int = 2, most: int = 6, prefix: str = "N", labels: tuple[str, ...] = ()) -> DataFrame:
    """A random edge table of ``n`` nodes N1..Nn (two at least), each with ``least`` to ``most`` successors.

    No loops, no repeated pairs, every row forward, labels drawn at random. Equal
    arguments give equal tables, whatever the partitioning.
    """
    n = max(2, n)
    labels = labels or LABELS
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40))
    degree = F.least(F.lit(n - 1), least + draw("id", F.lit(-1)) % (most - least + 1)).cast("int")
    rows = spark.range(1, n + 1).withColumn("k", F.explode(F.sequence(F.lit(0), degree - 1)))
    # The k-th successor lies in the k-th of equal arcs of the ring, so successors differ from each other and from the node.
    arc = F.lit(n - 1) / degree
    low = F.floor(F.col("k") * arc)
    step = 1 + low + draw("id", "k") % F.greatest(F.lit(1), F.floor((F.col("k") + 1) * arc) - low)
    to = (F.col("id") - 1 + step) % n + 1
    name = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    label = F.element_at(F.array(*(F.lit(x) for x in labels)), (1 + draw("id", "k", F.lit(7)) % len(labels)).cast("int"))
    return rows.select(name(F.col("id")).alias("Nodes"), F.lit(FORWARD).alias("Direction"), name(to).alias("NodesLie"), label.alias("Transformation"))


def islands(spark: SparkSession) -> DataFrame:
    """A cycle with a tail, and a path apart from it."""
    pairs = [("X1", "X2", "T1"), ("X2", "X3", "T2"), ("X3", "X1", "T3"), ("X3", "X4", "T4"), ("X4", "X5", "T5"), ("Y1", "Y2", "T6"), ("Y2", "Y3", "T7")]
    return spark.createDataFrame([(a, FORWARD, b, t) for a, b, t in pairs], EDGE)


def generate_wide(spark: SparkSession, first: int = 200_001, last: int = 2_000_000) -> DataFrame:
    """The wide lineage table of generated rows: five LNA_UIDs, three forms of DTA_1, alternating directions, gaps on multiples of 2 to 5."""
    n = F.col("id")
    word = F.upper(F.substring(F.md5(n.cast("string")), 1, 8))
    form = F.when(n % 3 == 0, "FIADODSWRK").when(n % 3 == 1, F.concat(F.lit("fld_"), (n % 500).cast("string"))).otherwise(F.concat(F.lit("COL_"), (n % 500).cast("string")))
    gap = lambda k, text: F.when(n % k == 0, None).otherwise(F.concat(F.lit(text), (n % 97).cast("string")))
    return spark.range(first, last + 1).select(
        F.concat(F.lit("LNA_"), (n % 5).cast("string")).alias("LNA_UID"), F.concat(F.lit("LIN_"), n.cast("string")).alias("LIN_UID"),
        form.alias("DTA_1"), F.lit("ZJ").alias("DTA_2"), F.concat(word, F.lit("_SCHEMA")).alias("DTA_3"), F.concat(F.lit("ENV"), (n % 4).cast("string")).alias("DTA_4"),
        F.when(n % 2 == 0, "O").otherwise("I").alias("EDG_DIR"),
        F.concat(F.lit("EDG_"), (n % 500).cast("string")).alias("EDG_1"), gap(2, "TAB_").alias("EDG_2"), gap(3, "SCH_").alias("EDG_3"), gap(4, "ENV_").alias("EDG_4"),
        F.when(n % 5 == 0, None).otherwise(F.to_json(F.struct(n.alias("n")))).alias("TXN_DTA"), F.concat(F.lit("<t>"), n.cast("string"), F.lit("</t>")).alias("PRX_TXN_DTA"),
    )


def generate_headers(wide: DataFrame, base: str = "2024-01-01 00:00:00") -> DataFrame:
    """One header for each LNA_UID, values drawn from its crc32, times counted back from ``base``."""
    h = F.crc32(F.col("LNA_UID").cast("binary"))
    at = F.lit(base).cast(T.TimestampNTZType())
    back = lambda d, u: at - F.make_interval(**{u: d.cast("int")})
    return wide.select("LNA_UID").distinct().select(
        "LNA_UID", F.concat(F.lit("APP_"), F.substring("LNA_UID", 1, 20)).alias("RON_APP"), F.concat(F.lit("PCK_"), F.col("LNA_UID")).alias("PCK_PGM_NME"),
        F.concat(F.lit("PGM_"), F.col("LNA_UID")).alias("EXE_PGM_NME"), F.concat(F.lit("v"), (h % 9).cast("string")).alias("VRS_EXE_PGM"),
        F.when(h % 2 == 0, "PROD").otherwise("TEST").alias("APP_ENV"), back(h % 30, "days").alias("DLY_PGM_TSP"), back(h % 24, "hours").alias("LNA_TSP"),
        F.when(h % 3 == 0, "COBOL").otherwise("SQL").alias("PGM_TEC"), F.lit("1.0").alias("VRS_LNA_TOO"), (h % 2).cast("int").alias("TUS_IND"),
    )


#: Source modes and their other names.
MODES = {"auto": "auto", "sql": "sql", "generated": "generated", "genere": "generated", "memoire": "generated"}


@dataclass
class GraphSource:
    """Where edges come from: a table, a generated graph, or the first of both that works."""

    spark: SparkSession
    table: Callable[[], DataFrame] | None = None
    mode: str = "auto"
    nodes: int = 5000

    def __post_init__(self):
        self.mode = MODES.get((self.mode or "").strip().lower(), "auto")
        if self.mode == "auto":
            self.mode = "sql" if self.table and can_connect(self.table) else "generated"

    def load(self) -> DataFrame:
        return self.table() if self.mode == "sql" and self.table else generate(self.spark, self.nodes)

    def describe(self) -> str:
        return "edge table" if self.mode == "sql" else f"generated graph of {self.nodes} nodes"
