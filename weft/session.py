"""Session helpers: shipping this package to executors, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
#: Spark's default is 10,000 rows.
BATCH_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048
#: Else shuffle files stay until the driver happens to collect its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each Spark context.

    Arrow batches of a session that has not set their size get at most ``BATCH`` rows, so batches of long texts stay small.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(BATCH))
    if getattr(sc, "_weft_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weft-ship-"), "weft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"weft/{p.relative_to(ROOT)}")
    sc.addPyFile(path)
    sc._weft_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own; on a cluster that
    would be another folder for each machine, so it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-ckpt-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder name of this application in the shared folder; ``clean`` deletes it."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    What operators return reads some of them when it is computed, so this is for
    the end of a job, or between jobs whose results are written.  A folder that an
    application leaves behind bears its id and may be deleted by anybody.
    """
    _delete(spark, _own(spark))


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each statement that is run meanwhile are deleted when it ends."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


class Workspace:
    """Intermediate Parquet tables of one operator call, in the shared folder, below the application's id.

    ``write`` cuts lineage; ``drop`` deletes a table that no later plan reads, and
    ``clean`` what is left once results are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = own_folder(spark, name)
        self.n = 0

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        return self.write_all([df], tag)

    def write_all(self, frames: list[DataFrame], tag: str) -> DataFrame:
        """One table of all ``frames``, which have the same columns and are computed one after another."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        for k, df in enumerate(frames):
            df.write.mode("append" if k else "errorifexists").parquet(path)
        out = self.spark.read.schema(frames[0].schema).parquet(path)
        out._weft_path = path
        return out

    def stored(self, df: DataFrame, tag: str = "stored") -> DataFrame:
        """``df`` itself if it is a table of a workspace, else written: loops then read it instead of computing it each time."""
        return df if getattr(df, "_weft_path", None) else self.write(df, tag)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_weft_path", None)
            if path:
                _delete(self.spark, path)
