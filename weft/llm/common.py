"""Shared plumbing: input tables, intermediate tables, Arrow row mapping, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import Workspace, shared_dir, ship  # noqa: F401

U64 = np.uint64
#: Odd multipliers of the usual 64-bit finaliser.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that Python takes up at once.
ROWS = 1024


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trim() -> None:
    """Give memory that a finished task has freed back to the system: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """Run ``fn`` over column lists of each Arrow batch: dict of lists in, dict of lists out."""
    ship(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names, arrow = struct.names, _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in sliced(batches))
        for out in fn(columns):
            arrays = [pa.array(out[n], type=arrow.field(n).type, from_pandas=False) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        trim()

    return df.mapInArrow(run, struct)


def groups(batches: Iterator[dict], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """(key, columns) of each run of rows with equal ``keys``, across batches; rows must be sorted by them."""
    held_key, held = None, {}
    for b in batches:
        rows = list(zip(*(b[k] for k in keys)))
        at = 0
        while at < len(rows):
            key, end = rows[at], at + 1
            while end < len(rows) and rows[end] == key:
                end += 1
            part = {c: v[at:end] for c, v in b.items()}
            if key == held_key:
                held = {c: held[c] + v for c, v in part.items()}
            else:
                if held:
                    yield held_key, held
                held_key, held = key, part
            at = end
    if held:
        yield held_key, held


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while f"_{n}".lower() in taken:
            n = f"_{n}"
        taken.add(f"_{n}".lower())
        out.append(f"_{n}")
    return out


def _arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, vectorised; maps 0 to 0 and is a bijection."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` leaves ``rest``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, rest: int, max_rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``max_rows`` labelled rows that are not held out.

    The sample is the rows with the smallest hashes of doc_id, so it does not
    depend on partitioning.  A doc_id labelled twice takes its smaller label, one
    that several rows hold its smallest text, so ``max_rows`` bounds rows as well as
    ids; null labels and ids are left out.  The join side is bounded by ``max_rows``.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"), modulus, rest))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
