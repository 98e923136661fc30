"""Tables of vectors: which take part, and classes of identical vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import ship


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, lengths) of a list column as doubles; null elements are NaN, null lists have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return values, offsets, lengths


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, groups = b.column(0), b.column(1).to_pylist()
        values, offsets, lengths = matrix(b.column(2))
        finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        any_ = np.concatenate([[0], np.cumsum(values != 0)])
        lo, hi = offsets[:-1], offsets[:-1] + lengths
        ok = (lengths > 0) & (finite[hi] == finite[lo]) & (any_[hi] > any_[lo])
        # Negative zero equals zero.
        plain = values + 0.0
        cls, dims = [], []
        for i, good in enumerate(ok.tolist()):
            if good and groups[i] is not None:
                cls.append(hashlib.blake2b(plain[lo[i] : hi[i]].tobytes(), digest_size=16, key=repr(groups[i]).encode()[:64]).digest())
                dims.append(int(lengths[i]))
            else:
                cls.append(None)
                dims.append(None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cls, pa.binary()), pa.array(dims, pa.int32()), b.column(1), b.column(2)], names=["vec_id", "cls", "dim", "grp", "embedding"])


def classed(df: DataFrame, group) -> DataFrame:
    """(vec_id, cls, dim, grp, embedding): ``cls``, a digest of 16 bytes, is the same for identical vectors of a group, and null for vectors that take no part.

    Those are null, empty and zero vectors, vectors with null or non-finite
    components, and vectors whose group is null.
    """
    ship(df.sparkSession)
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), group.cast("bigint").alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_classes, "vec_id bigint, cls binary, dim int, grp bigint, embedding array<double>")
