"""The corpus pipeline: stages over documents, each written and read by the next.

Quality classification, near-duplicate removal on five-word shingles at a
similarity of 0.8, removal of repeated passages of 200 bytes, mixing of sources and
packing into sequences.  Columns stay those of ``documents`` up to the last stage,
which returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import mixing, nbsvm, packing, suffix_dedup, superminhash
from weft.llm.common import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return nbsvm.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return superminhash.deduplicate(docs, k=5, num=80, den=100)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE`` bytes that an earlier place holds."""
    return suffix_dedup.deduplicate(docs, length=suffix_dedup.PASSAGE)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, added=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mixing", mixed_sources),
    ("packing", packed),
]

#: Models, signatures and cuts come from iterations that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = space.write(docs, name.replace(" ", "-"))
    return docs
