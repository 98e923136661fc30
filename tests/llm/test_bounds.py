"""Bounds of samples and models: rows as well as ids, every significant term, repeated ids, hot lists."""

import random

import numpy as np
from pyspark.sql import functions as F

from weft.llm import license_scan, posting_ann, toxicity
from weft.llm.common import labelled_sample


def test_sample_bounds_rows_not_ids(spark, docs_of):
    docs = docs_of([(1, "b"), (2, "c"), (3, None)]).unionByName(docs_of([(1, "a")])).unionByName(spark.range(100_000).select(F.lit(2).cast("bigint").alias("doc_id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars")))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labelled_sample(docs, labels, "toxic", 1, 9, 3).collect()}
    assert got == {1: ("a", 0), 2: ("c", 1), 3: ("", 1)}
    assert labelled_sample(docs, labels, "toxic", 1, 9, 2).count() == 2


def test_every_significant_term_is_kept(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(50_001)]
    rows = [(" ".join(rng.sample(words, len(words))), 1) for _ in range(12)] + [(f"plain text number {i} of some words", 0) for i in range(200)]
    found, toxic, clean = toxicity.terms_of(spark.createDataFrame(rows, "text string, label int"))
    assert {w.decode() for w, *_ in found} >= set(words) and (toxic, clean) == (12, 200)


def test_repeated_ids_ask_for_one_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, "a", v.tolist()) for i, v in enumerate(x)] + [(0, "a", v.tolist()) for v in rng.normal(size=(5, 8))]
    tables = [spark.createDataFrame(order, "vec_id bigint, label string, embedding array<double>").repartition(n) for order, n in ((rows, 1), (rows[::-1], 3))]
    found = [sorted(map(tuple, posting_ann.search(t, every=100, k=4).collect())) for t in tables]
    assert found[0] == found[1] and len(found[0]) == 4


def test_hot_lists_are_cut_by_candidates_and_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id bigint, label string, embedding array<double>")
    whole = sorted(map(tuple, posting_ann.search(df, every=3, k=5).collect()))
    monkeypatch.setattr(posting_ann, "LIST", 7)
    assert sorted(map(tuple, posting_ann.search(df, every=3, k=5).collect())) == whole and len(whole) == 500


def test_license_places_from_left_to_right():
    """A place with an edit before an exact one is found too."""
    spans = license_scan.scan_text("All right reserved. All rights reserved!")["spans"]
    assert [(s["first"], s["end"], s["edits"]) for s in spans if s["label"] == "rights-notice"] == [(0, 3, 1), (3, 6, 0)]
    row = license_scan.scan_text("all right reserved")
    assert row["score"] == 1 - 1 / len("all rights reserved")
