"""The catalogue of sample graphs, and complete graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slug string, title string, directed boolean, weighted boolean, layout string, nodes array<string>, edges array<struct<from: string, to: string, weight: int>>"


def complete_pairs(names: DataFrame, column: str = "n") -> DataFrame:
    """(from, to): all pairs of names with from < to, n (n - 1) / 2 of them; the output itself is quadratic."""
    a, b = names.select(F.col(column).alias("from")), names.select(F.col(column).alias("to"))
    return a.join(b, F.col("from") < F.col("to"))


#: Slug, title, directed, weighted, layout, nodes and edges (from, to, weight) of the ten shapes, in order.
SAMPLES = (
    (
        "connexe", "Graphe connexe", False, False, "circular", ["A", "B", "C", "D", "E", "F"],
        [("A", "B", None), ("B", "C", None), ("C", "D", None), ("D", "E", None), ("E", "F", None), ("F", "A", None), ("B", "E", None)],
    ),
    (
        "non-connexe", "Graphe non connexe", False, False, "circular", ["A", "B", "C", "D", "E", "F", "G"],
        [("A", "B", None), ("B", "C", None), ("C", "A", None), ("D", "E", None), ("F", "G", None)],
    ),
    (
        "complet", "Graphe complet (K5)", False, False, "circular", ["A", "B", "C", "D", "E"],
        [("A", "B", None), ("A", "C", None), ("A", "D", None), ("A", "E", None), ("B", "C", None), ("B", "D", None), ("B", "E", None), ("C", "D", None), ("C", "E", None), ("D", "E", None)],
    ),
    (
        "compact", "Graphe compact (dense)", False, False, "circular", ["A", "B", "C", "D", "E", "F"],
        [("A", "B", None), ("A", "C", None), ("A", "D", None), ("A", "E", None), ("B", "C", None), ("B", "D", None), ("B", "F", None), ("C", "D", None), ("C", "E", None), ("C", "F", None), ("D", "E", None), ("E", "F", None)],
    ),
    (
        "creux", "Graphe creux (sparse)", False, False, "circular", ["A", "B", "C", "D", "E", "F", "G"],
        [("A", "B", None), ("B", "C", None), ("C", "D", None), ("D", "E", None), ("E", "F", None), ("F", "G", None)],
    ),
    (
        "non-pondere", "Graphe non pondéré", False, False, "circular", ["A", "B", "C", "D", "E"],
        [("A", "B", None), ("A", "C", None), ("B", "D", None), ("C", "D", None), ("D", "E", None)],
    ),
    (
        "pondere", "Graphe pondéré", False, True, "circular", ["A", "B", "C", "D", "E"],
        [("A", "B", 4), ("A", "C", 2), ("B", "D", 5), ("C", "D", 8), ("C", "E", 3), ("D", "E", 1)],
    ),
    (
        "oriente-dag", "Graphe orienté sans cycle (DAG)", True, False, "layered", ["A", "B", "C", "D", "E"],
        [("A", "B", None), ("A", "C", None), ("B", "D", None), ("C", "D", None), ("D", "E", None)],
    ),
    (
        "cyclique", "Graphe orienté cyclique", True, False, "circular", ["A", "B", "C", "D"],
        [("A", "B", None), ("B", "C", None), ("C", "A", None), ("C", "D", None)],
    ),
    (
        "arbre", "Arbre", False, False, "layered", ["A", "B", "C", "D", "E", "F", "G"],
        [("A", "B", None), ("A", "C", None), ("B", "D", None), ("B", "E", None), ("C", "F", None), ("C", "G", None)],
    ),
)


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLES), SCHEMA)


def by_slug(spark: SparkSession, slug: str) -> DataFrame:
    """The sample of that slug; no row if there is none."""
    return samples(spark).where(F.col("slug") == slug)


def sample_edges(spark: SparkSession) -> DataFrame:
    """(slug, src, dst, weight) of all samples."""
    return samples(spark).select("slug", F.explode("edges").alias("e")).select("slug", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.weight").alias("weight"))
