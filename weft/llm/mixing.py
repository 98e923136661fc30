"""Mixing sources to target weights: subset-sum budget fitting.

Each source has a budget of words.  Whole passes over a source come first; the
rest of the budget is fitted by lengths alone: the documents of a source are
counted by exact token length, every length gives the same share of its
documents, and a bounded-knapsack dynamic program over the lengths spends what
remains as exactly as it can.  The documents of each length are then selected in
the order of a seeded hash.

What one task sees is bounded by the number of distinct lengths, not of
documents, and the driver sees no list of sources: counting is pre-aggregated, and a length's documents are ranked only
inside the one hash bucket in which its selection ends.

Null text has size 0.  Rows with equal ids are separate documents; those with
equal id and size are interchangeable, and the mix takes the first few of them.
Null sources form a source of their own, last in order.  An empty table gives an
empty mix; sources without words have target 0.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import Workspace, unused
from weft.session import ship

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this multiple of all words.
SHARE = 1.5
#: No source and no document is taken more often.
MOST = 2
#: Words of budget that the dynamic program fits exactly.
FIT_WORDS = 1 << 16
#: The join with the plan spreads one length's documents over so many keys.
SALTS = 32
#: Rows of about 100 bytes that are broadcast at most.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in code point order, null last.

    Targets over ``most`` times their source's size stop there; the excess goes
    to the others by weight until no target is above.  ``source_targets`` is the
    same over a table.
    """
    rows = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    left = share * sum(n for _, n in rows)
    out: list[float | None] = [None] * len(rows)
    while True:
        open_ = [i for i in range(len(rows)) if out[i] is None]
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > most * rows[i][1]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            return [(s, n, float(t)) for (s, n), t in zip(rows, out)]
        for i in over:
            out[i] = float(most * rows[i][1])
        left -= sum(out[i] for i in over)


def source_targets(space: Workspace, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, int]:
    """``targets`` of a table (source, source_size) as (_s, source_size, target), and the number of its rows.

    Sources are ranked inside range partitions, whose counts alone reach the
    driver.  The words for each unit of weight rise from round to round as sources
    stop at their most, which is Newton's method on a concave function; a round is
    one aggregate, and the last is the one that stops no further source.
    """
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    dealt = space.write(sizes.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sources")
    held = sorted((r["_p"], r["count"]) for r in dealt.groupBy("_p").count().collect())
    starts = spark.createDataFrame(list(zip([p for p, _ in held], accumulate((n for _, n in held), initial=0))), "_p int, _b bigint")
    rank = F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    weight = F.element_at(F.array(*(F.lit(x) for x in weights)), (rank % len(weights) + 1).cast("int"))
    rows = space.write(dealt.join(F.broadcast(starts), "_p").select(F.col("source").alias("_s"), "source_size", weight.alias("_w")), "weights")
    top = F.col("source_size") * F.lit(float(most))
    stops, stopped = F.lit(False), -1
    while True:
        x = rows.select("source_size", "_w", stops.alias("_stops")).agg(
            F.sum("source_size").alias("size"), F.sum(F.when(F.col("_stops"), F.col("source_size"))).alias("size_stopped"),
            F.sum(F.when(~F.col("_stops"), F.col("_w"))).alias("weight"), F.count_if("_stops").alias("n"),
        ).first()
        if x["n"] <= stopped:
            break
        stopped, open_weight = x["n"], x["weight"]
        if not open_weight:  # no sources, or all at their most
            stops, even = F.lit(True), top
            break
        even = F.lit(share * x["size"] - most * (x["size_stopped"] or 0)) * F.col("_w") / F.lit(float(open_weight))
        stops = even > top
    return rows.select("_s", "source_size", F.when(stops, top).otherwise(even).alias("target")), sum(n for _, n in held)


def knapsack(lengths: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """Copies of each length, at most ``counts``, whose sum is as near below ``budget`` as can be; the sum.

    Reachable sums are bits of an integer; counts are split into powers of two. Of
    every sum only the item that reached it first is kept, and items end once all
    sums are reached.
    """
    items, reach = [], 1
    mask = (1 << (budget + 1)) - 1
    size_ = budget // 8 + 1
    first = np.full(8 * size_, -1, np.int32)
    for i, (size, n) in enumerate(zip(lengths, counts)):
        if reach == mask:
            break
        n, k = min(n, budget // size if size else 0), 1
        while n > 0 and reach != mask:
            take = min(k, n)
            new = reach << take * size & mask & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(size_, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(items)
                items.append((i, take))
                reach |= new
            n, k = n - take, k * 2
    at = best = reach.bit_length() - 1
    out = [0] * len(lengths)
    while at:
        i, take = items[first[at]]
        out[i] += take
        at -= take * lengths[i]
    return out, best


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words in all, never more than there are."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.zeros(len(lengths), np.int64)
    # The same share of every length, short of the last ``fit_words``.
    bulk = max(0, budget - fit_words)
    taken = np.minimum(counts, (counts * (bulk / total)).astype(np.int64)) if total else taken
    left = budget - int((lengths * taken).sum())
    # Then documents of the longest lengths, until the exact program can take over.
    for i in np.argsort(-lengths, kind="stable"):
        if left <= fit_words:
            break
        if lengths[i]:
            n = min(int(counts[i] - taken[i]), -(-(left - fit_words) // int(lengths[i])), left // int(lengths[i]))
            taken[i] += n
            left -= n * int(lengths[i])
    if left > 0:
        more, _ = knapsack([int(x) for x in lengths], [int(x) for x in counts - taken], left)
        taken += np.array(more, np.int64)
    return taken


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST, fit_words: int = FIT_WORDS) -> np.ndarray:
    """Copies of the documents of each length, at most ``most`` of a document, for ``target`` words.

    Whole passes come first. Where that leaves words over and the target is small,
    the program is run on all copies from the start.
    """
    total = int((lengths * counts).sum())
    if not total:
        return np.zeros(len(lengths), np.int64)
    whole = min(most, int(target // total))
    out = counts * whole
    if whole < most:
        out = out + fit_lengths(lengths, counts, int(target) - whole * total, fit_words)
        if int((lengths * out).sum()) < int(target) <= 4 * fit_words:
            better, reached = knapsack([int(x) for x in lengths], [int(x) * most for x in counts], int(target))
            out = np.array(better, np.int64) if reached > int((lengths * out).sum()) else out
    return out


def _matched(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source and size; ``plan`` has one row for each at most.

    A plan of up to ``BROADCAST_ROWS`` rows, which are counted, is broadcast.  A
    larger one is copied to every salt, so a common length meets in many tasks.
    """
    plan = plan.withColumnsRenamed({"source": "_s", "size": "_n"})
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    if plan.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(plan), on, how).drop("_s", "_n")
    copies = plan.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.join(copies, on & (F.col("_salt") == F.col("_t")), how).drop("_s", "_n", "_t")


def mix(docs: DataFrame, seed: int = 17, size: Column | None = None, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document; ``size`` replaces the word count."""
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark, "mixing")
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (word_count(F.col("text")) if size is None else size.cast("bigint")).alias("size"),
    ).select(
        "*", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_h"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(SALTS)).cast("int").alias("_salt")
    )
    sized = space.write(sized, "sizes")
    hist = space.write(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    goal, n_sources = source_targets(space, hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share=share, most=most)

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        lengths, n = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        copies = fit_source(lengths, n, float(part["target"].iloc[0]), most)
        return part.assign(whole=copies // n, take=copies % n)[["source", "size", "n", "source_size", "target", "whole", "take"]]

    planned = space.write(
        hist.join(F.broadcast(goal) if n_sources <= BROADCAST_ROWS else goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .groupBy("source").applyInPandas(plan, "source string, size bigint, n bigint, source_size bigint, target double, whole bigint, take bigint"),
        "plan",
    )
    # A length of n documents has about sqrt(n) buckets over the hash's range.
    bucket = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.ceil(F.sqrt(F.col("n")))).cast("bigint")
    joined = space.write(_matched(sized, planned).withColumn("_b", bucket), "planned")
    key = ["source", "size"]
    counts = joined.where((F.col("take") > 0) & (F.col("take") < F.col("n"))).groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("c"), F.first("take").alias("take"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        counts.withColumn("before", before).where((F.col("before") < F.col("take")) & (F.col("before") + F.col("c") >= F.col("take")))
        .select(*key, F.col("_b").alias("edge"), (F.col("take") - F.col("before")).alias("rest"))
    )
    edge = space.write(edge, "edges")
    marked = _matched(joined, edge, "left")
    at_edge = F.col("edge").isNotNull() & (F.col("_b") == F.col("edge"))
    # Documents outside the bucket in which their length's selection ends need no rank.
    plain = marked.where(~at_edge).withColumn("_in", F.when(F.col("edge").isNull(), F.col("take") > 0).otherwise(F.col("_b") < F.col("edge")))
    ranked = marked.where(at_edge).withColumn("_in", F.row_number().over(Window.partitionBy(*key).orderBy("_h", "doc_id")) <= F.col("rest"))
    copies = F.col("whole") + F.col("_in").cast("bigint")
    return plain.unionByName(ranked).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    Decisions meet their rows by id, source and size; rows that share all three
    divide their copies among them in the order of their texts' hashes. Null texts
    have the size 0, null ids and sources are values like others, and no column
    of ``docs`` is overwritten, whatever its name.
    """
    space = Workspace(docs.sparkSession, "mixed")
    i, c, z, k = unused(docs.columns, "id", "source", "size", "turn")
    _i, _c, _z, _m, _copies = unused([*docs.columns, i, c, z, k], "i", "c", "z", "rows", "copies")
    made = mix(docs.select("doc_id", "source", "text"), seed).groupBy(F.col("doc_id").alias(_i), F.col("source").alias(_c), F.col("size").alias(_z))
    made = space.write(made.agg(F.count(F.lit(1)).alias(_m), F.sum("copies").cast("bigint").alias(_copies)), "copies")
    rows = docs.withColumns({i: F.col("doc_id").cast("bigint"), c: F.col("source").cast("string"), z: word_count(F.col("text"))})
    on = F.col(i).eqNullSafe(F.col(_i)) & F.col(c).eqNullSafe(F.col(_c)) & (F.col(z) == F.col(_z))
    rows = rows.join(made.where(F.col(_copies) > 0), on)
    alone = rows.where(F.col(_m) == 1).withColumn(k, F.col(_copies))
    turn = F.row_number().over(Window.partitionBy(i, c, z).orderBy(F.xxhash64("text")))
    several = rows.where(F.col(_m) > 1).withColumn(k, F.floor((F.col(_copies) + F.col(_m) - turn) / F.col(_m)).cast("bigint"))
    both = alone.unionByName(several).where(F.col(k) > 0)
    return both.withColumn(k, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(k)))).select(*docs.columns)
