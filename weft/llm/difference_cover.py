"""Distributed suffix sorting by difference cover modulo 3, and repeats from neighbouring suffixes.

The texts are one sequence of symbols, each text followed by a symbol of its own, so no
common prefix crosses texts.  The suffixes at positions 1 and 2 modulo 3 are sorted by
their first three symbols; equal triples get equal names, and if any are equal the
sequence of names is sorted in the same way.  The other suffixes are sorted by their
first symbol and the rank of the next suffix.  Both orders are merged by counting: a
suffix at 0 is set against those at 1 by (symbol, next rank) and against those at 2 by
(two symbols, rank after them), so two sorts tell how many of them come before it.

Every sort is a range partition; numbers come from places in partitions (see
``weft.operators.ordered``).  No text, group or rank table goes through one task; a
sequence of at most ``LOCAL`` symbols is sorted in one.

``repeated`` compares the first bytes of neighbours in the order, all of them, so
nothing rests on hashes.  A suffix order of the whole corpus costs some 40 range sorts
of rows per position, which is why ``suffix_dedup`` brings only texts together that
share a gram; figures are in the README.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import Workspace, map_rows
from weft.llm.suffix_dedup import suffix_array
from weft.operators import ordered

#: Symbols that one task sorts; rows of a sorted partition.
LOCAL, ROWS = 1 << 16, 500_000


def symbols(docs: DataFrame, space: Workspace) -> DataFrame:
    """(i, c, d, p): position and symbol of the whole sequence, place in text ``d``; the end of each text is a symbol below all bytes."""
    numbered = ordered.numbered(docs.select("d", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("x")), [F.col("d")], "k")
    numbered = space.write(numbered, "texts")
    n = numbered.count()
    # Positions are the lengths of the texts before, by the same ranges.
    held = ordered.parted(numbered.select("d", "k", (F.octet_length("x") + 1).alias("size")), [F.col("k")], ROWS, space)
    own = F.sum("size").over(Window.partitionBy(ordered.PART).orderBy(ordered.PLACE)) - F.col("size")
    sizes = held.groupBy(ordered.PART).agg(F.sum("size").alias("_s"))
    before = sizes.select(ordered.PART, (F.sum("_s").over(Window.orderBy(ordered.PART)) - F.col("_s")).alias("_b"))
    base = held.withColumn("_own", own).join(F.broadcast(before), ordered.PART).select("d", (F.col("_own") + F.col("_b")).alias("base"))

    def run(batches):
        for b in batches:
            for d, k, x, at in zip(b["d"], b["k"], b["x"], b["base"]):
                # Ends are numbers 1 to n, bytes follow.
                c = np.append(np.frombuffer(x, np.uint8).astype(np.int64) + n + 1, k + 1)
                yield {"i": np.arange(at, at + len(c)), "c": c, "d": np.full(len(c), d), "p": np.arange(len(c))}

    return space.write(map_rows(numbered.join(base, "d").select("d", "k", "x", "base"), run, "i bigint, c bigint, d bigint, p bigint"), "symbols")


def _number(df: DataFrame, by: list[str], name: str) -> DataFrame:
    return ordered.numbered(df, [F.col(c) for c in by], name, ROWS)


def ranks(s: DataFrame, n: int, space: Workspace) -> DataFrame:
    """(i, rank): places from 1 of the suffixes of the sequence (i, c), i from 0 to n - 1, c above 0."""
    if n <= LOCAL:

        def solve(batches):
            rows = [(i, c) for b in batches for i, c in zip(b["i"], b["c"])]
            seq = np.array([c for _, c in sorted(rows)], np.int64)
            # Names of symbols, as the local sort wants them small.
            sa = suffix_array(np.unique(seq, return_inverse=True)[1] + 1) if len(seq) else np.zeros(0, np.int64)
            yield {"i": sa, "rank": np.arange(1, len(sa) + 1)}

        return space.write(map_rows(s.select("i", "c").coalesce(1), solve, "i bigint, rank bigint"), "local")
    # Each symbol goes to the suffixes that begin with it or up to two before it.
    near = s.select(F.col("c"), F.explode(F.sequence(F.greatest(F.col("i") - 2, F.lit(0)), F.col("i"))).alias("at"), "i")
    heads = near.groupBy(F.col("at").alias("i")).agg(*(F.coalesce(F.max(F.when(F.col("i") == F.col("at") + k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(3)))
    heads = space.write(heads, "heads")
    sample = heads.where("i % 3 != 0")
    names = space.write(_number(sample.select("c0", "c1", "c2").distinct(), ["c0", "c1", "c2"], "name"), "names")
    named = space.write(sample.join(names, ["c0", "c1", "c2"]).select("i", (F.col("name") + 1).alias("name")), "named")
    m = named.count()
    if names.count() == m:
        rank = named.withColumnRenamed("name", "rank")
    else:
        # Positions 1 modulo 3 first, then a zero of their own if the last triple would run into the others.
        ones = (n + 1) // 3
        folded = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(ones + 1 + F.floor(F.col("i") / 3))
        lower = named.select(folded.cast("bigint").alias("i"), (F.col("name") + 1).alias("c")).unionByName(s.sparkSession.range(1).select(F.lit(ones).cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("c")))
        inner = ranks(space.write(lower, "folded"), m + 1, space)
        back = F.when(F.col("i") < ones, 3 * F.col("i") + 1).otherwise(3 * (F.col("i") - ones - 1) + 2)
        # The mark between both halves is the smallest of all.
        rank = inner.where(F.col("i") != ones).select(back.cast("bigint").alias("i"), (F.col("rank") - 1).alias("rank"))
    rank = space.write(rank, "ranks")
    own = lambda k: rank.select((F.col("i") - k).alias("i"), F.col("rank").alias(f"r{k}"))
    keyed = space.write(heads.join(own(0), "i", "left").join(own(1), "i", "left").join(own(2), "i", "left").select("i", "c0", "c1", F.coalesce("r0", F.lit(0)).alias("r0"), F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2")), "keyed")
    zero = space.write(_number(keyed.where("i % 3 = 0"), ["c0", "r1"], "own"), "zero")
    # Place among the others less the place among its own: the sampled suffixes before it.
    against = lambda rest, by: _number(zero.select("i", *by).unionByName(keyed.where(f"i % 3 = {rest}").select("i", *by)), by, "place").where("i % 3 = 0")
    one = against(1, ["c0", "r1"]).select("i", F.col("place").alias("p1"))
    two = against(2, ["c0", "c1", "r2"]).select("i", F.col("place").alias("p2"))
    merged = zero.join(one, "i").join(two, "i").select("i", (F.col("p1") + F.col("p2") - 2 * F.col("own")).alias("a"), F.lit(0).alias("b"), F.col("own").alias("z"))
    rest = rank.select("i", (F.col("rank") - 1).alias("a"), F.lit(1).alias("b"), F.lit(0).cast("bigint").alias("z"))
    return space.write(_number(merged.unionByName(rest), ["a", "b", "z"], "rank").select("i", (F.col("rank") + 1).alias("rank")), "order")


def repeated(docs: DataFrame, length: int) -> DataFrame:
    """(d, p): every place of texts (d, text), ids distinct, whose ``length`` bytes start somewhere else too; bytes are compared, all of them."""
    space = Workspace(docs.sparkSession, "cover")
    s = symbols(docs, space)
    order = ranks(s.select("i", "c"), s.count(), space)
    # Whole windows only: the text goes on for ``length`` bytes.
    whole = docs.select("d", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("x"))
    ends = whole.select("d", (F.octet_length("x") - length).alias("last"))
    windows = space.write(order.join(s.select("i", "d", "p"), "i").join(ends, "d").where(F.col("p") <= F.col("last")).select("rank", "d", "p"), "windows")
    body = F.substring(F.col("x"), (F.col("p") + 1).cast("int"), F.lit(length))
    here = space.write(windows.join(whole, "d").select("rank", "d", "p", body.alias("w")), "bodies")
    pairs = ordered.previous(here, [F.col("rank")], "w", "before", ROWS)
    equal = space.write(pairs.select("rank", "d", "p", (F.col("before") == F.col("w")).alias("same")), "equal")
    # A window repeats if it equals the one before or the one after it.
    after = ordered.previous(equal, [F.desc("rank")], "same", "next", ROWS)
    return after.where(F.coalesce("same", F.lit(False)) | F.coalesce("next", F.lit(False))).select("d", "p")
