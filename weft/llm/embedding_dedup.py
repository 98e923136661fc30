"""Embedding near-dedup: epsilon grid order join.

Unit vectors whose cosine is at least c lie within epsilon = sqrt(2 - 2c) of each
other.  Vectors are rotated to the principal dimensions of their scatter inside
labels, the leading ones are cut into cells of size epsilon, and the vectors are
sorted by cells (Boehm, Braunmueller, Krebs and Kriegel 2001).  The sorted
sequence is cut into blocks with bounding boxes.  Intervals of the sequence are
joined recursively: intervals of blocks first, then blocks, then parts of blocks,
and each level skips what its boxes prove to be further apart than epsilon.
Pairs that are left are compared by cosine in double precision.

A join task holds a tile of consecutive blocks and streams a stretch of the
sequence past it, so vectors are copied once for each tile that lies near, not for
each pair of blocks.  The number of Spark's partitions follows the number of block
pairs, with many pairs in each.

Identical vectors of a label form a class, which is joined once.  A task returns
for each class the number of vectors linked to it and a spanning forest of its
links, so results are bounded by the rows a task reads.

Vectors that are null, empty or zero, hold null or non-finite components, or have
no label link with nothing and are their own component.  Vectors of different
lengths are not compared; those of other than the ``LENGTHS`` most common lengths
are sorted by their leading components instead of principal ones.  Rows that repeat a vec_id are separate vectors and
count as such.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Workspace
from weft.llm.vectors import classed
from weft.operators.components import components, find, forest

LEADING = 4
#: Dimensions of the boxes.
BOXED = 16
#: Vectors of a block, blocks of an interval, vectors of a part.
BLOCK, INTERVAL, PART = 1024, 16, 128
#: Blocks that a join task holds, and those that are streamed past them.
TILE, STRETCH = 8, 16
#: Block pairs of one of Spark's partitions, about, and most partitions, which then take more pairs one after another.
PAIRS, MOST_TASKS = 16, 20_000
#: Lengths of vectors with principal dimensions of their own, labels whose means one task holds, keys that a label's intervals are joined under.
LENGTHS, LABELS, SALTS = 16, 10_000, 16
SLACK = 1e-6
#: Classes are digests of 16 bytes.
CLASS = np.dtype("V16")


def _scatter(dim: int):
    """Partial sums of x, x x^T and n by label, reduced to the scatter inside labels of this part."""

    def run(frames):
        total, mean, count = np.zeros((dim, dim)), {}, 0
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for g, at in pdf.groupby("grp").indices.items():
                part = x[at]
                if g not in mean and len(mean) == LABELS:
                    mean.clear()  # any vector near the label's middle will do
                m = mean.setdefault(g, part.mean(axis=0))
                part = part - m
                total += part.T @ part
                count += len(at)
        yield pd.DataFrame({"k": [0], "m": [total.tobytes()], "n": [count]})

    return run


def principal(reps: DataFrame, dim: int) -> np.ndarray:
    """Columns are the principal directions of all vectors around a vector of their label, by falling variance."""
    parts = reps.select("grp", "embedding").mapInPandas(_scatter(dim), "k int, m binary, n bigint")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(x) for x in pdf["m"]).tobytes()]})

    # A few partial sums of fixed size reach the driver.
    sums = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(16))).applyInPandas(add, "m binary").collect()
    total = sum((np.frombuffer(bytes(r["m"])) for r in sums), np.zeros(dim * dim)).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def rotated(x: np.ndarray, axes: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The ``n`` leading principal components of unit vectors, 0 where there are fewer."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = axes.get(x.shape[1])
    y = u[:, :n] if own is None else u @ own[:, :n]
    return np.pad(y, ((0, 0), (0, n - y.shape[1])))


def _placed(axes: dict[int, np.ndarray], eps: float):
    def run(frames):
        for pdf in frames:
            for _, part in pdf.groupby("dim"):
                cells = np.floor(rotated(np.stack(part["embedding"].to_numpy()).astype(np.float64), axes, LEADING) / eps).astype(np.int32)
                yield part.assign(**{f"c{i}": cells[:, i] for i in range(LEADING)})

    return run


def _blocked(axes: dict[int, np.ndarray]):
    """Consecutive vectors of a sorted partition to blocks of one length and label."""

    def emit(rows: pd.DataFrame, pid: int, k: int) -> dict:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        y = rotated(x, axes, BOXED)
        return {
            "dim": x.shape[1], "grp": rows["grp"].iloc[0], "part": pid, "k": k, "lo": y.min(axis=0).tobytes(), "hi": y.max(axis=0).tobytes(),
            "cls": b"".join(rows["cls"]), "copies": rows["copies"].to_numpy(np.int64).tobytes(), "x": x.tobytes(),
        }

    def run(frames):
        from pyspark import TaskContext

        pid, k, held = TaskContext.get().partitionId(), 0, None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            out = []
            while len(held):
                other = np.flatnonzero((held["grp"].to_numpy() != held["grp"].iloc[0]) | (held["dim"].to_numpy() != held["dim"].iloc[0]))
                n = int(other[0]) if len(other) else len(held)
                if n < BLOCK and not len(other):
                    break
                out.append(emit(held.iloc[: min(n, BLOCK)], pid, k))
                held, k = held.iloc[min(n, BLOCK) :].reset_index(drop=True), k + 1
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([emit(held, pid, k)])

    return run


def box_distance(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Least distance between points of two boxes."""
    gap = np.maximum(0, np.maximum(lo2 - hi, lo - hi2))
    return np.sqrt((gap * gap).sum(axis=-1))


def _near(eps: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                boxes = [np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist())).reshape(b.num_rows, -1) for c in ("lo", "hi", "lo2", "hi2")]
                yield b.filter(pa.array(box_distance(*boxes) <= eps + SLACK))

    return run


class Links:
    """Numbers of links and a spanning forest of them, of the blocks that meet in a task; a block is a list of parts with boxes."""

    def __init__(self, axes: dict[int, np.ndarray], cosine: float):
        self.axes, self.cosine, self.eps = axes, cosine, math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
        self.count: dict = {}
        self.pairs: list[tuple] = []

    def parts(self, cls: np.ndarray, copies: np.ndarray, x: np.ndarray) -> list[tuple]:
        y, norm = rotated(x, self.axes, BOXED), np.linalg.norm(x, axis=1)
        return [(cls[i : i + PART], copies[i : i + PART], x[i : i + PART], norm[i : i + PART], y[i : i + PART].min(axis=0), y[i : i + PART].max(axis=0)) for i in range(0, len(cls), PART)]

    def join(self, left: list[tuple], right: list[tuple] | None) -> None:
        """Links between two blocks, or inside one."""
        own = right is None
        right = left if own else right
        lo, hi = np.stack([p[4] for p in right]), np.stack([p[5] for p in right])
        for i, (ca, na, xa, la, low, high) in enumerate(left):
            near = box_distance(low, high, lo, hi) <= self.eps
            if own:
                near[:i] = False
            for j in np.flatnonzero(near).tolist():
                cb, nb, xb, lb, *_ = right[j]
                hit = xa @ xb.T / (la[:, None] * lb[None, :]) >= self.cosine
                if own and i == j:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                self._add(ca, hit @ nb)
                if not (own and i == j):
                    self._add(cb, na @ hit)
                r, s = np.nonzero(hit)
                self.pairs += zip(ca[r].tolist(), cb[s].tolist())
                if len(self.pairs) > 200_000:
                    self.pairs = self.edges()

    def _add(self, cls: np.ndarray, n: np.ndarray) -> None:
        for c, k in zip(cls.tolist(), n.tolist()):
            if k:
                self.count[c] = self.count.get(c, 0) + k

    def edges(self) -> list[tuple]:
        parent = forest(self.pairs)
        return [(c, r) for c in list(parent) if (r := find(parent, c)) != c]


def _joined(axes: dict[int, np.ndarray], cosine: float):
    """Rows sorted by task and side: the blocks of a tile, then those that are streamed past it."""

    def run(batches):
        import pyarrow as pa

        def flush(links: Links):
            edges = links.edges()
            return pa.RecordBatch.from_arrays(
                [pa.array([*links.count, *(a for a, _ in edges)], pa.binary()), pa.array([None] * len(links.count) + [b for _, b in edges], pa.binary()), pa.array([*links.count.values(), *([0] * len(edges))], pa.int64())],
                names=["a", "b", "n"],
            )

        task, tile, links = None, [], Links(axes, cosine)
        for b in batches:
            for r in (row for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist()):
                key = tuple(r[c] for c in TASK)
                if key != task:
                    if len(links.count) > 50_000:
                        yield flush(links)
                        links = Links(axes, cosine)
                    task, tile = key, []
                cls = np.frombuffer(r["cls"], CLASS)
                block = links.parts(cls, np.frombuffer(r["copies"], np.int64), np.frombuffer(r["x"]).reshape(len(cls), -1))
                if r["side"] == 0:
                    tile.append(((r["bp"], r["bk"]), block))
                    continue
                for at, other in tile:
                    if at == (r["bp"], r["bk"]):
                        links.join(other, None)
                    elif at < (r["bp"], r["bk"]):
                        links.join(other, block)
        yield flush(links)

    return run


#: A join task: a tile of a partition's blocks, and a stretch of a partition's.
TASK = ("dim", "grp", "part", "tile", "part2", "stretch")


def _tasks(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each join task, side 0 for the tile and 1 for the stretch."""
    pairs = pairs.withColumns({"tile": F.floor(F.col("k") / TILE).cast("int"), "stretch": F.floor(F.col("k2") / STRETCH).cast("int")})
    at = lambda side, p, k: pairs.select(*TASK, F.lit(side).alias("side"), F.col(p).alias("bp"), F.col(k).alias("bk")).distinct()
    wanted = at(0, "part", "k").unionByName(at(1, "part2", "k2"))
    body = blocks.select(F.col("part").alias("bp"), F.col("k").alias("bk"), "cls", "copies", "x")
    return wanted.join(body, ["bp", "bk"])


def near_duplicates(df: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept; vectors of one label link at ``cosine`` or more."""
    spark = df.sparkSession
    space = Workspace(spark, "grid")
    rows = space.write(classed(df, F.col("label")), "classed")
    some = rows.where(F.col("cls").isNotNull())
    reps = space.write(some.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("grp").alias("grp"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding")), "reps")
    lengths = [r["dim"] for r in reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes, eps = {d: principal(reps.where(F.col("dim") == d), d) for d in lengths}, math.sqrt(2 - 2 * cosine)
    cells = [f"c{i}" for i in range(LEADING)]
    placed = reps.select("cls", "copies", "dim", "grp", "embedding").mapInPandas(_placed(axes, eps), "cls binary, copies bigint, dim int, grp bigint, embedding array<double>, " + ", ".join(f"{c} int" for c in cells))
    placed = space.write(placed, "placed")
    order = ["dim", "grp", *cells, "cls"]
    parts = max(1, -(-placed.count() // (BLOCK * STRETCH)))
    sequence = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dim", "grp", "cls", "copies", "embedding")
    blocks = space.write(sequence.mapInPandas(_blocked(axes), "dim int, grp bigint, part int, k int, lo binary, hi binary, cls binary, copies binary, x binary"), "blocks")
    space.drop(placed)
    pairs = space.write(_block_pairs(blocks, eps), "pairs")
    tasks = _tasks(pairs, blocks).repartition(min(MOST_TASKS, max(1, -(-pairs.count() // PAIRS))), *TASK).sortWithinPartitions(*TASK, "side", "bk")
    out = space.write(tasks.mapInArrow(_joined(axes, cosine), "a binary, b binary, n bigint"), "links")
    space.drop(blocks, pairs)
    links = out.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("cls"), "n")
    comps = components(out.where(F.col("b").isNotNull()).select("a", "b")).withColumnsRenamed({"id": "cls"})
    info = space.write(reps.select("cls", "copies", "least").join(links, "cls", "left").join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "info")
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = info.join(least, "component").select("cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "cls").join(info, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(dim, grp, part, k, part2, k2) of blocks that may hold links: intervals of the sequence are joined first, then their blocks.

    The intervals of a label meet under several keys, so a large label is no single task.
    """
    own = ["dim", "grp"]
    box = blocks.select(*own, "part", "k", "lo", "hi").withColumn("i", F.floor(F.col("k") / INTERVAL).cast("int"))

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.stack([np.frombuffer(x) for x in pdf[c]]) for c in ("lo", "hi"))
        return pdf[[*own, "part", "i"]].iloc[:1].assign(lo=[lo.min(axis=0).tobytes()], hi=[hi.max(axis=0).tobytes()])

    spans = box.groupBy(*own, "part", "i").applyInPandas(span, "dim int, grp bigint, part int, i int, lo binary, hi binary")
    names = {c: c + "2" for c in ("part", "i", "k", "lo", "hi")}
    left = spans.withColumn("salt", F.pmod(F.hash("part", "i"), F.lit(SALTS)))
    right = spans.withColumnsRenamed(names).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = left.join(right, [*own, "salt"]).where("struct(part, i) <= struct(part2, i2)")
    near = far.mapInArrow(_near(eps), far.schema).select(*own, "part", "i", "part2", "i2")
    inner = near.join(box, [*own, "part", "i"]).join(box.withColumnsRenamed(names), [*own, "part2", "i2"]).where("struct(part, k) <= struct(part2, k2)")
    inner = inner.select(*own, "part", "k", "part2", "k2", "lo", "hi", "lo2", "hi2")
    return inner.mapInArrow(_near(eps), inner.schema).select(*own, "part", "k", "part2", "k2")
