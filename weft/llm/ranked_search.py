"""Ranked lexical search: document at a time over compressed postings, shard by shard.

Index.  A task gathers documents to shards of about ``SHARD_BYTES`` bytes of text and
numbers a shard's documents by doc_id.  A term's postings in a shard are those numbers
as differences and the term's counts in the documents, both as variable-length
bytes.  The index is one table: a row for each shard and term, and a row without term
that holds the shard's ids and lengths.  It covers every term of every document.

Search.  Items come in blocks of about ``BLOCK_TERMS`` terms; a block's terms and
weights, which need the documents of each term over all shards, are sent to the tasks.
The postings of a block's terms meet by shard.  In a shard each item merges its lists
by a heap of cursors, smallest document first, and keeps its best documents in a heap
of ``k`` by score, then doc_id.  Lists are ordered by the most they can add; once the
lists of the least ones cannot lift a document above the worst kept one, they leave the
merge and are only looked up for documents that may still get there, so results stay
exact.  A last window takes the best of all shards.

Scores are integers as fixed by ``weight`` and ``impacts``.  Null and empty texts are
documents without terms: they count nowhere and are never found.  Rows that repeat a
doc_id are documents each; null ids come last among equal scores.  Rows that repeat an
item_id are one item with the terms of all their texts; an item without terms has no
results, and fewer than ``k`` where fewer documents share a term of positive weight.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm.common import Workspace, groups, map_rows
from weft.llm.license_scan import words_of

#: Bytes of text of a shard; (item, term) pairs of a block; results of an item.
SHARD_BYTES, BLOCK_TERMS, K = 1 << 25, 50_000, 10
INDEX = "shard bigint, term string, df bigint, numbers binary, counts binary, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of non-negative ``values``, seven bits each, lowest first, and the number of bytes of each value."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - size
    for k in range(int(size.max(initial=0))):
        held = size > k
        out[begin[held] + k] = (values[held] >> (7 * k) & 127) | np.where(size[held] > k + 1, 128, 0)
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    """The values of ``packed``."""
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(a < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    if len(begin) == len(a):
        return a
    place = np.arange(len(a)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((a & 127) << (7 * place), begin)


class Shard:
    """Documents gathered in memory, and their postings."""

    def __init__(self):
        self.bytes = 0
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.vocab: defaultdict[bytes, int] = defaultdict(count().__next__)

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text or "")
        self.docs.append((doc_id, np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words))))
        self.bytes += len(text or "")

    def rows(self, shard: int) -> Iterator[dict[str, list]]:
        """The header, then the terms in order, as columns."""
        docs = sorted((d for d in self.docs if len(d[1])), key=lambda d: (d[0] is None, d[0] or 0))
        lengths = [len(w) for _, w in docs]
        none = dict.fromkeys(("term", "df", "numbers", "counts"), [None])
        yield none | {"shard": [shard], "n_docs": [len(docs)], "n_terms": [sum(lengths)], "ids": [[i for i, _ in docs]], "lengths": [lengths]}
        if not docs:
            return
        terms = np.array([x.decode("utf-8", "replace") for x in self.vocab], object)
        order = np.argsort(terms, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        places = rank[np.concatenate([w for _, w in docs])] * len(docs) + np.repeat(np.arange(len(docs)), lengths)
        keys, times = np.unique(places, return_counts=True)
        term, number = keys // len(docs), keys % len(docs)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(number, prepend=0)
        gaps[first] = number[first]
        gap_bytes, gap_size = packed(gaps)
        count_bytes, count_size = packed(times)
        at = lambda size: np.concatenate([[0], np.cumsum(size)])[np.append(first, len(keys))].tolist()
        gap_at, count_at, df = at(gap_size), at(count_size), np.diff(np.append(first, len(keys))).tolist()
        gap_bytes, count_bytes, named = gap_bytes.tobytes(), count_bytes.tobytes(), terms[order].tolist()
        for a in range(0, len(named), 4096):
            b = min(a + 4096, len(named))
            none = [None] * (b - a)
            yield {
                "shard": [shard] * (b - a), "term": named[a:b], "df": df[a:b], "numbers": [gap_bytes[gap_at[i] : gap_at[i + 1]] for i in range(a, b)],
                "counts": [count_bytes[count_at[i] : count_at[i + 1]] for i in range(a, b)], "n_docs": none, "n_terms": none, "ids": none, "lengths": none,
            }


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, Shard()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                held.add(doc_id, text)
                if held.bytes >= shard_bytes:
                    yield from held.rows(number)
                    number, held = number + 1, Shard()
        if held.docs:
            yield from held.rows(number)

    rows = map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, INDEX)
    return Workspace(docs.sparkSession, "index").write(rows, "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches):
        for b in batches:
            found = [(i, w) for i, t in zip(b["item_id"], b["text"]) for w in dict.fromkeys(words_of(t or ""))]
            yield {"item_id": [i for i, _ in found], "term": [w.decode("utf-8", "replace") for _, w in found]}

    schema = T.StructType([items.schema["item_id"], T.StructField("term", T.StringType())])
    return map_rows(items.select("item_id", "text"), run, schema).distinct()


def weight(df: Column, n: int) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def impacts(times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """A posting's score before the term's weight, for documents of ``lengths`` terms among ``n`` with ``total``."""
    m = 10 + 90 * lengths * n // total
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def best(lists: list[tuple[int, memoryview, memoryview, int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` highest (score, -number) of documents with a score above 0, unordered.

    ``lists``: weight, document numbers in order, impacts, largest impact.  Equal
    scores go to smaller numbers.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: x[0] * x[3])
    m = len(lists)
    weights, docs, gains = [x[0] for x in lists], [x[1] for x in lists], [x[2] for x in lists]
    size = [len(x) for x in docs]
    # What the lists up to each one can add at most.
    most, total = [], 0
    for w, _, _, top in lists:
        total += w * top
        most.append(total)
    at, kept, least, rare = [0] * m, [], 0, 0
    cursors = [d[0] * m + i for i, d in enumerate(docs)]
    heapify(cursors)
    while cursors:
        number, i = divmod(cursors[0], m)
        score = 0
        following = (number + 1) * m
        while True:
            p = at[i]
            score += weights[i] * gains[i][p]
            at[i] = p = p + 1
            if p < size[i]:
                heapreplace(cursors, docs[i][p] * m + i)
            else:
                heappop(cursors)
                if not cursors:
                    break
            if cursors[0] >= following:
                break
            i = cursors[0] - number * m
        for j in range(rare - 1, -1, -1):
            if score + most[j] <= least:
                break
            p = at[j] = bisect_left(docs[j], number, at[j])
            if p < size[j] and docs[j][p] == number:
                score += weights[j] * gains[j][p]
        if score > least:
            if len(kept) < k:
                heappush(kept, (score, -number))
            else:
                heapreplace(kept, (score, -number))
            if len(kept) == k:
                least = kept[0][0]
                if rare < m and most[rare] <= least:
                    while rare < m and most[rare] <= least:
                        rare += 1
                    cursors = [c for c in cursors if c % m >= rare]
                    heapify(cursors)
    return kept


def search(index: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first."""
    spark = index.sparkSession
    space = Workspace(spark, "ranked")
    asked = space.write(item_terms(items), "terms")
    kind = items.schema["item_id"]
    schema = T.StructType([kind, T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    all_ = index.where("term is null").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total"), F.count(F.lit(1)).alias("shards")).first()
    n, total, shards = all_["n"] or 0, all_["total"] or 0, all_["shards"]
    found = []
    if total:
        known = asked.join(index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "term")
        weights = space.write(known.select("item_id", "term", weight(F.col("df"), n).alias("w")), "weights")
        blocks = max(1, -(-weights.count() // block_terms))
        for b in range(blocks):
            rows = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            mine = defaultdict(list)
            for r in rows.collect():
                mine[r["item_id"]].append((r["term"], r["w"]))
            sent = spark.sparkContext.broadcast(dict(mine))
            need = F.broadcast(rows.select("term").distinct())
            columns = ["shard", "term", "numbers", "counts", "ids", "lengths"]
            held = index.where("term is not null").join(need, "term", "left_semi").select(*columns).unionByName(index.where("term is null").select(*columns))

            def run(batches, sent=sent):
                for _, rows in groups(batches, ("shard",)):
                    yield _shard(rows, sent.value, k, n, total)

            found.append(map_rows(held.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term")), run, schema))
    if not found:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    tops = found[0]
    for x in found[1:]:
        tops = tops.unionByName(x)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _shard(rows: dict[str, list], items: dict, k: int, n: int, total: int) -> dict[str, list]:
    """Each item's best documents in one shard: the first row is its header."""
    ids, lengths = rows["ids"][0], np.array(rows["lengths"][0], np.int64)
    lists = {}
    for term, numbers, counts in zip(rows["term"][1:], rows["numbers"][1:], rows["counts"][1:]):
        number = np.cumsum(unpacked(numbers))
        gain = impacts(unpacked(counts), lengths[number], n, total)
        lists[term] = memoryview(number), memoryview(gain), int(gain.max())
    out = {"item_id": [], "doc_id": [], "score": []}
    for item, terms in items.items():
        for score, number in best([(w, *lists[t]) for t, w in terms if t in lists], k):
            out["item_id"].append(item)
            out["doc_id"].append(ids[-number])
            out["score"].append(score)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index ``docs`` and search it for every item."""
    return search(build_index(docs), items, k)
