"""Substring dedup: content-defined chunks of a gear rolling hash.

A text's bytes run through a gear hash; a place where ``BITS`` bits of the hash
are zero, and no such place lies in the ``LEAST`` bytes before it, ends a chunk.
Both rules look at the preceding bytes only, so an insertion moves no cut beyond
the chunks it touches.  A stretch without cuts is split every ``MOST`` bytes from
its start.  Chunks with equal digests of 16 bytes are copies of the first one in order of
doc_id and position, and a run of consecutive copied chunks of ``shortest`` bytes
or more is a repeated substring.

Null text counts as empty: no bytes, no chunks, nothing removed.  Rows that repeat
an id are told apart by a hash of their texts; rows that repeat both keep their
first places alike.  Null ids come before all others.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Workspace, map_rows, mix64, ship, sliced, unused
from weft.llm.suffix_dedup import NULL_ID, cut_text

#: Bits of the hash that are zero at a cut, and the highest of them: the hash of bit b depends on b + 1 bytes.
BITS, TOP = 4, 16
LEAST, MOST = 12, 512
#: Bytes of consecutive copied chunks that count as a repeated substring.
SHORTEST = 100
PIECE = 1 << 20
#: Bytes of texts, and texts at most, whose chunks are told apart before they are shuffled.
BATCH, TEXTS = 8 << 20, 20_000
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
MASK = np.uint32(((1 << BITS) - 1) << (TOP - BITS))


def gear(a: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + code, of which ``TOP`` low bits are exact."""
    h = GEAR[a]
    step = 1
    while step < TOP:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the text's chunks, the text's end last."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    found = []
    back = TOP + LEAST
    for at in range(0, n, PIECE):
        lo = max(0, at - back)
        a = np.frombuffer(raw, np.uint8)[lo : at + PIECE]
        ends = np.flatnonzero((gear(a) & MASK) == 0) + 1 + lo
        if len(ends):
            ends = ends[np.concatenate([[True], ends[1:] - ends[:-1] > LEAST])]
        found.append(ends[(ends > at) & (ends <= at + PIECE)])
    ends = np.concatenate([*found, [n]])
    ends = np.unique(ends[ends <= n])
    start = np.concatenate([[0], ends[:-1]])
    if (ends - start).max() > MOST:
        ends = np.concatenate([np.append(np.arange(b + MOST, e, MOST), e) for b, e in zip(start, ends)])
    return ends


def _gathered(batches):
    """Texts up to ``BATCH`` bytes and the one that passes it, by id and hash, in this order; a text given twice is there once."""
    held, size = {}, 0
    for b in batches:
        for d, t, text in zip(b["d"], b["t"], b["text"]):
            held[d, t] = raw = text.encode("utf-8", "replace")
            size += len(raw)
            if size >= BATCH or len(held) >= TEXTS:
                yield dict(sorted(held.items()))
                held, size = {}, 0
    yield dict(sorted(held.items()))


def _chunked(batches):
    """One row for the first place of each chunk in a batch of texts, one of negative size for each run of other places.

    Other places are copies, whatever the other batches hold.  Their runs have no digest but that of their text, so they meet no chunk.
    """
    for texts in _gathered(batches):
        ends = [cuts(raw) for raw in texts.values()]
        n = [len(e) for e in ends]
        if not sum(n):
            continue
        start = np.concatenate([np.append(0, e[:-1]) if len(e) else e for e in ends])
        ends = np.concatenate(ends)
        doc = np.repeat(np.arange(len(n)), n)
        digests = bytearray()
        for raw, at, k in zip(texts.values(), np.cumsum(n) - n, n):
            for s, e in zip(start[at : at + k].tolist(), ends[at : at + k].tolist()):
                digests += hashlib.blake2b(raw[s:e], digest_size=16).digest()
        high, low = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2).T
        # A stable sort of rows that are in order of their places: the first of equal digests is the first place.
        order = np.lexsort((low, high))
        copied = np.zeros(len(doc), bool)
        copied[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        begins = copied & np.append(True, ~copied[:-1] | (doc[1:] != doc[:-1]))
        stops = copied & np.append(~copied[1:] | (doc[1:] != doc[:-1]), True)
        d, t = np.array(list(texts), np.int64).T[:, doc]
        first = ~copied
        yield {
            "d": np.concatenate([d[first], d[begins]]),
            "t": np.concatenate([t[first], t[begins]]),
            "start": np.concatenate([start[first], start[begins]]).astype(np.int32),
            "size": np.concatenate([(ends - start)[first], start[begins] - ends[stops]]).astype(np.int32),
            "high": np.concatenate([high[first], d[begins]]),
            "low": np.concatenate([low[first], t[begins]]),
        }


def _runs(shortest: int):
    """Runs of adjoining copied chunks, given as (start, size) of each document."""

    def run(batches):
        for b in batches:
            keep = []
            for chunks in b["chunks"]:
                spans: list[list[int]] = []
                for c in sorted((c["start"], c["size"]) for c in chunks):
                    if spans and c[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c[0] + c[1])
                    else:
                        spans.append([c[0], c[0] + c[1]])
                keep.append([{"begin": s, "end": e} for s, e in spans if e - s >= shortest])
            yield {"d": b["d"], "t": b["t"], "spans": keep}

    return run


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_spans(docs: DataFrame, space: Workspace, shortest: int = SHORTEST) -> DataFrame:
    """(d, t, spans) for each document with repeated substrings: byte ranges whose chunks an earlier place holds."""
    ship(docs.sparkSession)
    places = map_rows(_identified(docs), _chunked, "d bigint, t bigint, start int, size int, high bigint, low bigint")
    # A chunk has one row for each batch of texts that holds it, however many places it has there; equal places rank alike.
    rank = F.rank().over(Window.partitionBy("high", "low", "size").orderBy("d", "t", "start"))
    copies = places.withColumn("rank", rank).where("size < 0 OR rank > 1").select("d", "t", F.struct("start", F.abs("size").alias("size")).alias("c"))
    by_doc = copies.groupBy("d", "t").agg(F.collect_list("c").alias("chunks"))
    spans = map_rows(by_doc, _runs(shortest), "d bigint, t bigint, spans array<struct<begin: bigint, end: bigint>>").where(F.size("spans") > 0)
    return space.write(spans, "spans")


def removed_chunks(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans for every document."""
    space = Workspace(docs.sparkSession, "chunks")
    spans = repeated_spans(docs, space, shortest)
    sizes = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])
    found = spans.select("d", "t", sizes.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"))
    rows = _identified(docs).select("d", "t", F.octet_length("text").cast("bigint").alias("n_bytes")).join(found, ["d", "t"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"))


def deduplicate(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs``, all columns as they are, without repeated substrings in ``text``."""
    space = Workspace(docs.sparkSession, "chunks")
    spans = repeated_spans(docs, space, shortest)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, t, found = unused(docs.columns, "d", "t", "spans")
    tagged = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), t: F.xxhash64(text)})
    joined = tagged.join(spans.withColumnsRenamed({"d": d, "t": t, "spans": found}), [d, t], "left")
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            spans = b.column(b.num_columns - 1).to_pylist()
            cols = [b.column(i) for i in range(len(b.schema.names) - 1)]
            texts = [x if not s else cut_text(x.encode("utf-8", "replace"), [(r["begin"], r["end"]) for r in s]) for x, s in zip(cols[at].to_pylist(), spans)]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.select(*docs.columns, found).mapInArrow(run, docs.schema)
