"""Suffix-array dedup: find every string of ``length`` bytes that occurs twice.

Two windows of ``length`` bytes can only be equal if the smallest hash among
their ``k``-byte grams is equal too.  Each text therefore falls into runs of
consecutive windows that share their smallest gram, and runs meet by that key:
a key that occurs once in the corpus settles its windows without any text, and so
does a key whose runs are all equal.  Of the others, equal runs become one with a
weight, and the remaining texts are grouped by key into blocks of bounded size.

A block's suffix array is built with the difference-cover algorithm (Karkkainen,
Sanders and Burkhardt 2006): the suffixes at positions 1 and 2 modulo 3 are
sorted by triples, triples get names, equal names recurse, and the suffixes at
positions 0 modulo 3, sorted by their first symbol and their successor's rank,
are merged in.  Neighbours in the array whose first ``length`` bytes are equal
are repeats; all bytes of them are compared.

A key with more text than fits a block is keyed anew by finer grams, up to whole
windows, so a passage that a third of all texts hold is spread out as well.

Hashes bring runs together and settle none of them.  What counts as equal to the run
that stands for it is a claim: stretches of claims that follow each other become
one, and its bytes are cut from the text that stands for it and compared with the
text that makes the claim before any of that is cut.  Runs whose hashes agree and
whose bytes do not are an error that names ``seed``; another one gives other hashes.

Where all places count, equal texts of ``length`` bytes or more are told first, and one of
each group is searched: the others repeat it from end to end, which is a claim as well.

Null text counts as empty.  Texts shorter than ``length`` have no windows and
stay whole.  Rows with equal id and text are separate documents, so each repeats
the other.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import U64, Workspace, _arrow_schema, byte_codes, map_rows, mix64, ship, sliced, trim, unused
from weft.llm.textsets import powers, prefix, slices

LENGTH = 400
#: Bytes of the shorter strings that count as a repeated passage: 99.4 % of the passages of 51 words in the test texts are no shorter.
PASSAGE = 200
#: Gram sizes, finer and finer, as shares of the window.
GRAMS = (0.4, 0.64, 0.96, 1.0)
#: Bytes whose suffixes one array holds.
BLOCK = 1 << 18
#: Longer texts are keyed piece by piece.
PIECE = 1 << 20
#: Up to so many documents, their ids are broadcast to keep other texts out of a join: 16 bytes each.
BROADCAST_IDS = 2_000_000
#: Bytes of a text that go to claims on it at once.
PART = 1 << 14
SEED = 0x2545F491
NULL_ID = -(1 << 63)


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(texts: list[bytes], length: int, k: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text index, first window, windows, key, hash of the run's bytes) of every run of windows with one smallest gram."""
    sizes = np.array([len(t) for t in texts], np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(a) < length:
        return none, none, none, none, none
    up, _ = powers(len(a) + 1)
    s = prefix(a, codes)
    gram = mix64((s[k:] - s[:-k]) * up[: len(s) - k])
    low = smallest(gram, length - k + 1)
    off = np.concatenate([[0], np.cumsum(sizes)])
    has = sizes >= length
    first, last = off[:-1][has], off[1:][has] - length + 1  # windows of a text: first to last - 1
    edge = np.zeros(len(low) + 1, bool)
    # A run ends where the smallest value changes or its first place is passed, so equal windows of one text are in different runs.
    edge[1:-1] = (low[1:] != low[:-1]) | (gram[: len(low) - 1] == low[:-1])
    edge[first] = True
    edge[last] = True
    at = np.flatnonzero(edge)
    doc = np.searchsorted(off, at, "right") - 1
    doc = np.minimum(doc, len(sizes) - 1)
    inside = at < off[doc + 1] - length + 1
    end = np.append(at[1:], len(low))
    at, end, doc = at[inside], end[inside], doc[inside]
    stop = end + length - 1
    h = mix64((s[stop] - s[at]) * up[at] + (stop - at).astype(U64))
    return doc, at - off[doc], end - at, low[at].view(np.int64), h.view(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers below 2**21, of fewer than 2**21 symbols, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    s = np.concatenate([s, np.zeros(4, np.int64)])
    pos1 = np.arange(1, n + (n % 3 == 1), 3)
    pos = np.concatenate([pos1, np.arange(2, n, 3)])
    triple = s[pos] << 42 | s[pos + 1] << 21 | s[pos + 2]
    order = np.argsort(triple)
    t = triple[order]
    name = np.empty(len(t), np.int64)
    name[order] = np.concatenate([[1], 1 + np.cumsum(t[1:] != t[:-1])])
    del triple
    if name[order[-1]] < len(t):
        del t
        order = suffix_array(name)
    sample = pos[order]
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    key = s[rest] << 32 | rank[rest + 1]
    order = np.argsort(key)
    rest, key = rest[order], key[order]
    is1 = sample % 3 == 1
    one, two = sample[is1], sample[~is1]
    below = np.searchsorted(s[one] << 32 | rank[one + 1], key)
    below += np.searchsorted(s[two] << 42 | s[two + 1] << 21 | rank[two + 2], s[rest] << 42 | s[rest + 1] << 21 | rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + below
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sample
    return out


def equal_neighbours(buf: bytes, v: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes at v[i] and v[i + 1] are equal; later bytes are compared first, as neighbours share beginnings."""
    a = np.frombuffer(buf + b"\0" * 16, np.uint8)
    word = np.empty(len(a) - 8, U64)
    for r in range(8):
        part = a[r : r + (len(a) - r) // 8 * 8].view(U64)
        word[r::8] = part[: len(word[r::8])]
    left = np.arange(len(v) - 1)
    for t in [*range(length - 8, 0, -8), 0]:
        left = left[word[v[left] + t] == word[v[left + 1] + t]]
    out = np.zeros(max(0, len(v) - 1), bool)
    out[left] = True
    return out


def _spans(flag: np.ndarray, starts: np.ndarray) -> dict[int, bytes]:
    """Runs of true flags as (begin, end) pairs relative to the segment that holds them, by segment."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    b, e = edge[0::2], edge[1::2]
    seg = np.searchsorted(starts, b, "right") - 1
    pairs = np.stack([b - starts[seg], e - starts[seg]], 1).astype(np.int32)
    cut = np.flatnonzero(np.diff(seg)) + 1
    return {int(g[0]): p.tobytes() for g, p in zip(np.split(seg, cut), np.split(pairs, cut)) if len(g)}


def repeats(texts: list[bytes], weights: list[int], where: list[tuple], length: int) -> list[tuple[bytes, bytes] | None]:
    """For each distinct text (repeated windows, those of them that occur first) as pairs of int32; None where nothing repeats.

    ``where`` is the place (document key, position) that stands for each text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = b"\0".join(texts) + b"\0"
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = np.frombuffer(buf, np.uint8).astype(np.int64) + 2
    s[starts + sizes] = 1
    valid = np.zeros(len(s), bool)
    for b, n in zip(starts.tolist(), sizes.tolist()):
        valid[b : b + n - length + 1] = True
    sa = suffix_array(s)
    v = sa[valid[sa]]
    group = np.concatenate([[0], np.cumsum(~equal_neighbours(buf, v, length))])
    seg = np.searchsorted(starts, v, "right") - 1
    total = np.bincount(group, np.array(weights, np.float64)[seg])
    twice = total[group] >= 2
    docs = {d: i for i, d in enumerate(sorted({w[0] for w in where}))}
    base = np.array([docs[d] << 40 | p for d, p in where], np.int64)
    place = base[seg] + (v - starts[seg])
    least = np.minimum.reduceat(place, np.flatnonzero(np.diff(group, prepend=-1)))
    flag, first = np.zeros(len(s), bool), np.zeros(len(s), bool)
    flag[v[twice]] = True
    first[v[twice & (place == least[group])]] = True
    found, firsts = _spans(flag, starts), _spans(first, starts)
    return [(found[i], firsts.get(i, b"")) if i in found else None for i in range(len(texts))]


def _keyed(length: int, codes: np.ndarray):
    k = max(1, int(length * GRAMS[0]))

    def run(batches):
        for b in batches:
            raw, ids = [], []
            for d, t, text, within in zip(b["d"], b["t"], b["text"], b.get("within") or repeat(None)):
                x = text.encode("utf-8", "replace")
                for begin, end in [(0, len(x))] if within is None else np.frombuffer(within, np.int64).reshape(-1, 2).tolist():
                    for at in range(begin, end - length + 1, PIECE):
                        raw.append(x[at : min(end, at + PIECE + length - 1)])
                        ids.append((d, t, at))
            for i, j in slices(raw):
                doc, start, n, key, sub = runs(raw[i:j], length, k, codes)
                d, t, at = np.array(ids[i:j], np.int64).T[:, doc]
                yield {"key": key, "sub": sub, "d": d, "t": t, "start": at + start, "n": n}

    return run


def _cut_out(length: int):
    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "sub", "w", "d", "t", "start", "body", "heavy")}
            for text, d, t, segs in zip(b["text"], b["d"], b["t"], b["segs"]):
                x = text.encode("utf-8", "replace")
                for g in segs:
                    for c, v in (("key", g["key"]), ("sub", g["sub"]), ("w", g["w"]), ("d", d), ("t", t), ("start", g["start"]), ("heavy", g["heavy"]), ("body", x[g["start"] : g["start"] + g["n"] + length - 1])):
                        out[c].append(v)
                if sum(map(len, out["body"])) > 4 << 20:
                    yield out
                    out = {c: [] for c in out}
            yield out

    return run


def _finer(length: int, k: int, codes: np.ndarray):
    """Runs of a finer gram inside each text, under keys that hold the old key as well."""

    def run(batches):
        for b in batches:
            for i, j in slices(b["body"]):
                doc, rel, n, key, sub = runs(b["body"][i:j], length, k, codes)
                who = (doc + i).tolist()
                old = np.array([b["key"][x] for x in who], np.int64).view(U64)
                out = {c: [b[c][x] for x in who] for c in ("w", "d", "t")}
                yield out | {
                    "key": mix64(old ^ mix64(key.view(U64) + U64(k))).view(np.int64), "sub": sub, "start": [b["start"][x] + r for x, r in zip(who, rel.tolist())],
                    "body": [b["body"][x][r : r + m + length - 1] for x, r, m in zip(who, rel.tolist(), n.tolist())],
                    "up_key": [b["key"][x] for x in who], "up_sub": [b["sub"][x] for x in who], "rel": rel,
                }

    return run


def _blocks(length: int):
    """Rows sorted by key; whole keys go to a block until it is full."""

    def solve(rows: dict) -> dict:
        got = repeats([r[0] for r in rows.values()], [r[1] for r in rows.values()], [((r[2], r[3]), r[4]) for r in rows.values()], length)
        keep = [(k, g) for k, g in zip(rows, got) if g]
        out = {"key": [k[0] for k, _ in keep], "sub": [k[1] for k, _ in keep], "spans": [g[0] for _, g in keep], "firsts": [g[1] for _, g in keep]}
        return out | {c: [rows[k][i] for k, _ in keep] for c, i in (("d", 2), ("t", 3), ("start", 4))}

    def run(batches):
        rows: dict = {}
        size, last = 0, None
        for b in batches:
            for key, sub, w, d, t, start, body in zip(*(b[c] for c in ("key", "sub", "w", "d", "t", "start", "body"))):
                if key != last and size >= BLOCK // 2:
                    yield solve(rows)
                    rows, size = {}, 0
                last = key
                if (key, sub) not in rows:
                    rows[key, sub] = (body, w, d, t, start)
                    size += len(body)
        if rows:
            yield solve(rows)

    return run


def _raised(batches):
    """Repeats of a finer run as repeats of the run that holds it; only the run in which a string stands first keeps it as such."""

    def shift(raw: bytes, by: int) -> bytes:
        return (np.frombuffer(raw, np.int32) + np.int32(by)).tobytes()

    for b in batches:
        same = zip(b["firsts"], b["rel"], b["here"])
        yield {
            "key": b["up_key"], "sub": b["up_sub"], "spans": [shift(x, r) for x, r in zip(b["spans"], b["rel"])], "firsts": [shift(x, r) if h else b"" for x, r, h in same],
            "d": b["d"], "t": b["t"], "start": [x - r for x, r in zip(b["start"], b["rel"])],
        }


def _unions(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of one, begin, end) of intervals after those of a group that touch or overlap became one, by group and begin."""
    order = np.lexsort((begin, group))
    g, b, e = group[order], begin[order], end[order]
    if not len(g):
        return order, b, e
    # The furthest end so far in the group: groups are set apart by more than the range of ends.
    low = int(e.min())
    apart = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])]) * (int(e.max()) - low + 1)
    top = np.maximum.accumulate(e - low + apart) - apart + low
    at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] > top[:-1])]))
    return order[at], b[at], top[np.append(at[1:], len(g)) - 1]


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Numbers of groups of equal keys, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _gathered(first: bool, length: int, schema: T.StructType):
    """Repeated windows of each document as pairs of int64, and what the runs that do not stand for themselves claim, merged.

    A run without ``spans`` occurs elsewhere as it is. Runs in their first place keep what stands first if ``first``;
    documents whose places all stand first are left out.
    """
    arrow = _arrow_schema(schema)

    def run(batches):
        for batch in sliced(batches):
            held = batch.column(batch.schema.names.index("r"))
            flat = held.flatten()
            col = dict(zip((f.name for f in flat.type), flat.flatten()))
            doc = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
            start, n, fd, ft, fs = (col[c].to_numpy().astype(np.int64) for c in ("start", "n", "fd", "ft", "fs"))
            own = col["own"].to_numpy(zero_copy_only=False).astype(bool)
            spans = col["spans"].to_pylist()
            if first:
                firsts = col["firsts"].to_pylist()
                for i in np.flatnonzero(own).tolist():
                    if firsts[i]:
                        spans[i] = minus(*(np.frombuffer(x, np.int32).reshape(-1, 2) for x in (spans[i], firsts[i]))).astype(np.int32).tobytes()
            as_is = np.flatnonzero(col["spans"].is_null().to_numpy(zero_copy_only=False) & ~(own & first))
            pairs = np.frombuffer(b"".join(x for x in spans if x), np.int32).reshape(-1, 2)
            who = np.repeat(np.arange(len(spans)), [len(x) // 8 if x else 0 for x in spans])
            begin = np.concatenate([pairs[:, 0] + start[who], start[as_is]])
            end = np.concatenate([pairs[:, 1] + start[who], start[as_is] + n[as_is]])
            owner = np.concatenate([doc[who], doc[as_is]])
            at, begin, end = _unions(owner, begin, end)
            counts = np.bincount(owner[at], minlength=len(held))
            cuts = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            raw = pa.py_buffer(np.stack([begin, end], 1).astype(np.int64).tobytes())
            p = pa.BinaryArray.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((cuts(counts) * 16).astype(np.int32).tobytes()), raw])
            away = np.flatnonzero(~own)
            doc, start, n, fd, ft, fs = (x[away] for x in (doc, start, n, fd, ft, fs))
            at, begin, end = _unions(_numbered(doc, fd, ft, fs - start), start, start + n + length - 1)
            claims = [begin, end, fd[at], ft[at], fs[at] - start[at] + begin]
            c = pa.ListArray.from_arrays(pa.array(cuts(np.bincount(doc[at], minlength=len(held)))), pa.StructArray.from_arrays([pa.array(x) for x in claims], ["b", "e", "fd", "ft", "fs"]))
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32)), p)
            found = [batch.column(batch.schema.names.index(k)) for k in ("d", "t")] + [p, c]
            out = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, arrow)], schema=arrow)
            yield out.filter(pa.array(counts > 0))
        trim()

    return run


def _stretches(length: int, passage: int):
    """Where strings of ``length`` bytes can repeat: bytes (begin, end) whose strings of ``passage`` bytes all do."""

    def run(batches):
        for b in batches:
            held = [[(s, e + passage - 1) for s, e in covered(p, 1) if e - s > length - passage] for p in b["p"]]
            keep = [i for i, h in enumerate(held) if h]
            yield {"d": [b["d"][i] for i in keep], "t": [b["t"][i] for i in keep], "within": [np.array(held[i], np.int64).tobytes() for i in keep]}

    return run


def _all_of_it(length: int, passage: int):
    """All windows of a text that has copies; each but the one searched claims to be that one."""

    def run(batches):
        for b in batches:
            rows = list(zip(b["d"], b["t"], b["n"], b["fd"]))
            windows = lambda size: [[np.array([0, max(0, n - size + 1)], np.int64).tobytes()] for _, _, n, _ in rows]
            claims = [[] if d == fd else [{"b": 0, "e": n, "fd": fd, "ft": t, "fs": 0}] for d, t, n, fd in rows]
            yield {"d": b["d"], "t": b["t"], "p": windows(length), "q": windows(passage), "c": claims}

    return run


def merged(claims: list[dict]) -> list[dict]:
    """Claims on one text at one distance that touch or overlap become one."""
    out: list[dict] = []
    for c in sorted(claims, key=lambda c: (c["fd"], c["ft"], c["fs"] - c["b"], c["b"])):
        last = out[-1] if out else None
        if last and (last["fd"], last["ft"], last["fs"] - last["b"]) == (c["fd"], c["ft"], c["fs"] - c["b"]) and c["b"] <= last["e"]:
            last["e"] = max(last["e"], c["e"])
        else:
            out.append(dict(c))
    return out


def _parted(batches):
    """Merged claims, cut where a part of the text they claim ends."""
    for b in batches:
        out = {c: [] for c in ("d", "t", "b", "fd", "ft", "part", "off", "n")}
        for d, t, claims in zip(b["d"], b["t"], b["c"]):
            for c in merged(claims):
                at, end = c["fs"], c["fs"] + c["e"] - c["b"]
                while at < end:
                    part = at // PART
                    n = min(end, (part + 1) * PART) - at
                    for k, v in zip(out, (d, t, c["b"] + at - c["fs"], c["fd"], c["ft"], part, at - part * PART, n)):
                        out[k].append(v)
                    at += n
        yield out


def _asked(batches):
    """Claims of ``_parted``, one row for each part that a document claims, however often it does."""
    for rows in _parted(batches):
        found: dict = {}
        for d, t, b, fd, ft, part, off, n in zip(*(rows[c] for c in ("d", "t", "b", "fd", "ft", "part", "off", "n"))):
            found.setdefault((d, t, fd, ft, part), []).append({"b": b, "off": off, "n": n})
        yield dict(zip(("d", "t", "fd", "ft", "part"), map(list, zip(*found)))) | {"at": list(found.values())} if found else {c: [] for c in ("d", "t", "fd", "ft", "part", "at")}


def _parts(batches):
    """The parts of texts that claims ask for."""
    for b in batches:
        out: dict = {c: [] for c in ("fd", "ft", "part", "x")}
        held = 0
        for d, t, text, parts in zip(b["d"], b["t"], b["text"], b["parts"]):
            x = text.encode("utf-8", "replace")
            for p in parts:
                for c, v in zip(out, (d, t, p, x[p * PART : (p + 1) * PART])):
                    out[c].append(v)
                held += len(out["x"][-1])
                if held > 4 << 20:
                    yield out
                    out, held = {c: [] for c in out}, 0
        yield out


def confirm(x: bytes, held: list[dict]) -> None:
    """Raise if the text does not hold what was claimed of it, byte by byte."""
    for h in held:
        if x[h["b"] : h["b"] + len(h["x"])] != h["x"]:
            raise ValueError("strings of equal hashes differ: run again with another seed")


def minus(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Intervals of p without those of q, both ascending and disjoint."""
    n = int(max(p.max(), q.max())) if len(p) and len(q) else 0
    if not n:
        return p
    on = np.zeros(n + 1, bool)
    for a, b in p:
        on[a:b] = True
    for a, b in q:
        on[a:b] = False
    return np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))).reshape(-1, 2)


def covered(raw: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows given as pairs of int64."""
    p = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in raw]) if raw else np.zeros((0, 2), np.int64)
    p = p[p[:, 1] > p[:, 0]]
    out: list[list[int]] = []
    for a, b in p[np.argsort(p[:, 0], kind="stable")].tolist():
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _identity(seed: int) -> tuple[Column, Column, Column]:
    """Id, hash and text of a document, nulls replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), F.xxhash64(F.lit(seed), text), text


def _identified(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(*(c.alias(n) for c, n in zip(_identity(seed), ("d", "t", "text"))))


def _copies(docs: DataFrame, space: Workspace, length: int) -> tuple[DataFrame, DataFrame]:
    """(documents with one of each group of equal texts, members of such groups (d, t, n, fd) of ``length`` bytes or more).

    Equal are texts of one hash and size; that a member's bytes are those of the smallest id ``fd`` is a claim like any other.
    """
    sized = docs.where(F.octet_length("text") >= length).select("d", "t", F.octet_length("text").alias("n"))
    groups = space.write(sized.groupBy("t", "n").agg(F.min("d").alias("fd"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "copies")
    few = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    once = docs.withColumn("n", F.octet_length("text")).join(few, ["t", "n"], "left").where("fd IS NULL OR d = fd").select("d", "t", "text")
    return once, space.write(sized.join(few, ["t", "n"]), "members")


CLAIM = "b bigint, e bigint, fd bigint, ft bigint, fs bigint"


def repeated_windows(docs: DataFrame, space: Workspace, length: int = LENGTH, keep_first: bool = False, block: int = BLOCK, seed: int = SEED, within: DataFrame | None = None) -> DataFrame:
    """(d, t, p, c): for each document (d, t, text) with repeats its windows that occur elsewhere too, pairs of int64 as binaries, and
    the claims they rest on: bytes b to e of it are those from fs on in the document (fd, ft).  They hold once ``claimed`` is confirmed.

    ``within`` (d, t, within) tells the bytes of each document outside of which no string repeats, pairs of int64.
    """
    ship(docs.sparkSession)
    codes = byte_codes(seed)
    long = docs.where(F.octet_length("text") >= length)
    occ = space.write(map_rows(long if within is None else long.join(within, ["d", "t"]), _keyed(length, codes), "key bigint, sub bigint, d bigint, t bigint, start bigint, n int"), "runs")
    # Bytes of all runs of a key, equal ones too, so a key that is not heavy fits a block.
    size = F.sum(F.col("n") + (length - 1))
    twice = occ.groupBy("key").agg(F.count(F.lit(1)).alias("c"), (F.min("sub") == F.max("sub")).alias("same"), (size > block // 2).alias("heavy")).where("c > 1").drop("c")
    # Written before it is joined, so Spark can split the join of a key that many texts hold.
    twice = space.write(twice, "twice")
    shared = space.write(occ.join(twice, "key"), "shared")
    space.drop(occ, twice)
    first = F.min(F.struct("d", "t", "start")).alias("f")
    cand, same = shared.where("not same").drop("same"), shared.where("same")
    stands = space.write(same.groupBy("key").agg(first).select("key", F.col("f.d").alias("fd"), F.col("f.t").alias("ft"), F.col("f.start").alias("fs")), "least")
    own = (F.struct("d", "t", "start") == F.struct("fd", "ft", "fs")).alias("own")
    run = lambda spans, firsts: F.struct("start", "n", "fd", "ft", "fs", own, spans.alias("spans"), firsts.alias("firsts")).alias("r")
    none = F.lit(None).cast("binary")
    same = same.join(stands, "key").select("d", "t", run(none, none))
    dist = space.write(cand.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("w"), first, F.max("n").alias("n"), F.first("heavy").alias("heavy")), "distinct")
    segs = dist.groupBy(F.col("f.d").alias("d"), F.col("f.t").alias("t")).agg(F.collect_list(F.struct("key", "sub", F.col("f.start").alias("start"), "n", "w", "heavy")).alias("segs"))
    ids = space.write(dist.select("f.d", "f.t").distinct(), "ids")
    body = "key bigint, sub bigint, w bigint, d bigint, t bigint, start bigint, body binary"
    rows = space.write(map_rows(_only(docs, ids).join(segs, ["d", "t"]).select("d", "t", "text", "segs"), _cut_out(length), body + ", heavy boolean"), "bodies")
    ready, rows, maps = rows.where("not heavy").drop("heavy"), rows.where("heavy").drop("heavy"), []
    for share in GRAMS[1:]:
        if maps:
            heavy = rows.groupBy("key").agg(F.sum(F.length("body")).alias("bytes")).where(F.col("bytes") > block // 2).select("key")
            heavy = space.write(heavy, "heavy")
            ready = ready.unionByName(rows.join(heavy, "key", "left_anti"))
            rows = rows.join(heavy, "key", "left_semi")
        if rows.isEmpty():
            break
        finer = space.write(
            map_rows(rows, _finer(length, max(1, int(length * share)), codes), f"{body}, up_key bigint, up_sub bigint, rel int"), "finer"
        )
        maps.append(finer.select("key", "sub", "up_key", "up_sub", "rel", F.col("d").alias("md"), F.col("t").alias("mt"), F.col("start").alias("ms")))
        one = finer.groupBy("key", "sub", "body").agg(F.sum("w").alias("w"), F.min(F.struct("d", "t", "start")).alias("f")).select("key", "sub", "w", "f.*", "body")
        several = finer.groupBy("key").agg(F.sum("w").alias("w")).where("w > 1").select("key")
        rows = space.write(one.join(several, "key", "left_semi"), "rows")
        if not rows.groupBy("key", "sub").count().where("count > 1").isEmpty():
            raise ValueError("strings of equal hashes differ: run again with another seed")
    else:
        ready = ready.unionByName(rows)
    total = ready.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, int(total // (256 * block)), min(64, int(total // block)))
    result = "key bigint, sub bigint, spans binary, firsts binary, d bigint, t bigint, start bigint"
    solved = space.write(map_rows(ready.repartition(parts, "key").sortWithinPartitions("key", "sub"), _blocks(length), result), "solved")
    space.drop(dist)
    # What was found under finer keys goes back to the runs it came from, one row for each of them.
    found = solved
    joined = lambda c: F.aggregate(F.collect_list(c), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias(c)
    for m in reversed(maps):
        up = found.join(m, ["key", "sub"]).select("up_key", "up_sub", "rel", "spans", "firsts", (F.struct("d", "t", "start") == F.struct("md", "mt", "ms")).alias("here"), F.col("md").alias("d"), F.col("mt").alias("t"), F.col("ms").alias("start"))
        up = map_rows(up, _raised, result).groupBy("key", "sub").agg(joined("spans"), joined("firsts"), *(F.first(c).alias(c) for c in ("d", "t", "start")))
        found = space.write(solved.unionByName(up), "found")
    at = cand.join(found.withColumnsRenamed({"d": "fd", "t": "ft", "start": "fs"}), ["key", "sub"])
    places = at.select("d", "t", run(F.col("spans"), F.col("firsts") if keep_first else none))
    each = places.unionByName(same).groupBy("d", "t").agg(F.collect_list("r").alias("r"))
    schema = T._parse_datatype_string(f"d bigint, t bigint, p array<binary>, c array<struct<{CLAIM.replace(' bigint', ': bigint')}>>")
    out = space.write(each.mapInArrow(_gathered(keep_first, length, schema), schema), "windows")
    space.drop(shared, stands, found, solved)
    return out


def claimed(docs: DataFrame, windows: DataFrame, space: Workspace) -> DataFrame:
    """(d, t, held): for each document with claims the bytes (b, x) that other places hold and it must hold from b on.

    Only the parts of a text that are claimed are cut, once for all who claim them.
    """
    claims = space.write(map_rows(windows.select("d", "t", "c"), _asked, "d bigint, t bigint, fd bigint, ft bigint, part bigint, at array<struct<b: bigint, off: int, n: int>>"), "claims")
    asked = space.write(claims.groupBy(F.col("fd").alias("d"), F.col("ft").alias("t")).agg(F.collect_set("part").alias("parts")), "asked")
    parts = map_rows(_only(docs, asked.select("d", "t")).join(asked, ["d", "t"]).select("d", "t", "text", "parts"), _parts, "fd bigint, ft bigint, part bigint, x binary")
    # Rows that repeat id and text are one document.
    parts = space.write(parts.dropDuplicates(["fd", "ft", "part"]), "parts")
    bytes_ = F.transform("at", lambda a: F.struct(a["b"].alias("b"), F.substring(F.col("x"), a["off"] + 1, a["n"]).alias("x")))
    return claims.join(parts, ["fd", "ft", "part"]).groupBy("d", "t").agg(F.flatten(F.collect_list(bytes_)).alias("held"))


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", on: tuple | list = ("d", "t")) -> DataFrame:
    """Documents with (or without) an id in ``ids``; ids are broadcast if there are at most BROADCAST_IDS."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, list(on), how)


def _digest(length: int, passage: int):
    def run(batches):
        for b in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")}
            for text, p, q, held in zip(b["text"], b["p"], b["q"], b["held"]):
                x = text.encode("utf-8", "replace")
                confirm(x, held or [])
                spans = covered(p or [], length)
                short = covered(q or [], passage) if passage < length else spans
                h, at = hashlib.sha256(), 0
                for s, e in spans:
                    h.update(x[at:s])
                    at = e
                h.update(x[at:])
                size = lambda spans: sum(e - s for s, e in spans)
                for c, v in zip(out, (len(x), size(spans), len(spans), h.hexdigest(), size(short))):
                    out[c].append(v)
            yield out | {"doc_id": [None if d == NULL_ID else d for d in b["d"]]}

    return run


def _joined(docs: DataFrame, windows: DataFrame, held: DataFrame) -> DataFrame:
    """Documents with their repeated windows and what was claimed of them; those without any keep out of the shuffle."""
    ids = windows.select("d", "t")
    there = _only(docs, ids).join(windows, ["d", "t"]).join(held, ["d", "t"], "left")
    none = {c: F.lit(None).cast(there.schema[c].dataType) for c in ("p", "q", "held")}
    return there.unionByName(_only(docs, ids, "left_anti").withColumns(none))


def removed_bytes(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, passage: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage for every document.

    ``n_removed``, ``n_spans`` and ``kept_sha256`` are about strings of ``length``
    bytes; ``n_passage`` counts the bytes covered by repeated strings of ``passage``
    bytes, which is shorter, or of ``length`` if it is not given.
    """
    space = Workspace(docs.sparkSession, "suffix")
    docs, passage = _identified(docs, seed), min(length, passage or length)
    # Copies of a text would meet in every run of it, so one of each group is searched; the first place is told among all.
    once, members = (docs, None) if keep_first else _copies(docs, space, passage)
    windows = repeated_windows(once, space, passage, keep_first, seed=seed)
    if passage < length:
        if keep_first:  # then windows leave out first places
            longer = repeated_windows(once, space, length, keep_first, seed=seed)
        else:
            # A longer string repeats where all shorter ones in it do; cut to that, most copies are equal runs.
            within = space.write(map_rows(windows.select("d", "t", "p"), _stretches(length, passage), "d bigint, t bigint, within binary"), "within")
            longer = repeated_windows(_only(once, within.select("d", "t")), space, length, keep_first, seed=seed, within=within)
        longer = longer.withColumnRenamed("c", "more")
        short = windows.withColumnRenamed("p", "q").join(longer, ["d", "t"], "left")
        windows = short.select("d", "t", "p", "q", F.concat("c", F.coalesce("more", F.array().cast(windows.schema["c"].dataType))).alias("c"))
    else:
        windows = windows.withColumn("q", F.lit(None).cast("array<binary>"))
    if members is not None:
        whole = map_rows(members.dropDuplicates(), _all_of_it(length, passage), windows.select("d", "t", "p", "q", "c").schema)
        windows = windows.join(members.select("d", "t"), ["d", "t"], "left_anti").select("d", "t", "p", "q", "c").unionByName(whole)
    windows = space.write(windows, "all")
    held = claimed(docs, windows, space)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint"
    return map_rows(_joined(docs, windows.drop("c"), held).select("d", "text", "p", "q", "held"), _digest(length, passage), schema)


def cut_text(x: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, each shrunk to whole characters."""
    out, at = [], 0
    for s, e in spans:
        while s < e and x[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(x) and x[e] & 0xC0 == 0x80:
            e -= 1
        out.append(x[at:s])
        at = max(at, e)
    return b"".join([*out, x[at:]]).decode("utf-8", "replace")


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text`` and ``n_chars`` set anew; the first place of each repeated string keeps it.

    All other columns stay as they are, whatever their names. Null texts that lose
    nothing stay null. Rows that repeat both id and text are one document given
    several times, so they share its places and all lose or keep the same; equal
    texts under different ids are different documents.
    """
    space = Workspace(docs.sparkSession, "suffix")
    texts = _identified(docs, seed)
    windows = repeated_windows(texts, space, length, keep_first, seed=seed)
    held = claimed(texts, windows, space)
    d, t, p, h = unused(docs.columns, "d", "t", "p", "held")
    tagged = docs.withColumns(dict(zip((d, t), _identity(seed))))
    windows = windows.select(F.col("d").alias(d), F.col("t").alias(t), F.col("p").alias(p))
    held = held.select(F.col("d").alias(d), F.col("t").alias(t), F.col("held").alias(h))
    there = _only(tagged, windows.select(d, t), on=[d, t]).join(windows, [d, t]).join(held, [d, t], "left")
    fields = list(docs.schema)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for b in sliced(batches):
            texts = []
            for x, spans, claims in zip(*(b.column(i).to_pylist() for i in (at, len(fields), len(fields) + 1))):
                raw = (x or "").encode("utf-8", "replace")
                confirm(raw, claims or [])
                texts.append(cut_text(raw, covered(spans, length)))
            cols = [b.column(i) for i in range(len(fields))]
            cols[at] = pa.array(texts, cols[at].type)
            if count >= 0:
                cols[count] = pa.array([len(x) for x in texts], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        trim()

    cut = there.select(*docs.columns, p, h).mapInArrow(run, docs.schema)
    return cut.unionByName(_only(tagged, windows.select(d, t), "left_anti", [d, t]).select(*docs.columns))
