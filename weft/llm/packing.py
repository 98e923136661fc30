"""Packing: order-preserving dynamic programming over window cuts.

Documents keep their order.  Their tokens, each document closed by id 0, form a
stream that is cut into windows of at most ``window`` tokens.  Cuts may stand at
document ends, at sentence ends and, in sentences longer than ``STRIDE`` tokens,
at every ``STRIDE``-th token; a cut inside a document costs a penalty in tokens.
A window of n tokens costs its padding: ``window - n``, or nothing if n is a
power of two.  The cheapest series of cuts satisfies

    f(j) = penalty(j) + min over i with p(j) - p(i) <= window of f(i) + padding(p(j) - p(i))

The linear part of the padding makes the minimum a sliding-window minimum of
f(i) + p(i), kept in a monotone queue; the powers of two are looked up one by one.

A task packs the documents of its partition, in blocks of about ``BLOCK`` tokens
that end with a document, so memory is bounded and nothing is shuffled.  A
sequence id is the partition's number times 2^40 plus a counter.

Null text counts as empty: the document is its closing id alone.  Rows with
equal ids are separate documents.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import map_rows

WINDOW = 1024
#: Costs in tokens of a cut at a sentence end, and of any other cut inside a document.
SENTENCE, HARD = 8, 64
#: Longest distance between places for a cut.
STRIDE = 64
#: Tokens of a block, about.
BLOCK = 1 << 18
END = 0


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False):
    """(function from text to ids, ends of sentences by id) of a byte-level vocabulary.

    ``path`` names a tokenizers file.  If ranks lie beside it that hold the same
    vocabulary, piece by piece, they give the same ids in a quarter of the time;
    else the file itself is used.  Strings of added tokens in a text are ordinary text,
    or with ``added`` those tokens, as the tokenizer has them by default; texts that
    hold such a string then go through the file.
    """
    import os

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not added
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    size = tok.get_vocab_size()
    # An id ends a sentence if its bytes hold a line end or begin with a mark that ends one.
    ends = np.zeros(size, bool)
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        ends[i] = "Ċ" in piece or piece[:1] in ".!?"
    whole = lambda text: tok.encode(text, add_special_tokens=False).ids
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        shown = byte_letters()
        vocab = tok.get_vocab(with_added_tokens=False)
        if all(vocab.get("".join(map(shown.__getitem__, piece))) == i for piece, i in ranks.items()):
            enc = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            marks = [t.content for t in tok.get_added_tokens_decoder().values()] if added else []
            if not marks:
                return enc.encode_ordinary, ends
            return (lambda text: whole(text) if any(m in text for m in marks) else enc.encode_ordinary(text)), ends
    return whole, ends


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies show for each byte: printable Latin-1 bytes themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return [out.get(b) or chr(256 + b - sum(p < b for p in plain)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_places(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts inside and at the end of a document (tokens before the cut), and their penalties."""
    n = len(ids)
    at = np.flatnonzero(ends[ids[:-1]]) + 1
    # Of neighbouring ends (a mark, then a line end) the last counts.
    if len(at):
        at = at[np.append(at[1:] - at[:-1] > 1, True)]
    at = at[at < n]
    edges = np.concatenate([[0], at, [n]])
    gaps = edges[1:] - edges[:-1]
    if gaps.max() <= stride:
        places, cost = edges[1:], np.full(len(edges) - 1, SENTENCE)
    else:
        places, cost = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            hard = np.arange(a + stride, b, stride)
            places += [*hard, b]
            cost += [HARD] * len(hard) + [SENTENCE]
        places, cost = np.array(places), np.array(cost)
    cost[-1] = 0
    return places, cost


def best_cuts(places: list[int], cost: list[int], window: int = WINDOW) -> list[int]:
    """Indices of the chosen places, the last place included; places ascend from above 0, at most ``window`` apart."""
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    where = {0: -1}
    f, back = [], []
    queue = deque([(0, 0, -1)])  # (f + place, place, index), ascending in the first and the second
    known = {0: 0}
    for j, p in enumerate(places):
        low = p - window
        while queue[0][1] < low:
            queue.popleft()
        g, _, i = queue[0]
        best = g + window - p
        for size in powers:
            v = known.get(p - size)
            if v is not None and v < best:
                best, i = v, where[p - size]
        best += cost[j]
        f.append(best)
        back.append(i)
        known[p], where[p] = best, j
        g = best + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, p, j))
    out, j = [], len(places) - 1
    while j >= 0:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Packs blocks of documents and emits their pieces."""

    def __init__(self, base: int, window: int = WINDOW):
        self.seq, self.window = base, window
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.places: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        places, cost = cut_places(ids, ends, min(STRIDE, self.window))
        self.docs.append((doc_id, ids))
        self.places.append(places + self.size)
        self.cost.append(cost)
        self.size += len(ids)

    def flush(self) -> dict[str, list]:
        """Pieces of all added documents, as columns."""
        out: dict[str, list] = {n: [] for n in COLUMNS}
        if self.docs:
            places = np.concatenate(self.places).tolist()
            chosen = best_cuts(places, np.concatenate(self.cost).tolist(), self.window)
            cuts = deque(places[i] for i in chosen)
            began = at = 0  # of the sequence and of the document, in tokens of the block
            add = [out[n].append for n in COLUMNS]
            for doc_id, ids in self.docs:
                start, n = 0, len(ids)
                while start < n:
                    end = min(n, cuts[0] - at)
                    part = ids[start:end]
                    for put, value in zip(add, (doc_id, start, end - start, crc32(part.tobytes()), n, self.seq, at + start - began)):
                        put(value)
                    start = end
                    if at + end == cuts[0]:
                        began = cuts.popleft()
                        self.seq += 1
                at += n
        self.docs, self.places, self.cost, self.size = [], [], [], 0
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, added: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``added`` as in ``encoder``."""

    def run(batches):
        from pyspark import TaskContext

        encode, ends = encoder(tokenizer or default_path(), added)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = encode(text) if text else []
                packer.add(doc_id, np.array([*ids, END], np.uint32), ends)
                if packer.size >= BLOCK:
                    yield packer.flush()
        yield packer.flush()

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, ", ".join(f"{n} bigint" for n in COLUMNS))
