"""Benchmark decontamination: a generalised suffix automaton of the test items' words.

Items and documents are reduced to their words, A-Z lower-cased.  The automaton
accepts every run of words that stands inside an item.  A document's words are
streamed through it; after each word the state tells the longest run ending there
that some item holds.  Where that length reaches ``window`` the last ``window``
words are a window of an item; an item of fewer words is one window as a whole and is
told by the suffix links.  Words that no item holds end every match, so stretches of
known words shorter than the shortest window are passed over.

Items longer than ``PIECE`` words are cut into pieces that share ``window - 1``
words, which hold the same windows.  Pieces are dealt to blocks of about
``BLOCK_WORDS`` words; one block at a time is collected, after its words were counted,
and sent to the tasks, which add their hits to those of the blocks before.  Nothing
is shuffled.

Null text has no words.  Items without words have no windows.  An item without id
marks words, but is neither counted nor listed; rows that repeat an id are one item
with the windows of all their texts.  Documents are scanned row by row, so rows with
equal ids or texts all stay, and further columns are left out.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import Workspace, map_rows
from weft.llm.license_scan import words_of

#: Consecutive item words that make a window.
WINDOW = 10
#: Words of an automaton, of a piece of an item.
BLOCK_WORDS, PIECE = 100_000, 5_000
#: A document keeps its text without the hit spans up to this share of hit words, and goes beyond it.
MAX_COVERAGE = 0.5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """States are sets of word runs with equal ends; ``link`` leads to the longest proper suffix in another state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        self.texts: list[tuple[str | None, list[int]]] = []

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the runs of ``q`` that are one word longer than ``p``'s."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier item holds this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, item: str | None, words: list[bytes]) -> None:
        ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        self.texts.append((item, ids))

    def finish(self) -> SuffixAutomaton:
        """Mark the states of windows with their items; call once, after the last item."""
        n, k = len(self.length), self.window
        order = np.argsort(self.length, kind="stable").tolist()
        # The suffix of ``window`` words of a state's runs, and the nearest suffix that is a short item.
        self.top, self.short = list(range(n)), [-1] * n
        self.items: list[set] = [set() for _ in range(n)]
        self.whole: dict[int, dict[int, set]] = {}
        for item, ids in self.texts:
            s = 0
            for i, w in enumerate(ids):
                s = self.next[s][w]
                while self.length[self.link[s]] >= k:
                    s = self.link[s]
                if i + 1 >= k:
                    self.items[s].add(item)
            if 0 < len(ids) < k:
                self.whole.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        for s in order[1:]:
            up = self.link[s]
            if self.length[up] >= k:
                self.top[s] = self.top[up]
            self.short[s] = s if s in self.whole else self.short[up]
        self.least = min([min(len(ids), k) for _, ids in self.texts if ids], default=0)
        return self

    def _shorts(self, s: int, length: int) -> Iterator[tuple[int, set]]:
        s = self.short[s]
        while s >= 0:
            for m, items in self.whole[s].items():
                if m <= length:
                    yield m, items
            s = self.short[self.link[s]] if self.link[s] >= 0 else -1

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], set]:
        """Spans (first word, word past the last, longest matching run) in order, and the items of the windows found."""
        spans: list[list[int]] = []
        found: set = set()
        if not self.least or len(words) < self.least:
            return [], found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        begin, end = edge[0::2], edge[1::2]
        long = end - begin >= self.least
        follow, link, lengths, k = self.next, self.link, self.length, self.window
        for b, e in zip(begin[long].tolist(), end[long].tolist()):
            s = length = 0
            for i, w in enumerate(ids[b:e].tolist(), b + 1):
                to = follow[s].get(w)
                while to is None:
                    s = link[s]
                    length = lengths[s]
                    to = follow[s].get(w)
                s, length = to, length + 1
                size = 0
                if length >= k:
                    size = k
                    found |= self.items[self.top[s]]
                if self.short[s] >= 0:
                    for m, items in self._shorts(s, length):
                        size = max(size, m)
                        found |= items
                if size:
                    if spans and i - size <= spans[-1][1]:
                        last = spans[-1]
                        last[0], last[1], last[2] = min(last[0], i - size), i, max(last[2], length)
                        while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                            a, _, c = spans.pop(-2)
                            spans[-1][0], spans[-1][2] = min(a, spans[-1][0]), max(c, spans[-1][2])
                    else:
                        spans.append([i - size, i, length])
        return [tuple(x) for x in spans], found


def merged(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The union of two lists of spans; spans that touch become one."""
    out: list[list[int]] = []
    for first, end, longest in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], end), max(out[-1][2], longest)
        else:
            out.append([first, end, longest])
    return [tuple(x) for x in out]


SPANS = "array<struct<first: bigint, end: bigint, longest: bigint>>"
#: The automaton of the last block, in each Python worker.
_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, block: list[tuple[str | None, list[str]]], window: int) -> SuffixAutomaton:
    if key not in _built:
        _built.clear()
        made = SuffixAutomaton(window)
        for item, words in block:
            made.add(item, [w.encode("utf-8", "replace") for w in words])
        _built[key] = made.finish()
    return _built[key]


def item_pieces(items: DataFrame, window: int, piece: int) -> DataFrame:
    """(item, words): distinct pieces of at most ``piece`` words that hold all windows of the items."""
    step = max(piece - window + 1, 1)

    def run(batches):
        for b in batches:
            out = {"item": [], "words": []}
            for item, text in zip(b["item"], b["text"]):
                words = [w.decode("utf-8", "replace") for w in words_of(text or "")]
                for at in range(0, max(len(words) - window + 1, 1), step):
                    if cut := words[at : at + step + window - 1]:
                        out["item"].append(item)
                        out["words"].append(cut)
            yield out

    return map_rows(items.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, words array<string>").distinct()


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, piece: int = PIECE, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(key columns, text, n_words, items, spans) of each document row: sorted ids of the items found, and the spans in words."""
    space = Workspace(docs.sparkSession, "automaton")
    pieces = space.write(item_pieces(items, window, piece), "pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // block_words))
    dealt = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    out = docs.select(*key, "text").withColumns({"n_words": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>"), "spans": F.array().cast(SPANS)})
    schema = T.StructType([docs.schema[c] for c in key] + T._parse_datatype_string(f"text string, n_words bigint, items array<string>, spans {SPANS}").fields)
    for b in range(n):
        block = [(r["item"], r["words"]) for r in pieces.where(dealt == b).collect()]
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            for rows in batches:
                known = _automaton(name, sent.value, window)
                result = {c: rows[c] for c in (*key, "text")} | {"n_words": [], "items": [], "spans": []}
                for text, old_items, old_spans in zip(rows["text"], rows["items"], rows["spans"]):
                    words = words_of(text or "")
                    spans, found = known.find(words)
                    result["n_words"].append(len(words))
                    result["items"].append(sorted({*old_items, *(x for x in found if x is not None)}) if found else old_items)
                    before = [(x["first"], x["end"], x["longest"]) for x in old_spans]
                    result["spans"].append([dict(zip(("first", "end", "longest"), x)) for x in (merged(before, spans) if before else spans)])
                yield result

        out = map_rows(out, run, schema)
        if b + 1 < n:
            before, out = out, space.write(out, f"block{b}")
            space.drop(before)
    return out


def hits() -> Column:
    """Words inside any span."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document row."""
    found = scan(docs, items, window, block_words)
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", hits().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them; a space stays where text stood on both sides."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return " ".join(p for p in (x.strip(" ") for x in out) if p) if spans else text


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the spans cut out whose longest run has ``longest`` words or more (all spans of short items too).

    A document of which more than ``max_coverage`` of the words lie in spans goes
    altogether.  Other columns stay as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    # Further columns travel as one struct, so that none clashes with the scan's.
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("doc"), "text")
    marked = scan(held, items, window, block_words, key=("doc",)).where(hits() <= F.lit(max_coverage) * F.col("n_words"))

    def run(batches):
        for b in batches:
            text = []
            for t, cuts in zip(b["text"], b["spans"]):
                cut = [(x["first"], x["end"]) for x in cuts if x["longest"] >= longest or x["longest"] < window]
                text.append(without(t, cut) if t and cut else t)
            yield {"doc": b["doc"], "text": text}

    clean = map_rows(marked.select("doc", "text", "spans"), run, T.StructType([held.schema["doc"], T.StructField("text", T.StringType())]))
    return clean.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
