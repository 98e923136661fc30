"""License scans: fuzzy search for short notices.

Texts are reduced to their lower-cased words joined by single spaces.  A notice
that may hold ``k`` edits is split into ``k + 1`` pieces; by the pigeonhole
principle one of them occurs exactly wherever the notice does, so an automaton
over all pieces locates the candidates, and the regex library's bounded-error
matching verifies each candidate's neighbourhood and reports its span and edits.
Beside it, places where the words of a base phrase stand consecutively are
counted exactly.

Null text counts as empty: no words, no labels, score 0.  Rows with equal ids or
texts are scanned alike and all kept.  ``first_word`` and ``last_word`` are null
where no base phrase stands.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import map_rows

#: Label and words of each base phrase.
BASE = (
    ("mit", (b"mit", b"license")),
    ("apache", (b"apache", b"license")),
    ("gpl", (b"general", b"public", b"license")),
)
#: Labels and wordings of the notices the fuzzy search knows.
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it"),
    ("gpl-notice", "under the terms of the gnu general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms"),
    ("bsd-notice", "licensed under the bsd license"),
    ("mpl-notice", "subject to the terms of the mozilla public license"),
    ("cc-notice", "licensed under a creative commons attribution"),
    ("cc-notice", "licensed under cc by"),
    ("gpl-notice", "licensed under the gnu general public license version"),
    ("spdx-notice", "spdx license identifier"),
    ("rights-notice", "all rights reserved"),
)
#: One edit is allowed for each so many characters of a notice.
CHARS_PER_EDIT = 12

_words = bytearray(b" " * 256)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        _words[_c] = _c
    elif 65 <= _c <= 90:
        _words[_c] = _c + 32
WORDS = bytes(_words)


def words_of(text: str) -> list[bytes]:
    """The text's words, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(WORDS).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, as (offset, piece)."""
    cuts = np.linspace(0, len(notice), edits + 2).astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Matcher:
    """The automaton over all pieces and the bounded-error pattern of each notice."""

    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(label, text, len(text) // chars_per_edit) for label, text in notices]
        pattern = lambda flag, text, k: regex.compile(r"%s\b(?:%s){e<=%d}\b" % (flag, regex.escape(text), k))
        # One finds places from left to right, the other the best match of a place.
        self.patterns = [(pattern("", text, k), pattern("(?b)", text, k)) for _, text, k in self.notices]
        seeds = defaultdict(list)
        for n, (_, text, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds[piece].append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def find(self, norm: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of every verified notice in a normalised text, by start; spans of one notice do not overlap."""
        windows = defaultdict(list)
        for end, (size, where) in self.auto.iter(norm):
            for n, at in where:
                start = end + 1 - size - at
                k = self.notices[n][2]
                windows[n].append((max(0, start - k), start + len(self.notices[n][1]) + k))
        found = []
        for n, spans in windows.items():
            label, text, k = self.notices[n]
            spans.sort()
            lo, hi = spans[0]
            merged = []
            for a, b in spans[1:]:
                if a <= hi:
                    hi = max(hi, b)
                else:
                    merged.append((lo, hi))
                    lo, hi = a, b
            merged.append((lo, hi))
            for a, b in merged:
                # Whole words, as the pattern asks for their ends.
                a, b = norm.rfind(" ", 0, a) + 1, norm.find(" ", min(b, len(norm)))
                b = len(norm) if b < 0 else b
                some, best = self.patterns[n]
                while m := some.search(norm, a, b):
                    m = best.search(norm, m.start(), min(b, m.end() + k)) or m
                    found.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(text)))
                    a = max(m.end(), m.start() + 1)
        return sorted(found)


@lru_cache(maxsize=1)
def matcher() -> Matcher:
    return Matcher()


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of a base phrase."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return out
        for label, phrase in BASE:
            k = len(phrase) - 1
            if at >= k and tuple(words[at - k : at + 1]) == phrase:
                out.append((at - k, label))


def scan_text(text: str) -> dict:
    words = words_of(text)
    norm = b" ".join(words).decode("utf-8", "replace")
    base = base_places(words)
    found = [(norm.count(" ", 0, a), norm.count(" ", 0, max(a, b - 1)) + 1, label, e, n) for a, b, label, e, n in matcher().find(norm)]
    starts = [i for i, _ in base]
    labels = {x for _, x in base} | {x for _, _, x, *_ in found}
    # An exact base phrase is certain; a notice is as certain as its share of characters without edit.
    best = max((1 - e / n for *_, e, n in found), default=0.0)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted(labels)),
        "score": 1.0 if base else max(0.0, best),
        "spans": [{"first": a, "end": b, "label": x, "edits": e} for a, b, x, e, _ in found],
    }


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<first: bigint, end: bigint, label: string, edits: bigint>>"
)


def _run(batches):
    for b in batches:
        rows = [scan_text(t or "") for t in b["text"]]
        yield {"doc_id": b["doc_id"]} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, labels, score and the notices' spans in words."""
    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _run, SCHEMA)
