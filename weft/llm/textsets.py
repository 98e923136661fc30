"""Word shingles of texts as sets of 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weft.llm.common import U64, byte_codes, mix64

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
CODES = byte_codes(0x51ED270B)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are joined to blocks of about so many bytes.
BLOCK = 1 << 18

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1024)
        up, down = np.full(size, BASE, U64), np.full(size, INVERSE, U64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _powers["up"], _powers["down"]


def prefix(a: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """s with s[i] = sum of code(a[j]) BASE**-j over j < i; (s[e] - s[b]) BASE**b is a hash of a[b:e]."""
    _, down = powers(len(a) + 1)
    s = np.empty(len(a) + 1, U64)
    s[0] = 0
    np.cumsum(codes[a] * down[: len(a)], dtype=U64, out=s[1:])
    return s


def slices(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` bytes in all."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the number of words of each text."""
    buf = b" ".join(texts).translate(LOWER)
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    word = IS_WORD[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    if word[-1]:
        edge = np.concatenate([edge, [len(a)]])
    b, e = edge[0::2], edge[1::2]
    up, _ = powers(len(a) + 1)
    s = prefix(a)
    h = mix64((s[e] - s[b]) * up[b] + (e - b).astype(U64))
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    return h, np.diff(np.searchsorted(b, np.concatenate([[0], ends])))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * U64(0xD6E8FEB86659FD93) + U64(i + 1)
    return mix64(out)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than ``k`` words has them all as one, a text without words has none."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    for i, j in slices(raw):
        h, counts = word_hashes(raw[i:j])
        s = shingle_hashes(h, k)
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(s[at : at + n - k + 1])
            elif n:
                short = U64(n)
                for x in h[at : at + n]:
                    short = mix64(np.array([short ^ x], U64) * U64(0xD6E8FEB86659FD93) + U64(77))[0]
                yield np.array([short], U64)
            else:
                yield np.zeros(0, U64)
            at += n
