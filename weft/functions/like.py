"""LIKE patterns with % _ [class] [^class], case-insensitive, without an escape character."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_regex(pattern: str) -> str:
    """A regular expression for a whole string that matches what the pattern matches."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and end > i + 1:
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]" if body else "")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", c))
        i += 1
    return "(?isu)^" + "".join(out) + "$"


def like(column: Column, pattern: str) -> Column:
    """``column`` LIKE ``pattern``; plain prefixes, suffixes and substrings avoid regular expressions."""
    core = pattern.strip("%")
    if not set(core) & set("%_["):
        low, text = F.lower(column), F.lit(core.lower())
        head, tail = pattern.startswith("%"), pattern.endswith("%")
        if not core and pattern:
            return column.isNotNull()
        if head and tail:
            return F.contains(low, text)
        if tail:
            return F.startswith(low, text)
        return F.endswith(low, text) if head else low == text
    return column.rlike(like_regex(pattern))


def contains_like(column: Column, text: str) -> Column:
    """``column`` LIKE '%' + text + '%': wildcards inside ``text`` stay wildcards."""
    return like(column, f"%{text}%")


def blank(value: str | None) -> bool:
    """Whether a parameter counts as not given: null, empty or spaces only."""
    return value is None or not value.strip(" ")
