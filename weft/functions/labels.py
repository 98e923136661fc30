"""Scalar expressions over the wide lineage table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def current_node(prefix: str = "EDG") -> Column:
    """Levels 4 to 1 joined by dots, spaces trimmed: a level follows if it and its immediate parent are not empty.

    So an empty level 4 under levels 3 and 2 gives ``.level2``.
    """
    part = [F.trim(F.coalesce(F.col(f"{prefix}_{i}"), F.lit(""))) for i in (4, 3, 2, 1)]
    out = part[0]
    for above, level in zip(part, part[1:]):
        out = F.concat(out, F.when((above != "") & (level != ""), F.concat(F.lit("."), level)).otherwise(""))
    return out


#: Columns and lengths of the derived prefix keys.
PREFIXES = (("DTA_1_k", "DTA_1", 150), ("DTA_2_k", "DTA_2", 80), ("DTA_3_k", "DTA_3", 500), ("DTA_4_k", "DTA_4", 150))


def prefix_keys() -> dict[str, Column]:
    return {k: F.substring(c, 1, n) for k, c, n in PREFIXES}
