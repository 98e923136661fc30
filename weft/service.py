"""The facade: bounded, cached lookups and path searches over one graph."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.like import blank
from weft.operators import condense, lookup, traverse, weighted
from weft.session import Workspace

#: Life and number of cached results; algorithms and their default.
TTL_SECONDS, CACHE_ENTRIES = 300, 10_000
ALGORITHMS = ("bfs", "dijkstra", "dijkstra-bi", "astar")


class NotFound(LookupError):
    """No such node or path."""


class Cache:
    """Results for ``ttl`` seconds; the entry unused longest goes first."""

    def __init__(self, ttl: float = TTL_SECONDS, size: int = CACHE_ENTRIES, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.size, self.clock = ttl, size, clock
        self.held: OrderedDict = OrderedDict()

    def get(self, key, make: Callable[[], Any]) -> tuple[Any, bool]:
        """(value, whether it was held)."""
        now = self.clock()
        if key in self.held and self.held[key][0] > now:
            self.held.move_to_end(key)
            return self.held[key][1], True
        value = make()
        self.held[key] = (now + self.ttl, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value, False


@dataclass
class PathAnswer:
    path: list[str] = field(default_factory=list)
    found: bool = False
    cost: float | None = None
    skipped_by_scc: bool = False
    skipped_by_scan: bool = False
    from_cache: bool = False
    error: str | None = None


class LineageService:
    """Queries over a narrow edge table; verdict tables are used once ``scan`` and ``scan_strong`` made them."""

    def __init__(self, raw: DataFrame, cache: Cache | None = None):
        from weft.model import to_edges

        self.spark: SparkSession = raw.sparkSession
        self.space = Workspace(self.spark, "service")
        self.raw = raw
        self.cache = cache or Cache()
        self.weak = self.scc = self.dag = self.marks = None
        self.edges = self.space.write(to_edges(raw), "edges")

    def health(self) -> dict:
        return {"status": "ok", "source": not self.raw.limit(1).isEmpty()}

    def reload(self) -> None:
        from weft.model import to_edges

        self.edges = self.space.write(to_edges(self.raw), "edges")
        self.cache.held.clear()

    def scan(self) -> dict:
        """Weak components, precomputed."""
        self.weak = self.space.write(condense.weak_components(self.edges), "weak")
        return condense.component_summary(self.weak).first().asDict()

    def scan_strong(self) -> dict:
        """Strong components and the condensed graph, precomputed."""
        self.scc = self.space.write(condense.strong_components(self.edges), "scc")
        self.dag = self.space.write(condense.condensed_edges(self.edges, self.scc), "dag")
        return condense.component_summary(self.scc, "scc").first().asDict() | {"edges": self.dag.count()}

    def prepare_landmarks(self, count: int = weighted.LANDMARKS) -> int:
        self.marks = self.space.write(weighted.landmarks(self.edges, count), "landmarks")
        return self.marks.select("landmark").distinct().count()

    def stats(self) -> dict:
        return lookup.global_stats(self.edges).first().asDict()

    def search(self, q: str, limit: int = 20) -> list[str]:
        if not q:
            raise ValueError("a search needs a text")
        return [r["id"] for r in lookup.search_nodes(self.edges, q, limit).collect()]

    def nodes(self, page: int = 1, page_size: int = 50, q: str | None = None) -> dict:
        rows = lookup.list_nodes(self.edges, page, page_size, q).collect()
        total = rows[0]["total"] if rows else lookup.list_nodes(self.edges, 1, 1, q).agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
        return {"page": max(1, page), "page_size": max(1, min(page_size, lookup.MAX_PAGE)), "total": total, "nodes": [{"id": r["id"], "transformations": r["transformations"]} for r in rows]}

    def node(self, node: str) -> dict:
        found = lookup.node_detail(self.edges, node)
        if found is None:
            raise NotFound(node)
        rows = found.collect()
        side = lambda role: [{"id": r["id"], "transformation": r["transformation"]} for r in rows if r["role"] == role]
        return {"id": node, "predecessors": side("predecessor"), "successors": side("successor")}

    def neighborhood(self, node: str, depth: int = 1, limit: int = 500) -> dict:
        if not traverse.exists(self.edges, node):
            raise NotFound(node)
        nodes, edges, cut = traverse.neighborhood(self.edges, node, depth, limit)
        return {"nodes": sorted(r["id"] for r in nodes.collect()), "edges": sorted((r["src"], r["dst"]) for r in edges.collect()), "truncated": cut}

    def find_path(self, source: str | None, target: str | None, algo: str = "bfs", max_depth: int = traverse.DEFAULT_DEPTH) -> PathAnswer | None:
        """None without input; an error if one end is blank. Verdicts of the condensed graph, or else of the weak components, can spare the search; they never lengthen its bound."""
        if blank(source) and blank(target):
            return None
        if blank(source) or blank(target):
            return PathAnswer(error="both ends are needed")
        source, target = source.strip(), target.strip()
        algo = algo if algo in ALGORITHMS else "bfs"
        depth = max(1, min(max_depth, traverse.MAX_DEPTH))

        def make() -> PathAnswer:
            verdict = condense.reachable(self.scc, self.dag, source, target) if self.scc is not None else "Unavailable"
            if verdict == "Unreachable":
                return PathAnswer(skipped_by_scc=True)
            if verdict == "Unavailable" and condense.compare(self.weak, source, target) == "DifferentComponents":
                return PathAnswer(skipped_by_scan=True)
            if algo == "bfs":
                row = traverse.bidirectional_path(self.edges, source, target, depth, traverse.VISITED_IN_MEMORY).first()
            elif algo == "dijkstra":
                row = weighted.dijkstra(self.edges, source, target, depth).first()
            elif algo == "astar":
                row = weighted.a_star(self.edges, source, target, self.marks, depth).first()
            else:
                met = weighted.bidirectional_dijkstra(self.edges, source, target, depth, per_side=True).first()
                row = weighted.dijkstra(self.edges, source, target, met["cost"]).first() if met["found"] else None
            if not row or not row["found"]:
                return PathAnswer()
            return PathAnswer(list(row["path"]), True, float(len(row["path"]) - 1) if "cost" not in row else row["cost"])

        answer, held = self.cache.get(f"path:{algo}:{source}:{target}:{depth}", make)
        return PathAnswer(**{**answer.__dict__, "from_cache": held})

    def describe(self, path: list[str]) -> list[dict]:
        rows = traverse.describe_path(traverse.path_row(self.spark, path), self.raw).orderBy("index").collect()
        return [r.asDict() for r in rows]
