"""Draw a graph text: ``python -m weft.cli graph.txt drawing.svg`` or ``drawing.html``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from weft.operators import layout, lookup, render
from weft.sources import text


def draw(spark: SparkSession, source: str, target: str, circular: bool = False) -> dict:
    """Read a graph text, lay it out, write the drawing, and return its counts."""
    nodes, edges = text.read(spark, source)
    nodes, edges = nodes.drop("file"), edges.drop("file")
    if circular or not lookup.looks_layerable(edges, nodes).first()["layerable"]:
        at, scale = layout.circular_positions(edges, nodes), 1.0
    else:
        at, scale = layout.layered_positions(layout.layers(nodes, edges)), 80.0
    title = os.path.splitext(os.path.basename(source))[0]
    page = target.lower().endswith((".html", ".htm"))
    render.save(render.page(title, at, edges, scale=scale) if page else render.svg(at, edges, scale=scale), target)
    return {"nodes": nodes.count(), "edges": edges.count(), "file": target}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--circular", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("weft").getOrCreate()
    print(draw(spark, given.source, given.target, given.circular))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
