"""Sectioned text graphs: a section of nodes, one on a line, and a section of edges, two words on a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.session import Workspace

#: Section names, in lower case.
NODE_SECTIONS = ("noeuds", "nœuds", "nodes")
EDGE_SECTIONS = ("aretes", "arêtes", "edges")
#: Line ends: of the strict reader, and of the lenient one.
ALL_BREAKS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"
PLAIN_BREAKS = "\\r?\\n"
#: Lines of a piece of a split, as a power of two.
PIECE = 17


class GraphTextError(ValueError):
    """The text is no graph; the message says where."""


def _marked(lines: DataFrame) -> DataFrame:
    """``lines`` trimmed, and the section that a header opens."""
    trimmed = lines.withColumn("line", F.trim(F.regexp_replace("line", "^\\s+|\\s+$", "")))
    low = F.lower("line")
    return trimmed.withColumn("head", F.when(low.isin(*NODE_SECTIONS), "nodes").when(low.isin(*EDGE_SECTIONS), "edges"))


def _told(marked: DataFrame) -> DataFrame:
    """Without blank lines and comments."""
    return marked.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _lines(texts: DataFrame, breaks: str) -> DataFrame:
    """(file, line_no, section, line) of all lines that are neither blank, nor comments, nor headers."""
    kept = _told(_marked(texts.select("file", F.posexplode(F.split("text", breaks)).alias("line_no", "line"))))
    # The section of a line is the last header before it in its file.
    section = F.last("head", ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("section", section).where(F.col("head").isNull()).drop("head")


def _split_lines(spark: SparkSession, path: str, breaks: str, space: Workspace) -> DataFrame:
    """As ``_lines``, of the text files at ``path``, each read by as many tasks as it has splits.

    A task numbers the lines it reads, and those of a split fall into pieces of at
    most ``2 ** PIECE`` lines. One row for each piece, its number of lines and its last
    header, then tells where the next one starts: after how many lines, and in which
    section. Only pieces that hold a header are sorted.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("value"))
    # Lines may hold further breaks, so they are numbered after those; a task reads its splits one after the other.
    cut = rows.select("file", "start", F.explode(F.split("value", breaks)).alias("line")).withColumn("row", F.monotonically_increasing_id())
    key = ["file", "start", "piece"]
    cut = space.write(_marked(cut), "lines").withColumn("piece", F.shiftright("row", PIECE))
    # The last header as one number: its row, and whether it opens the edges.
    last = F.max(F.when(F.col("head").isNotNull(), 2 * F.col("row") + (F.col("head") == "edges").cast("bigint"))).alias("last")
    sizes = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), last)
    sizes = sizes.withColumn("last", F.when(F.col("last") % 2 == 1, "edges").when(F.col("last") % 2 == 0, "nodes"))
    before = Window.partitionBy("file").orderBy("start", "piece").rowsBetween(Window.unboundedPreceding, -1)
    base, opened = F.coalesce(F.sum("n").over(before), F.lit(0)), F.last("last", ignorenulls=True).over(before)
    pieces = space.write(sizes.select(*key, (base - F.col("first")).alias("shift"), opened.alias("section"), F.col("last").isNotNull().alias("headed")), "pieces")
    told = _told(cut).join(F.broadcast(pieces), key)
    there = F.last("head", ignorenulls=True).over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    headed = told.where("headed").withColumn("section", F.coalesce(there, "section")).where(F.col("head").isNull())
    return told.where("not headed").unionByName(headed).select("file", (F.col("shift") + F.col("row")).cast("int").alias("line_no"), "section", "line")


def parse(texts: DataFrame, dedupe: bool = True, breaks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, id, pos) and edges (file, src, dst, pos) of texts (file, text); ``pos`` is the first line that names them.

    Content before a header, an edge line of fewer than two words, and a text
    without nodes are errors. Edges name nodes. ``dedupe=False`` keeps parallel
    edges and breaks lines at line feeds only.
    """
    return _graphs(_lines(texts, breaks or (ALL_BREAKS if dedupe else PLAIN_BREAKS)), texts.select("file"), dedupe)


def _graphs(rows: DataFrame, files: DataFrame, dedupe: bool) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("words", F.split("line", "\\s+"))
    wrong = rows.where(F.col("section").isNull() | ((F.col("section") == "edges") & (F.size("words") < 2))).orderBy("file", "line_no").select("section", "line_no").first()
    if wrong:
        what = "content outside a section" if wrong["section"] is None else "an edge needs two nodes"
        raise GraphTextError(f"line {wrong['line_no'] + 1}: {what}")
    found = rows.where(F.col("section") == "edges").select("file", F.col("words")[0].alias("src"), F.col("words")[1].alias("dst"), F.col("line_no").alias("pos"))
    edges = found.groupBy("file", "src", "dst").agg(F.min("pos").alias("pos")) if dedupe else found
    named = rows.where(F.col("section") == "nodes").select("file", F.col("line").alias("id"), (2 * F.col("line_no")).alias("pos"))
    ends = found.select("file", F.posexplode(F.array("src", "dst")).alias("k", "id"), "pos").select("file", "id", (2 * F.col("pos") + F.col("k")).alias("pos"))
    nodes = named.union(ends).groupBy("file", "id").agg(F.min("pos").alias("pos"))
    # Any row left is a node or names two.
    empty = files.join(rows.select("file").distinct(), "file", "left_anti").limit(1).collect()
    if empty:
        raise GraphTextError("the graph has no nodes")
    return nodes, edges


def parse_text(spark: SparkSession, text: str, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    nodes, edges = parse(spark.createDataFrame([("", text)], "file string, text string"), dedupe)
    return nodes.drop("file"), edges.drop("file")


def read(spark: SparkSession, path: str, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """Graphs of all UTF-8 text files at ``path``."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text")), dedupe)


def read_split(spark: SparkSession, path: str, dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``read``, for files of any size: each is read by many tasks, and nothing depends on where it is split."""
    space = Workspace(spark, "text")
    rows = space.write(_split_lines(spark, path, ALL_BREAKS if dedupe else PLAIN_BREAKS, space), "told")
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")
    return _graphs(rows, files, dedupe)
