"""A batch data source for .xlsx workbooks: the first sheet's rows as arrays of strings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class WorkbookError(ValueError):
    """The bytes are no workbook, or it has no sheet."""


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def first_sheet(data: bytes) -> list[list[str]]:
    """Rows of the first sheet as text; missing cells are empty, blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheet = book.find(f"{SHEET}sheets/{SHEET}sheet")
        if sheet is None:
            raise WorkbookError("the workbook has no sheet")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(f"{REL}id"))
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = []
        for row in ElementTree.fromstring(z.read(path)).iter(f"{SHEET}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row):
                kind, v = c.get("t"), c.find(f"{SHEET}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                else:
                    text = (v.text or "") if v is not None else ""
                    text = shared[int(text)] if kind == "s" and text else text
                cells[_column(c.get("r")) if c.get("r") else i] = text
            if any(v.strip() for v in cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        return rows


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for n, row in enumerate(first_sheet(f.read())):
                yield n, row


class XlsxDataSource(DataSource):
    """``spark.read.format("weft_xlsx").load(path)``: (row_no, cells) of a workbook that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "weft_xlsx"

    def schema(self) -> str:
        return "row_no bigint, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, cells) of all workbooks at ``path``, opened by Spark's own file reader."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(frames):
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                sheet = first_sheet(content)
                yield pd.DataFrame({"file": [path] * len(sheet), "row_no": range(len(sheet)), "cells": sheet})

    return files.mapInPandas(rows, "file string, row_no bigint, cells array<string>")
