"""Workbooks (.xlsx) as a many-file source: every file is opened by one task, which reads
the cells of one sheet and emits rows; shaping afterwards is the same as for text."""

from __future__ import annotations

import io
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID
from sparkclean.operators.identity import file_row_id

# --- fixed values -----------------------------------------------------------------------
ZIP_MAGIC = b"PK\x03\x04"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# ------------------------------------------------------------------------------------------


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheet_member(book: zipfile.ZipFile, sheet: int | str) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    chosen = next(s for i, s in enumerate(sheets) if sheet in (i, s.get("name")))
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == chosen.get(DOC_REL))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root]


def sheet_rows(content: bytes, sheet: int | str = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells as text); skipped rows and cells are filled in."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_texts(book)
        with book.open(_sheet_member(book, sheet)) as xml:
            expected = 0
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{MAIN}row":
                    continue
                number = int(row.get("r", expected + 1)) - 1
                for blank in range(expected, number):
                    yield blank, []
                cells: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "true" if value.text == "1" else "false"
                    else:
                        text = value.text
                    cells.append(text)
                yield number, cells
                expected = number + 1
                row.clear()


def read_workbook_rows(spark: SparkSession, path: str | list[str], sheet: int | str = 0) -> DataFrame:
    """(_rid, path, row_no, cells) of one sheet of every workbook; row 0 is the header."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for number, cells in sheet_rows(content, sheet):
                    rows.append((name, number, cells))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    rows = files.mapInPandas(read, "path string, row_no bigint, cells array<string>")
    names = sorted(r["path"] for r in files.select("path").collect())
    listing = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, _no long")
    return rows.join(listing, "path").select(
        file_row_id(F.col("_no"), F.col("row_no")).alias(ROW_ID), "path", "row_no", "cells"
    )
