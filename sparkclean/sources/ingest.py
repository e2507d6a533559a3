"""Ingest: dirty file(s) -> Parquet table, quarantine and statistics; structural pre-check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID
from sparkclean.operators.guards import MAX_FILE_MB
from sparkclean.session import scratch_dir
from sparkclean.sources.delimited import MAX_RECORD_CHARS, read_records, split_cells
from sparkclean.sources.parquet import plain_path
from sparkclean.sources.shaping import IngestResult, shape_rows
from sparkclean.sources.workbook import ZIP_MAGIC, read_workbook_rows


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    out: str | None = None,
    sep: str = ",",
    line_sep: str = "\n",
    max_record_chars: int = MAX_RECORD_CHARS,
    header: list[str] | None = None,
) -> IngestResult:
    """Lenient delimited text: one file, or many files with the same header. Files without
    a header line (the usual output of a job) need ``header``."""
    out = out or scratch_dir(spark, "ingest")
    return shape_rows(csv_rows(spark, path, out, sep, line_sep, max_record_chars, header is None), out, header)


def csv_rows(
    spark: SparkSession,
    path: str | list[str],
    out: str,
    sep: str = ",",
    line_sep: str = "\n",
    max_record_chars: int = MAX_RECORD_CHARS,
    headed: bool = True,
) -> DataFrame:
    """The records of delimited files as cells: (_rid, row_no, cells, oversize). In files with a header line that line
    has ``row_no`` -1."""
    records = read_records(spark, path, f"{out}/_work", sep, line_sep, max_record_chars)
    cells = F.when(F.col("oversize"), F.array("record")).otherwise(split_cells(F.col("record"), sep))
    return records.select(ROW_ID, (F.col("record_no") - int(headed)).alias("row_no"), cells.alias("cells"), "oversize")


def read_workbook(
    spark: SparkSession, path: str | list[str], out: str | None = None, sheet: int | str = 0
) -> IngestResult:
    """One sheet of one workbook, or of many with the same header. Text keeps its blanks."""
    out = out or scratch_dir(spark, "ingest")
    rows = read_workbook_rows(spark, path, sheet).select(
        ROW_ID, (F.col("row_no") - 1).alias("row_no"), "cells", F.lit(False).alias("oversize")
    )
    return shape_rows(rows, out, blanks_to_null=False)


def ingest(spark: SparkSession, path: str, out: str | None = None, max_mb: int | None = None) -> IngestResult:
    """By suffix: ``.csv`` is text, anything else a workbook. ``max_mb`` refuses larger files."""
    if max_mb is not None:
        big = oversized_files(spark, path, max_mb).limit(1).collect()
        if big:
            raise ValueError(f"FILE_TOO_LARGE: {big[0]['path']} has {big[0]['length']} bytes, limit {max_mb} MB")
    reader = read_csv if path.lower().rstrip("/").endswith((".csv", "*.csv")) else read_workbook
    return reader(spark, path, out)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def oversized_files(spark: SparkSession, path: str, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """(path, length) above the limit; only the listing is read, no content."""
    return _listing(spark, path).where(F.col("length") > max_mb * 1024 * 1024).select("path", "length")


def precheck(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Structural problems: (path, row_ref, reason).

    ``csv``: empty files, lines with NUL bytes, lines that are not UTF-8; all lines are
    looked at, as bytes, in the scan. ``xlsx``: files without the archive signature.
    """
    if kind == "xlsx":
        head = F.substring(F.col("content"), 1, len(ZIP_MAGIC))
        return (
            _listing(spark, path)
            .where(head != F.lit(bytearray(ZIP_MAGIC)))
            .select("path", F.lit("file").alias("row_ref"), F.lit("Missing XLSX zip header (PK\\x03\\x04)").alias("reason"))
        )
    # a scan never visits empty files, so they are those of the listing that it did not see
    listed = [(plain_path(f),) for f in _listing(spark, path).inputFiles()]
    seen = _listing(spark, path).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    empty = spark.createDataFrame(listed, "path string").join(seen, "path", "left_anti").select(
        "path", F.lit("file").alias("row_ref"), F.lit("Empty CSV file").alias("reason")
    )
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.contains(F.col("value").cast("binary"), F.lit(bytearray(b"\x00"))).alias("nul"),
        (~F.is_valid_utf8("value")).alias("bad"),
    )
    # only the counts per split and the few bad lines are shuffled
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.groupBy("path", "split").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    hits = lines.where("nul OR bad").join(bases, ["path", "split"])
    ref = F.concat(F.lit("row "), F.col("base") + F.col("line") - F.col("first") + 1)
    found = [
        hits.where(flag).select("path", ref.alias("row_ref"), F.lit(text).alias("reason"))
        for flag, text in (
            ("nul", "Null byte detected in CSV row"),
            ("bad", "Non-UTF-8 characters detected in CSV row"),
        )
    ]
    return reduce(DataFrame.unionAll, [empty, *found])
