"""Structured Streaming: new files, guards on arriving cells, a quality gate per batch."""

from __future__ import annotations

from typing import Any, Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.functions.text import (
    WHITESPACE,
    bind,
    fold_native,
    has_instruction,
    needs_fold,
    neutralise_formula,
    nfkc,
    redact_pii,
)
from sparkclean.operators.base import ROW_ID, q
from sparkclean.operators.catalogue import get_op
from sparkclean.operators.checks import Check, run_checks
from sparkclean.operators.guards import text_columns
from sparkclean.operators.identity import FILE_BITS
from sparkclean.session import scratch_dir
from sparkclean.sources.ingest import csv_rows
from sparkclean.sources.shaping import clean_header, header_width, shape_rows, unique_names

# Operations whose result for one row needs no other row.
ROW_LOCAL = ("replace_value", "fill_missing", "cast_type", "standardise_format", "derive_column", "drop_column")


def read_new_files(spark: SparkSession, folder: str, schema=None, fmt: str = "parquet", **options) -> DataFrame:
    """File stream; the checkpoint remembers which files were taken, so each file is
    ingested exactly once and a restart needs no list of names."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(folder)


def guard_cells(df: DataFrame) -> DataFrame:
    """Stateless guards on every text column: personal data masked, formulas made inert,
    and ``flagged_columns`` naming the columns that hold instruction-like text."""
    texts = text_columns(df)
    flags = []
    for c in texts:
        folded = fold_native(q(c))
        unsure = bind(folded, lambda f: F.when(needs_fold(f), f))
        native = bind(folded, lambda f: ~needs_fold(f) & has_instruction(f))
        flags.append(F.when(native | has_instruction(nfkc(unsure)), F.lit(c)))
    flagged = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    out = df.withColumn("flagged_columns", flagged)
    return out.select(*[
        neutralise_formula(redact_pii(q(c))).alias(c) if c in texts else q(c) for c in out.columns
    ])


def clean_stream(df: DataFrame, steps: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Apply row-local catalogue steps; the same code as on a batch table."""
    for name, params in steps:
        if name not in ROW_LOCAL:
            raise ValueError(f"'{name}' needs more than one row and cannot run on a stream")
        df = get_op(name).apply(df, params)
    return df


def quality_gate(checks: list[Check], good: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a batch that passes all checks goes to ``good``, else to
    ``rejected``. One directory per batch id, overwritten on replay, so a batch that is
    retried after a failure is not stored twice."""

    def route(batch: DataFrame, batch_id: int) -> None:
        results = run_checks(checks, batch)
        target, other = (good, rejected) if all(r.passed for r in results) else (rejected, good)
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        stale = f"{other}/batch_id={batch_id}"  # an earlier attempt may have judged otherwise
        try:
            before = batch.sparkSession.read.parquet(stale)
        except AnalysisException:
            return
        before.limit(0).write.mode("overwrite").parquet(stale)

    return route


OTHER_HEADER = "The file has another header"


def ingest_text_stream(
    spark: SparkSession,
    folder: str,
    header: list[str],
    out: str,
    checkpoint: str,
    sep: str = ",",
    files_per_trigger: int | None = None,
    **trigger,
):
    """Follow a folder of delimited files that share a known header.

    The stream lists the new files; each batch frames its files whole, so cells with line breaks stay whole, the header
    is the first record of a file and no other, and malformed rows keep their place. Every file gets a verdict from its
    own header: ``taken`` or ``refused`` (a file of no bytes gets none, since no scan visits it). The rows of taken files go to ``out/table`` and
    ``out/quarantine``; a refused file goes to ``out/quarantine`` as a whole, its header included, and the stream goes
    on. ``out/files`` holds (file, records, verdict). Each has one directory per batch; the checkpoint gives a replayed
    batch the same files, so it overwrites its own rows and nothing is stored twice.
    """
    width = header_width(header)
    names, _ = unique_names([clean_header(h) for h in header[:width]])
    if any(h is None or not h.strip(WHITESPACE) for h in header[:width]):
        raise ValueError("a stream needs a name for each column")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if files_per_trigger:
        files = files.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        paths = sorted(r["path"] for r in batch.collect())  # names only, as many as one trigger takes
        if not paths:
            return
        work = scratch_dir(session, "stream")
        csv_rows(session, paths, work, sep).withColumn("file_no", F.shiftright(ROW_ID, FILE_BITS)).write.parquet(f"{work}/rows")
        rows = session.read.parquet(f"{work}/rows")
        listing = F.array(*[F.element_at(F.split(F.lit(p), "/"), -1) for p in paths])
        name_of = lambda number: F.get(listing, number.cast("int"))

        heads = rows.where("row_no = -1 AND NOT oversize").select("file_no", "cells").collect()  # a row per file of the batch
        taken = [h["file_no"] for h in heads if _same_header(h["cells"], names)]
        is_taken = F.array_contains(F.lit(taken).cast("array<bigint>"), F.col("file_no"))
        rows.groupBy("file_no").agg(F.count(F.lit(1)).alias("records")).select(
            name_of(F.col("file_no")).alias("file"), "records", F.when(is_taken, "taken").otherwise("refused").alias("verdict")
        ).write.mode("overwrite").parquet(f"{out}/files/batch_id={batch_id}")

        r = shape_rows(rows.where(is_taken).drop("file_no"), f"{work}/taken", header[:width])
        file = name_of(F.shiftright(ROW_ID, FILE_BITS)).alias("file")
        r.table.select(file, *map(q, names)).write.mode("overwrite").parquet(f"{out}/table/batch_id={batch_id}")
        refused = rows.where(~is_taken).select(
            file,
            F.concat(F.lit("row "), F.col("row_no") + 2).alias("row_ref"),
            F.lit(OTHER_HEADER).alias("reason"),
            F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"),
        )
        r.quarantined.select(file, "row_ref", "reason", "cells").unionByName(refused).write.mode("overwrite").parquet(
            f"{out}/quarantine/batch_id={batch_id}"
        )

    return (
        files.load(folder).select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _same_header(cells: list[str | None], names: list[str]) -> bool:
    found = cells[: header_width(cells)]
    return unique_names([clean_header(c or "") for c in found])[0] == names
