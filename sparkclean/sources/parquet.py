"""Parquet in and out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, q
from sparkclean.operators.identity import file_row_id


def plain_path(uri: str) -> str:
    """The listing and the scan write local paths with a different number of slashes."""
    return re.sub("^file:/+", "file:/", uri)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read Parquet with a stable row id taken from (file, row position).

    The id is computed from file metadata in the scan: no shuffle, no window, the same
    on every run, and column pruning and filter push-down keep working. A table the
    engine wrote already carries its id and keeps it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    if ROW_ID in df.columns:
        return df
    files = sorted(plain_path(f) for f in df.inputFiles())
    position = F.col("_metadata.row_index")
    cols = [q(c) for c in df.columns]
    if len(files) <= 1:
        return df.select(position.alias(ROW_ID), *cols)
    # One small row per file; Spark broadcasts it by its known size when it fits.
    listing = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "_file string, _no long")
    return (
        df.select(
            F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_path"), position.alias("_pos"), *cols
        )
        .join(listing, F.col("_path") == F.col("_file"), "left")
        .select(
            F.when(F.col("_no").isNull(), F.raise_error(F.concat(F.lit("file not in listing: "), F.col("_path"))).cast("long"))
            .otherwise(file_row_id(F.col("_no"), F.col("_pos")))
            .alias(ROW_ID),
            *cols,
        )
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
