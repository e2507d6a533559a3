"""Table-level guards: find instruction-like cells, neutralise formulas, size limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.text import (
    bind,
    fold_native,
    instruction_match,
    needs_fold,
    neutralise_formula,
    nfkc,
)
from sparkclean.operators.base import ROW_ID, q

# --- fixed values -----------------------------------------------------------------------
PREVIEW_CHARS = 60
MATCH_CHARS = 40
MAX_FILE_MB = 50
REASON = "Looks like an instruction to an AI model: '"
# ------------------------------------------------------------------------------------------


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW_ID]


def flagged_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every cell that reads like an instruction: (ordinal, column, row, value_preview, reason).

    One scan. The native pattern decides almost all cells; a cell with characters that
    only full Unicode folding can judge keeps its text one step longer, and only the rows
    that still matter after that filter reach Python.
    """
    names = columns if columns is not None else text_columns(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, column string, row bigint, value_preview string, reason string"
        )
    ordinal = {n: i for i, n in enumerate(c for c in df.columns if c != ROW_ID)}

    def judge(folded: Column) -> Column:
        """(hit, fold), NULL for the many cells that are decided as harmless."""
        hit, fold = instruction_match(folded), F.when(needs_fold(folded), folded)
        return bind(
            F.struct(hit.alias("hit"), fold.alias("fold")),
            lambda j: F.when(j["hit"].isNotNull() | j["fold"].isNotNull(), j),
        )

    narrow = df.select(
        F.col(ROW_ID).alias("row"),
        *[F.substring(q(n), 1, PREVIEW_CHARS).alias(f"preview_{i}") for i, n in enumerate(names)],
        *[bind(fold_native(q(n)), judge).alias(f"judged_{i}") for i, n in enumerate(names)],
    )
    narrow = narrow.where(reduce(Column.__or__, [F.col(f"judged_{i}").isNotNull() for i in range(len(names))]))
    for i in range(len(names)):
        narrow = narrow.withColumn(f"exact_{i}", nfkc(F.col(f"judged_{i}.fold")))
    found = F.array(*[
        F.struct(
            F.lit(ordinal[n]).alias("ordinal"),
            F.lit(n).alias("column"),
            F.col(f"preview_{i}").alias("value_preview"),
            F.when(F.col(f"judged_{i}.fold").isNotNull(), instruction_match(F.col(f"exact_{i}")))
            .otherwise(F.col(f"judged_{i}.hit"))
            .alias("hit"),
        )
        for i, n in enumerate(names)
    ])
    return (
        narrow.select("row", F.inline(F.filter(found, lambda c: c["hit"].isNotNull())))
        .select(
            "ordinal", "column", "row", "value_preview",
            F.concat(F.lit(REASON), F.lower(F.substring("hit", 1, MATCH_CHARS)), F.lit("'")).alias("reason"),
        )
    )


def scan_frame(df: DataFrame, limit: int) -> DataFrame:
    """The first flagged cells, column by column and row by row (a top-k, not a cap on work)."""
    return flagged_cells(df).orderBy("ordinal", "row").limit(limit)


def neutralise_formulas(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[(neutralise_formula(q(c)) if c in texts else q(c)).alias(c) for c in df.columns])


def check_size_limit(n_bytes: int, max_mb: int = MAX_FILE_MB) -> None:
    if n_bytes > max_mb * 1024 * 1024:
        raise ValueError(
            f"FILE_TOO_LARGE: file size {n_bytes} bytes exceeds {max_mb} MB limit ({max_mb * 1024 * 1024} bytes)"
        )
