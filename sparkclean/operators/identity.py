"""Row identity and frame comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, data_columns, is_float, q
from sparkclean.session import scratch_dir

# rows per file that an id leaves room for; the rest of a positive id numbers the files
FILE_BITS = 40


def file_row_id(file_no: Column, row: Column) -> Column:
    """Row id of a row of a numbered file; an error where the parts do not fit, never a second use of an id."""
    fits = (file_no >= 0) & (file_no < 1 << (63 - FILE_BITS)) & (row >= 0) & (row < 1 << FILE_BITS)
    wrong = F.raise_error(F.concat(F.lit("no row id for file "), file_no.cast("string"), F.lit(", row "), row.cast("string")))
    return F.when(fits, F.shiftleft(file_no, FILE_BITS) + row).otherwise(wrong.cast("long"))


def order_columns(df: DataFrame) -> DataFrame:
    """Row id first, data columns after it."""
    return df.select(F.col(ROW_ID), *[q(c) for c in data_columns(df)])


def with_row_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    """Give a frame that has no file order its row ids. They depend on how the frame was
    computed this time, so they are written out at once and read back."""
    target = path or scratch_dir(df.sparkSession, "rows")
    df.select(F.monotonically_increasing_id().alias(ROW_ID), *[q(c) for c in df.columns]).write.parquet(target)
    return df.sparkSession.read.parquet(target)


def _comparable(df: DataFrame) -> DataFrame:
    """NaN counts as NULL."""
    cols = []
    for f in df.schema.fields:
        if f.name == ROW_ID:
            continue
        c = q(f.name)
        cols.append((F.when(~F.isnan(c), c) if is_float(f.dataType) else c).alias(f.name))
    return df.select(*cols)


def frame_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns in the same order, same types, same rows as a multiset.

    Each side is grouped once and the two groupings are matched: one shuffle per side,
    repeated rows collapse before it, and the job stops at the first difference.
    """
    fields = lambda d: [(f.name, f.dataType) for f in d.schema.fields if f.name != ROW_ID]
    if fields(a) != fields(b):
        return False
    names = data_columns(a)
    if not names:
        return a.count() == b.count()
    both = _comparable(a).withColumn("_side", F.lit(1)).unionByName(_comparable(b).withColumn("_side", F.lit(-1)))
    diff = both.groupBy(*[q(c) for c in names]).agg(F.sum("_side").alias("_d")).where("_d <> 0")
    return diff.limit(1).count() == 0


def row_hash(df: DataFrame) -> Column:
    """Hash of the data columns of a row. The hash function skips NULLs, so which columns are NULL is hashed too."""
    values = [c for c in map(q, data_columns(df))]
    values = [F.when(~F.isnan(c), c) if is_float(df.schema[n].dataType) else c for c, n in zip(values, data_columns(df), strict=True)]
    if not values:
        return F.lit(0).cast("long")
    return F.xxhash64(F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in values]), *values)


def fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates (rows, xor of row hashes, sum of row hashes) that do not depend on row
    order. The sum tells apart frames whose repeated rows cancel in the xor; it is wide enough
    for any number of rows."""
    h = row_hash(df)
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.pmod(h, F.lit(2**31 - 1)).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"),
    ]


def content_hash(df: DataFrame) -> tuple[int, int, int]:
    """The fingerprint of a frame, one narrow pass."""
    r = df.agg(*fingerprint(df)).first()
    return int(r["n"]), int(r["x"]), int(r["s"])
