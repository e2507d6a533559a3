"""Detection scoring against labels, as aggregates over joined tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.functions.numbers import to_float
from sparkclean.functions.text import is_blank, strip_ws

# --- fixed values -----------------------------------------------------------------------
# name, bar, direction
PASS_BAR = (
    ("crashes", 0.0, "lte"),
    ("quarantine_recall", 1.0, "gte"),
    ("quarantine_precision", 1.0, "gte"),
    ("injection_flag_rate", 0.95, "gte"),
    ("rule_recall", 0.9, "gte"),
)
VERDICT_INSTRUCTION = (
    r"ignore (all )?previous instructions|^\s*system\s*:|<\|system\|>"
    r"|\bdrop table\b|disregard (all )?instructions"
)
VERDICT_NUMERIC_NAMES = ("total", "amount", "price", "cost", "sum", "tax", "qty", "quantity")
VERDICT_SPARSE = 0.90
# ------------------------------------------------------------------------------------------


def ratio(hits: Column, total: Column) -> Column:
    """A share that is 1.0 when nothing was expected."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(hits.cast("double"), total))


def detection_scores(expected: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true_positives, expected, detected, recall, precision.

    Both sides are tagged and grouped on the key, so one shuffle with map-side combine
    does the work of two joins and a repeated detection counts once.
    """
    tagged = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("d")).unionAll(
        detected.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("d"))
    )
    per_key = tagged.groupBy(*keys).agg(F.max("e").alias("e"), F.max("d").alias("d"))
    sums = per_key.agg(
        F.coalesce(F.sum(F.col("e") * F.col("d")), F.lit(0)).cast("long").alias("true_positives"),
        F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("expected"),
        F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("detected"),
    )
    tp = F.col("true_positives")
    return sums.withColumn("recall", ratio(tp, F.col("expected"))).withColumn(
        "precision", ratio(tp, F.col("detected"))
    )


def pass_counts(results: DataFrame, passed: str = "passed", case: str | None = None) -> DataFrame:
    """One row (per case if a case column is named): total, passed, failed, pass_rate, clean (nothing failed).

    A check without a verdict has not passed. The rate of no checks is 1.0.
    """
    ok = F.count_if(F.coalesce(F.col(passed), F.lit(False)))
    total = F.count(F.lit(1))
    grouped = results.groupBy(*([case] if case else []))
    return grouped.agg(
        total.alias("total"), ok.alias("passed"), (total - ok).alias("failed"), ratio(ok, total).alias("pass_rate"), (total == ok).alias("clean")
    )


def clean_cases(counts: DataFrame) -> DataFrame:
    """From counts per case: cases, clean_cases, clean_rate."""
    clean = F.count_if("clean")
    return counts.agg(F.count(F.lit(1)).alias("cases"), clean.alias("clean_cases"), ratio(clean, F.count(F.lit(1))).alias("clean_rate"))


def bar_report(metrics: DataFrame) -> DataFrame:
    """(check, actual, bar, direction, passed) from one row of metrics."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check"), F.col(name).cast("double").alias("actual"),
            F.lit(bar).alias("bar"), F.lit(direction).alias("direction"),
            (F.col(name) <= bar if direction == "lte" else F.col(name) >= bar).alias("passed"),
        )
        for name, bar, direction in PASS_BAR
    ])
    return metrics.select(F.inline(rows))


def passed_bar(metrics: DataFrame) -> bool:
    return bool(bar_report(metrics).agg(F.bool_and("passed")).first()[0])


def case_differences(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Facts (case, kind, value) that only one side has: (case, kind, missing, unexpected)."""
    both = expected.select(case, "kind", "value", F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(
        actual.select(case, "kind", "value", F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    one_sided = both.groupBy(case, "kind", "value").agg(F.max("e").alias("e"), F.max("a").alias("a")).where("e <> a")
    return one_sided.groupBy(case, "kind").agg(
        F.count_if(F.col("e") == 1).alias("missing"), F.count_if(F.col("a") == 1).alias("unexpected")
    )


def sheet_verdicts(cells: DataFrame) -> DataFrame:
    """Legacy sheet verdict per file from raw rows ``(path, row_no, cells)``; row 0 is the
    header. The first test that fires decides: instruction, malformed row, sparse column.

    Every row is judged on its own, sparse columns by one grouped count; a file of any
    size is reduced before the shuffle.
    """
    blank = lambda c: is_blank(c)
    head = cells.where("row_no = 0").select(
        "path",
        F.when(
            F.exists("cells", blank),
            F.slice("cells", 1, F.array_position(F.transform("cells", blank), True).cast("int") - 1),
        ).otherwise(F.col("cells")).alias("header"),
    ).withColumn("header", F.transform("header", strip_ws)).withColumn("width", F.size("header"))
    # one small row per file; Spark decides from its size whether to broadcast it
    rows = cells.join(head, "path")
    in_width = F.slice("cells", 1, F.col("width"))
    numeric_name = lambda h: F.lower(h).rlike("|".join(VERDICT_NUMERIC_NAMES))
    not_number = F.exists(
        F.arrays_zip(in_width.alias("v"), F.slice("header", 1, F.size("cells")).alias("h")),
        lambda z: z["v"].isNotNull() & numeric_name(z["h"]) & to_float(strip_ws(z["v"])).isNull(),
    )
    data = F.col("row_no") > 0
    rank = (
        F.when(F.exists("cells", lambda c: c.rlike("(?iU)" + VERDICT_INSTRUCTION)), 1)
        .when(F.col("width") == 0, 2)
        .when(
            data
            & (
                ~F.exists("cells", lambda c: ~blank(c))
                | F.exists(F.slice("cells", F.col("width") + 1, F.size("cells") + 1), lambda c: c.isNotNull())
                | F.exists(in_width, lambda c: c.startswith("="))
                | not_number
            ),
            2,
        )
        .otherwise(9)
    )
    per_row = rows.select("path", "width", rank.alias("rank"), (data.cast("int")).alias("data"), "cells", "row_no")
    sparse = (
        per_row.where("row_no > 0")
        .select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("width"), F.lit(1)) - 1),
                                                 lambda i: F.coalesce(blank(F.get("cells", i)), F.lit(True)))))
        .groupBy("path", "pos").agg(F.avg(F.col("col").cast("int")).alias("share"))
        .groupBy("path").agg(F.max("share").alias("share"))
    )
    files = per_row.groupBy("path").agg(F.min("rank").alias("rank"))
    return files.join(sparse, "path", "left").select(
        "path",
        F.when((F.col("rank") < 9) | (F.coalesce("share", F.lit(0.0)) >= VERDICT_SPARSE), "quarantined")
        .otherwise("clean").alias("verdict"),
        F.when(F.col("rank") == 1, "prompt-injection cell").when(F.col("rank") == 2, "malformed rows")
        .when(F.coalesce("share", F.lit(0.0)) >= VERDICT_SPARSE, "sparse column").otherwise("clean").alias("reason"),
    )
