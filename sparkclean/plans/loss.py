"""Loss of each step and of a whole plan. All steps are measured on the same table."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.operators.base import LossEstimate, data_columns
from sparkclean.operators.catalogue import get_op
from sparkclean.operators.structure import Deduplicate

# --- fixed values -----------------------------------------------------------------------
LOSS_THRESHOLD = 0.05
# ------------------------------------------------------------------------------------------
STEPS_PER_PASS = 60

Step = tuple[str, dict[str, Any]]


def estimate_losses(df: DataFrame, steps: list[Step]) -> list[LossEstimate]:
    """One pass over the table for all steps; a deduplicate step adds a distinct count."""
    width = len(data_columns(df))
    counts: list[dict[str, Any]] = [{} for _ in steps]
    rows = 0
    for start in range(0, max(1, len(steps)), STEPS_PER_PASS):
        frame, aggs, owners = df, [F.count(F.lit(1)).alias("rows")], []
        for i, (name, params) in list(enumerate(steps))[start : start + STEPS_PER_PASS]:
            op = get_op(name)
            frame = op.prepare(frame, params, f"_t{i}")
            for key, expr in op.loss_columns(df, params, f"_t{i}").items():
                aggs.append(expr.alias(f"{key}_{i}"))
                owners.append((i, key))
        got = frame.agg(*aggs).first()
        rows = got["rows"]
        for i, key in owners:
            counts[i][key] = got[f"{key}_{i}"]
    dedups = [i for i, (name, _) in enumerate(steps) if isinstance(get_op(name), Deduplicate)]
    if dedups:
        jobs = [
            df.agg(get_op(steps[i][0]).duplicate_rows(df, steps[i][1]).alias("n")).select(F.lit(i).alias("i"), "n")
            for i in dedups
        ]
        for r in reduce(DataFrame.unionAll, jobs).collect():
            counts[r["i"]]["dropped"] = r["n"]
    return [get_op(name).loss_from(counts[i], rows, width, params) for i, (name, params) in enumerate(steps)]


def estimate_step_loss(df: DataFrame, operation: str, params: dict[str, Any]) -> LossEstimate:
    return estimate_losses(df, [(operation, params)])[0]


def cumulative_loss(losses: list[float]) -> float:
    """``1 - product(1 - loss)``, bounded to 0..1."""
    kept = math.prod(1.0 - min(1.0, max(0.0, x)) for x in losses)
    return min(1.0, max(0.0, 1.0 - kept))


def cumulative_loss_column(loss: Column) -> Column:
    """The same as an aggregate over a table of steps."""
    kept = F.product(1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), loss)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.coalesce(kept, F.lit(1.0))))


def within_threshold(loss: float, threshold: float = LOSS_THRESHOLD) -> bool:
    return loss <= threshold


def losses_df(spark, losses: list[LossEstimate]) -> DataFrame:
    return spark.createDataFrame(
        [(i, *vars(x).values()) for i, x in enumerate(losses, 1)],
        "step_no int, op string, rows_affected bigint, columns_affected bigint, cells_affected bigint, "
        "cells_affected_pct double, estimated_loss double, data_loss double",
    )
