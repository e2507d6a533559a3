"""The closed catalogue of operations and the execution of inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, CleaningOp, Inverse, data_columns, parse_type, q, replace_column
from sparkclean.operators.derive import DeriveColumn, ExpandNested, StandardiseFormat
from sparkclean.operators.structure import CastType, Deduplicate, DropColumn
from sparkclean.operators.values import FillMissing, ReplaceValue

OPS: dict[str, CleaningOp] = {}


def register(op: CleaningOp) -> CleaningOp:
    """Add an operation under its name; the name must be new."""
    if op.name in OPS:
        raise ValueError(f"operation '{op.name}' is already registered")
    OPS[op.name] = op
    return op


for _op in (
    ReplaceValue(), FillMissing(), DropColumn(), CastType(),
    Deduplicate(), DeriveColumn(), ExpandNested(), StandardiseFormat(),
):
    register(_op)


def get_op(name: str) -> CleaningOp:
    if name not in OPS:
        raise ValueError(f"Unknown operation: '{name}'")
    return OPS[name]


def apply_inverse(df: DataFrame, inverse: Inverse) -> DataFrame:
    """Undo one step. Deltas are joined on the unique row id, so no key can be hot."""
    p, hit = inverse.parameters, "_hit"
    if inverse.op == "restore_cells":
        column, renamed = p["column"], p.get("rename_from")
        if column not in df.columns and renamed in df.columns:
            df = replace_column(df, renamed, q(renamed), column)
        delta = inverse.delta.select(ROW_ID, F.col("old").alias("_old"), F.lit(True).alias(hit))
        joined = df.join(delta, ROW_ID, "left")
        current = q(column).try_cast(parse_type(p["dtype"]))
        value = F.when(F.col(hit), F.col("_old")).otherwise(current)
        return replace_column(joined, column, value).select(*[q(c) for c in df.columns])
    if inverse.op == "restore_nulls":
        joined = df.join(inverse.delta.select(ROW_ID, F.lit(True).alias(hit)), ROW_ID, "left")
        value = F.when(F.col(hit).isNull(), q(p["column"]))
        return replace_column(joined, p["column"], value).select(*[q(c) for c in df.columns])
    if inverse.op == "restore_column":
        joined = df.join(inverse.delta.select(ROW_ID, F.col("old").alias("_old")), ROW_ID, "left")
        names = data_columns(df)
        at = min(max(0, p["position"]), len(names))
        order = [q(c) for c in names[:at]] + [F.col("_old").alias(p["name"])] + [q(c) for c in names[at:]]
        return joined.select(F.col(ROW_ID), *order)
    if inverse.op == "drop_columns":
        return df.select(*[q(c) for c in df.columns if c not in p["columns"]])
    if inverse.op == "restore_rows":
        return df.unionByName(inverse.delta)
    raise ValueError(f"Unknown inverse op: {inverse.op}")
