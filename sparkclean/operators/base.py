"""Shared pieces of the cleaning catalogue: row identity, type names, loss, inverses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_rid"

# --- fixed values: public names of the column types ----------------------------------
TYPE_NAMES = {
    "String": T.StringType(),
    "Int64": T.LongType(),
    "Int32": T.IntegerType(),
    "Float64": T.DoubleType(),
    "Float32": T.FloatType(),
    "Boolean": T.BooleanType(),
    "Date": T.DateType(),
    "Datetime": T.TimestampNTZType(),
}
TYPE_ALIASES = {
    "string": "String", "str": "String", "utf8": "String",
    "int64": "Int64", "i64": "Int64", "int": "Int64",
    "int32": "Int32", "i32": "Int32",
    "float64": "Float64", "f64": "Float64", "float": "Float64",
    "float32": "Float32", "f32": "Float32",
    "boolean": "Boolean", "bool": "Boolean",
    "date": "Date",
}
# ---------------------------------------------------------------------------------------


def q(name: str) -> Column:
    """Column by its literal name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def type_name(dtype: T.DataType) -> str:
    for name, known in TYPE_NAMES.items():
        if type(dtype) is type(known):
            return name
    if isinstance(dtype, T.TimestampType):
        return "Datetime"
    return dtype.simpleString()


def parse_type(name: str) -> T.DataType:
    text = name.strip()
    low = text.lower()
    if low.startswith("datetime"):
        return TYPE_NAMES["Datetime"]
    if low in TYPE_ALIASES:
        return TYPE_NAMES[TYPE_ALIASES[low]]
    try:
        return T.DataType.fromDDL(text)
    except Exception as exc:  # the parser raises several classes
        raise ValueError(f"Unknown or unsupported dtype: {name}") from exc


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return is_integer(dtype) or is_float(dtype) or isinstance(dtype, T.DecimalType)


def schema_of(df: DataFrame) -> dict[str, str]:
    """Column name -> public type name, hidden row id left out."""
    return {f.name: type_name(f.dataType) for f in df.schema.fields if f.name != ROW_ID}


def replace_column(df: DataFrame, name: str, value: Column, rename: str | None = None) -> DataFrame:
    """Swap one column in place, keeping the order of the others."""
    return df.select(*[value.alias(rename or name) if c == name else q(c) for c in df.columns])


@dataclass
class LossEstimate:
    """``estimated_loss`` counts every cell a step rewrites; ``data_loss`` only the cells
    whose content cannot be found any more afterwards. Both are shares of all cells."""

    op: str
    rows_affected: int = 0
    columns_affected: int = 0
    cells_affected: int = 0
    cells_affected_pct: float = 0.0
    estimated_loss: float = 0.0
    data_loss: float = 0.0


@dataclass
class Inverse:
    """How to undo one step: a kind, small parameters and a delta table keyed by row id."""

    op: str
    parameters: dict[str, Any] = field(default_factory=dict)
    delta: DataFrame | None = None


class CleaningOp:
    """One catalogue operation. All methods are lazy; ``loss_columns`` returns aggregate
    expressions so that the estimates of a whole plan share one pass over the table."""

    name = ""

    def validate(self, params: dict[str, Any], schema: dict[str, str]) -> None:
        raise NotImplementedError

    def apply(self, df: DataFrame, params: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def inverse(self, before: DataFrame, after: DataFrame, params: dict[str, Any]) -> Inverse:
        raise NotImplementedError

    def prepare(self, df: DataFrame, params: dict[str, Any], tag: str) -> DataFrame:
        """Add helper columns the loss expressions need."""
        return df

    def loss_columns(self, df: DataFrame, params: dict[str, Any], tag: str) -> dict[str, Column]:
        raise NotImplementedError

    def loss_from(self, counts: dict[str, Any], rows: int, width: int, params: dict[str, Any]) -> LossEstimate:
        """Default: one rewritten column, ``changed`` cells, ``lost`` of them destroyed."""
        total = rows * width
        changed, lost = counts["changed"] or 0, counts.get("lost") or 0
        if not total:
            return LossEstimate(self.name)
        return LossEstimate(self.name, changed, 1, changed, changed / total, changed / total, lost / total)

    def child_tables(self, df: DataFrame, params: dict[str, Any]) -> dict[str, DataFrame]:
        return {}


def need_column(params: dict[str, Any], schema: dict[str, str], key: str = "column") -> str:
    column = params.get(key)
    if not column or not isinstance(column, str):
        raise ValueError(f"Parameter '{key}' must be a non-empty string")
    if column not in schema:
        raise ValueError(f"Column '{column}' does not exist in schema")
    return column


def need_text_column(params: dict[str, Any], schema: dict[str, str]) -> str:
    column = need_column(params, schema)
    if schema[column] != "String":
        raise ValueError(f"Column '{column}' must be String, got {schema[column]}")
    return column


def changed_cells(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Row id and old value of every cell that differs (join on the unique row id)."""
    b = before.select(ROW_ID, q(column).alias("old"))
    a = after.select(F.col(ROW_ID), q(column).alias("new"))
    return b.join(a, ROW_ID).where(~F.col("old").eqNullSafe(F.col("new"))).select(ROW_ID, "old")
