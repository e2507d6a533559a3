"""``drop_column``, ``cast_type`` and ``deduplicate``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.dates import lenient_date
from sparkclean.functions.numbers import to_float
from sparkclean.functions.text import remove_chars
from sparkclean.operators.base import (
    ROW_ID,
    CleaningOp,
    Inverse,
    LossEstimate,
    data_columns,
    is_float,
    need_column,
    q,
    replace_column,
    type_name,
)


class DropColumn(CleaningOp):
    name = "drop_column"

    def validate(self, params, schema):
        need_column(params, schema)

    def apply(self, df, params):
        return df.select(*[q(c) for c in df.columns if c != params["column"]])

    def inverse(self, before, after, params):
        column = params["column"]
        return Inverse(
            "restore_column",
            {
                "name": column,
                "dtype": type_name(before.schema[column].dataType),
                "position": data_columns(before).index(column),
            },
            before.select(ROW_ID, q(column).alias("old")),
        )

    def loss_columns(self, df, params, tag):
        c, twin = q(params["column"]), params.get("redundant_with")
        out = {"lost": F.count(c)}
        same = type_name(df.schema[params["column"]].dataType) == type_name(df.schema[twin].dataType) if twin in df.columns else False
        out["differs"] = F.count_if(~c.eqNullSafe(q(twin))) if same else F.count(F.lit(1))
        return out

    def loss_from(self, counts, rows, width, params):
        total = rows * width
        if not total:
            return LossEstimate(self.name)
        # Values stay recoverable from an identical twin column.
        lost = counts["lost"] if counts["differs"] else 0
        return LossEstimate(self.name, lost, 1 if lost else 0, rows, rows / total, lost / total, lost / total)


class CastType(CleaningOp):
    name = "cast_type"

    def validate(self, params, schema):
        need_column(params, schema)
        if params.get("dtype") not in ("float", "int", "string", "date"):
            raise ValueError(
                f"Parameter 'dtype' must be one of 'float', 'int', 'string', 'date', got '{params.get('dtype')}'"
            )

    def _value(self, df: DataFrame, params) -> Column:
        """Never raises: what cannot be converted becomes NULL."""
        c, target = q(params["column"]), params["dtype"]
        dtype = df.schema[params["column"]].dataType
        if params.get("strip_chars"):
            c, dtype = remove_chars(c, params["strip_chars"]), T.StringType()
        text = isinstance(dtype, T.StringType)
        number = to_float(c) if text else c.try_cast("double")
        if target == "float":
            return number
        if target == "int":
            # through double, so "12.9" becomes 12
            return number.try_cast("bigint") if text or is_float(dtype) else c.try_cast("bigint")
        if target == "date":
            return c.cast("date") if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else lenient_date(c.cast("string"))
        return c.cast("string")

    def apply(self, df, params):
        return replace_column(df, params["column"], self._value(df, params))

    def inverse(self, before, after, params):
        column = params["column"]
        return Inverse(
            "restore_cells",
            {"column": column, "dtype": type_name(before.schema[column].dataType)},
            before.select(ROW_ID, q(column).alias("old")),
        )

    def loss_columns(self, df, params, tag):
        c, new = q(params["column"]), self._value(df, params)
        before = df.schema[params["column"]].dataType
        after = df.select(new.alias("x")).schema["x"].dataType
        if type(before) is not type(after):
            changed = F.count(c)  # a new type rewrites every filled cell
        else:
            differs = ~c.eqNullSafe(new)
            changed = F.count_if(differs | F.isnan(c) if is_float(before) else differs)
        return {"changed": changed, "lost": F.count_if(c.isNotNull() & new.isNull())}


class Deduplicate(CleaningOp):
    """Keep the first row, in row order, of every key; NULL keys are equal.

    One aggregation with map-side combine: a key that holds a third of all rows arrives
    at its reducer as one row per map task. With the whole row as key the buffer is a
    single number (hash aggregation); with a subset the first row travels in a struct.
    """

    name = "deduplicate"

    def validate(self, params, schema):
        subset = params.get("subset")
        if subset is None:
            return
        if not isinstance(subset, list):
            raise ValueError("Parameter 'subset' must be a list of column names or None")
        for column in subset:
            if column not in schema:
                raise ValueError(f"Column '{column}' in subset does not exist in schema")

    def apply(self, df, params):
        names = data_columns(df)
        keys = params.get("subset") or names
        rest = [c for c in names if c not in keys]
        if not rest:
            kept = df.groupBy(*[q(c) for c in keys]).agg(F.min(ROW_ID).alias(ROW_ID))
        else:
            first = F.min(F.struct(F.col(ROW_ID), *[q(c).alias(f"v{i}") for i, c in enumerate(rest)]))
            # structs compare on the unique row id first, so no other field decides
            kept = df.groupBy(*[q(c) for c in keys]).agg(first.alias("_first")).select(
                *[q(c) for c in keys],
                F.col("_first")[ROW_ID].alias(ROW_ID),
                *[F.col("_first")[f"v{i}"].alias(c) for i, c in enumerate(rest)],
            )
        return kept.select(*[q(c) for c in df.columns])

    def inverse(self, before, after, params):
        dropped = before.join(after.select(ROW_ID), ROW_ID, "left_anti")
        return Inverse("restore_rows", {"columns": before.columns}, dropped.select(*[q(c) for c in before.columns]))

    def loss_columns(self, df, params, tag):
        return {}  # needs a distinct count: see plans.loss

    def duplicate_rows(self, df: DataFrame, params) -> Column:
        keys = params.get("subset") or data_columns(df)
        return F.count(F.lit(1)) - F.count_distinct(F.struct(*[q(c) for c in keys]))

    def loss_from(self, counts, rows, width, params):
        dropped = counts["dropped"] or 0
        total = rows * width
        if not total:
            return LossEstimate(self.name)
        cells = dropped * width
        return LossEstimate(
            self.name, dropped, width if dropped else 0, cells, cells / total, cells / total, 0.0
        )


CANDIDATES = 1000


def has_exact_duplicates(df: DataFrame) -> bool:
    """Is any whole row repeated? Only 8-byte hashes are shuffled; rows are compared in
    full only where two hashes met."""
    names = data_columns(df)
    if not names:
        return False
    plain = df.select(*[q(c).alias(f"c{i}") for i, c in enumerate(names)])
    hashed = plain.withColumn("h", F.xxhash64(*plain.columns))
    met = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    some = [r["h"] for r in met.limit(CANDIDATES).collect()]
    if not some:
        return False

    def repeated(rows: DataFrame) -> bool:
        return rows.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0

    # Equal hashes of different rows are possible, so a hit is confirmed on the rows. A few
    # hashes nearly always settle it; if not, all of them are compared.
    return repeated(hashed.where(F.col("h").isin(some))) or (
        len(some) == CANDIDATES and repeated(hashed.join(met, "h", "left_semi"))
    )
