"""Column and table profile.

Counts, ranges and means come from one pass with map-side aggregation (wide tables are
cut into column groups, each group reading only its own columns). The shape tests and the
distinct counts of text columns share one grouping by value. Distinct counts of other
columns read one column each and meet in a single job; no whole row is multiplied by the
number of columns, which is what many distinct aggregates in one statement would do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.dates import is_trimmed_date
from sparkclean.functions.nested import json_cell_ok, json_of_trimmed, with_parsed_cells
from sparkclean.functions.numbers import is_trimmed_number
from sparkclean.functions.text import is_trimmed_boolean, is_trimmed_code, strip_ws
from sparkclean.operators.base import ROW_ID, data_columns, is_integer, is_numeric, q, type_name

# --- fixed values: thresholds and name hints of the classification --------------------
NESTED_SHARE = 0.5
NUMERIC_SHARE = 0.8
DATE_SHARE = 0.8
CODE_SHARE = 0.9
KEY_RATIO = 0.9
CATEGORY_MAX = 50
SPARSE_SHARE = 0.95
ID_NAME = re.compile(r"id|number|code")
MONEY_NAME = re.compile(r"amount|price|total|vat|tax|cost")
# ---------------------------------------------------------------------------------------

COLUMNS_PER_PASS = 40
# Cells longer than this are grouped by digest and tested in the scan.
LONG_CHARS = 64

PROFILE_SCHEMA = (
    "name string, ordinal int, physical_type string, semantic_type string, null_count bigint, "
    "null_pct double, distinct_count bigint, min_value string, max_value string, mean_value double, "
    "flags array<string>"
)


@dataclass
class ColumnProfile:
    name: str
    ordinal: int
    physical_type: str
    semantic_type: str
    null_count: int
    null_pct: float
    distinct_count: int
    min_value: str | None
    max_value: str | None
    mean_value: float | None
    flags: list[str]


@dataclass
class TableProfile:
    table_name: str
    row_count: int
    column_count: int
    columns: list[ColumnProfile]
    issues: list[str] = field(default_factory=list)

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(vars(c).values()) for c in self.columns], PROFILE_SCHEMA)


def _shape_tests(t: Column, json: Column) -> dict[str, Column]:
    return {
        "looks": F.substring(t, 1, 1).isin("[", "{"),
        "strict": json_cell_ok(t, json),
        "number": is_trimmed_number(t),
        "date": is_trimmed_date(t),
        "code": is_trimmed_code(t),
        "filled": t != "",
        "boolean": is_trimmed_boolean(t),
    }


def _cells(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(column, value) of the text columns. Unpivoted, the tests exist once in the
    generated code, however wide the table is."""
    wide = df.select(*[q(c).alias(n) for n, c in names.items()])
    return wide.unpivot([], list(names), "column", "value").where(F.col("value").isNotNull())


def _by_name(rows, names: dict[str, str], keys) -> dict[str, dict[str, int]]:
    seen = {names[r["column"]]: {k: r[k] for k in keys} for r in rows}
    return {c: seen.get(c, dict.fromkeys(keys, 0)) for c in names.values()}


def shape_counts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """How many cells of each text column look like what; every cell is tested in the
    scan and one row per column and task is shuffled."""
    names = {f"c{i}": c for i, c in enumerate(columns)}
    t = F.col("t")
    cells = _cells(df, names).select("column", strip_ws(F.col("value")).alias("t"))
    cells = cells.select("column", "t", json_of_trimmed(t).alias("json"))
    tests = _shape_tests(t, F.col("json"))
    rows = cells.groupBy("column").agg(*[F.count_if(x).alias(k) for k, x in tests.items()]).collect()
    return _by_name(rows, names, tests)


def text_stats(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Shape counts and the exact distinct count of each text column in one job.

    Counting distinct values has to group the cells by value anyway, so the tests run on
    the different values only, weighted by how often each occurs; a value that fills a
    third of a column is one row per task. Long cells are grouped by their SHA-256 and
    tested in the scan.
    """
    names = {f"c{i}": c for i, c in enumerate(columns)}
    v, t = F.col("value"), F.col("t")
    cells = _cells(df, names)
    long = F.length(v) > LONG_CHARS
    cells = cells.select("column", "value", long.alias("long"), F.when(long, strip_ws(v)).alias("t"))
    cells = cells.select(
        "column", "long", "t", json_of_trimmed(t).alias("json"),
        F.when(F.col("long"), F.sha2(v, 256)).otherwise(v).alias("key"),
    )
    on_long = _shape_tests(t, F.col("json"))
    values = cells.groupBy("column", "long", "key").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.coalesce(x, F.lit(False)).cast("int")).alias(f"long_{k}") for k, x in on_long.items()],
    )
    values = values.withColumn("t", F.when(~F.col("long"), strip_ws(F.col("key"))))
    values = values.withColumn("json", json_of_trimmed(t))
    tests = _shape_tests(t, F.col("json"))
    hit = {k: F.when(F.col("long"), F.col(f"long_{k}") == 1).otherwise(x) for k, x in tests.items()}
    rows = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        *[F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(k) for k, x in hit.items()],
    ).collect()
    return _by_name(rows, names, ["distinct", *tests])


def _orderable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) or is_numeric(dtype)


def scan_counts(df: DataFrame) -> dict[str, object]:
    """Null, range and mean of every column in one flat aggregate."""
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    found: dict[str, object] = {}
    for start in range(0, max(1, len(fields)), COLUMNS_PER_PASS):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in list(enumerate(fields))[start : start + COLUMNS_PER_PASS]:
            c = q(f.name)
            aggs.append(F.count(c).alias(f"filled_cells_{i}"))
            if _orderable(f.dataType):
                aggs += [F.min(c).cast("string").alias(f"min_{i}"), F.max(c).cast("string").alias(f"max_{i}")]
            if is_numeric(f.dataType):
                aggs.append(F.avg(c).cast("double").alias(f"mean_{i}"))
        found.update(df.agg(*aggs).first().asDict())
    return found


def distinct_counts(df: DataFrame) -> dict[str, int]:
    """Exact number of different non-null values per column, each column read on its own."""
    def one(i: int, f: T.StructField) -> DataFrame:
        c = F.to_json(q(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else q(f.name)
        return df.select(c.alias("v")).agg(F.count_distinct("v").alias("n")).select(F.lit(i).alias("i"), "n")

    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    out: dict[str, int] = {}
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        group = list(enumerate(fields))[start : start + COLUMNS_PER_PASS]
        job = reduce(DataFrame.unionAll, [one(i, f) for i, f in group])
        out.update({fields[r["i"]].name: r["n"] for r in job.collect()})
    return out


def distinct_counts_auto(df: DataFrame, rows: int) -> dict[str, int]:
    """Sketch all columns in one pass, then count exactly only the columns whose estimate
    is near a decision: few values, or close to one value per row."""
    names = data_columns(df)
    plain = [n for n in names if not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))]
    est = {}
    for start in range(0, len(plain), COLUMNS_PER_PASS):
        group = plain[start : start + COLUMNS_PER_PASS]
        r = df.agg(*[F.approx_count_distinct(q(n), 0.01).alias(f"e{i}") for i, n in enumerate(group)]).first()
        est.update({n: r[i] for i, n in enumerate(group)})
    close = [n for n in names if n not in est or est[n] <= 2 * CATEGORY_MAX or est[n] >= 0.8 * KEY_RATIO * rows]
    exact = distinct_counts(df.select(*[q(n) for n in close])) if close else {}
    return {**est, **exact}


def _semantic(f: T.StructField, i: int, n: int, distinct: int, rows: int, got: dict, nested: int) -> tuple[str, list[str]]:
    name, ratio = f.name.lower(), (distinct / rows if rows else 0.0)
    id_name = bool(ID_NAME.search(name))
    if n == 0:
        return "unknown", []
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date", []
    if isinstance(f.dataType, T.BooleanType):
        return "boolean", []
    if is_numeric(f.dataType):
        if id_name and ratio > KEY_RATIO:
            return "identifier", []
        return ("integer" if is_integer(f.dataType) else "float"), []
    if not isinstance(f.dataType, T.StringType):
        return ("category" if distinct <= CATEGORY_MAX else "unknown"), []
    if nested / n >= NESTED_SHARE:
        return "nested_json", []
    if got[f"number_{i}"] / n >= NUMERIC_SHARE:
        return ("currency" if MONEY_NAME.search(name) else "numeric_text"), ["numeric_as_text"]
    if got[f"date_{i}"] / n >= DATE_SHARE:
        return "date", []
    if id_name and ratio > KEY_RATIO:
        return "identifier", []
    filled = got[f"filled_{i}"]
    if ratio > KEY_RATIO and filled and got[f"code_{i}"] / filled >= CODE_SHARE:
        return "identifier", []
    if distinct == 2 and got[f"boolean_{i}"] == n:
        return "boolean", []
    return ("category" if distinct <= CATEGORY_MAX else "free_text"), []


def profile_table(df: DataFrame, table_name: str = "dataset", distinct: str = "exact") -> TableProfile:
    """``distinct="auto"`` replaces exact counts by sketches where no decision depends on
    them, which saves the shuffle of every high-cardinality column."""
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    got = scan_counts(df)
    rows = got["rows"]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    stats: dict[str, dict[str, int]] = {}
    for start in range(0, len(texts), COLUMNS_PER_PASS):
        part = texts[start : start + COLUMNS_PER_PASS]
        stats.update(text_stats(df, part) if distinct == "exact" else shape_counts(df, part))
    if distinct == "exact":
        others = [q(f.name) for f in fields if f.name not in stats]
        uniques = {n: x["distinct"] for n, x in stats.items()}
        uniques.update(distinct_counts(df.select(*others)) if others else {})
    else:
        uniques = distinct_counts_auto(df, rows)
    for i, f in enumerate(fields):
        got.update({f"{k}_{i}": x for k, x in stats.get(f.name, {}).items()})

    nested: dict[int, int] = {}
    unsure: list[int] = []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.StringType) and got[f"filled_cells_{i}"]:
            nested[i] = got[f"strict_{i}"]
            half = NESTED_SHARE * got[f"filled_cells_{i}"]
            if got[f"strict_{i}"] < half <= got[f"looks_{i}"]:
                unsure.append(i)
    if unsure:  # broken JSON decides: only these columns visit the repairing parser
        job = df.select(*[q(fields[i].name).alias(f"c{i}") for i in unsure])
        for i in unsure:
            job = with_parsed_cells(job, f"c{i}", f"p{i}")
        r = job.agg(*[
            F.count_if(F.col(f"p{i}.status").isin("ok", "repaired", "partial")).alias(f"n{i}") for i in unsure
        ]).first()
        nested.update({i: r[f"n{i}"] for i in unsure})

    columns = []
    for i, f in enumerate(fields):
        n = got[f"filled_cells_{i}"]
        nulls = rows - n
        pct = round(nulls / rows, 4) if rows else 0.0
        count = uniques[f.name]
        semantic, flags = _semantic(f, i, n, count, rows, got, nested.get(i, 0))
        if nulls == rows:
            flags.append("all_null")
        if pct >= SPARSE_SHARE:
            flags.append("sparse_95")
        if count == 1 and nulls == 0:
            flags.append("constant")
        if semantic == "nested_json":
            flags.append("nested_json")
        if count > CATEGORY_MAX:
            flags.append("high_cardinality")
        columns.append(
            ColumnProfile(
                f.name, i, type_name(f.dataType), semantic, nulls, pct, count,
                got.get(f"min_{i}"), got.get(f"max_{i}"), got.get(f"mean_{i}"), flags,
            )
        )
    return TableProfile(table_name, rows, len(fields), columns, table_issues(columns))


def table_issues(columns: list[ColumnProfile]) -> list[str]:
    flagged = lambda flag: [c.name for c in columns if flag in c.flags]
    issues = []
    if flagged("all_null"):
        issues.append("all-null-columns")
    if flagged("nested_json"):
        issues.append("nested-json-columns: " + ", ".join(flagged("nested_json")))
    if flagged("numeric_as_text"):
        issues.append("numeric-as-text-columns")
    if flagged("sparse_95"):
        issues.append("sparse-columns")
    return issues


def sparse_columns(df: DataFrame, threshold: float = SPARSE_SHARE) -> list[str]:
    names = data_columns(df)
    r = df.agg(F.count(F.lit(1)), *[F.count(q(n)) for n in names]).first()
    return [n for i, n in enumerate(names) if r[0] and (r[0] - r[i + 1]) / r[0] >= threshold]


def profile_kpis(profile: TableProfile, quarantined: int = 0) -> dict[str, int]:
    return {
        "row_count": profile.row_count,
        "column_count": profile.column_count,
        "columns_with_nulls": sum(c.null_count > 0 for c in profile.columns),
        "nested_columns": sum("nested_json" in c.flags for c in profile.columns),
        "quarantined_rows": quarantined,
    }


def first_samples(df: DataFrame, per_column: int = 10) -> DataFrame:
    """The first non-null values of every column in row order: (ordinal, column, row, value).

    One top-k per column: each task keeps its own ``per_column`` rows, nothing else moves.
    """
    def one(i: int, name: str) -> DataFrame:
        return (
            df.select(
                F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
                F.col(ROW_ID).alias("row"), q(name).cast("string").alias("value"),
            )
            .where(F.col("value").isNotNull())
            .orderBy("row")
            .limit(per_column)
        )

    return reduce(DataFrame.unionAll, [one(i, n) for i, n in enumerate(data_columns(df))])


def safe_samples(df: DataFrame, candidates: int = 10, keep: int = 5) -> DataFrame:
    """(column, samples): of the first values per column the first few that hold no
    instruction-like text, masked."""
    from sparkclean.functions.text import fold_native, has_instruction, mask_sample, nfkc

    first = first_samples(df, candidates)
    flagged = has_instruction(nfkc(fold_native(F.col("value"))))  # a handful of rows
    rows = F.sort_array(F.collect_list(F.when(~flagged, F.struct("row", mask_sample(F.col("value")).alias("v")))))
    return first.groupBy("ordinal", "column").agg(
        F.slice(F.transform(rows, lambda r: r["v"]), 1, keep).alias("samples")
    )
