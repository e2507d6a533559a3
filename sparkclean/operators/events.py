"""Event log: append, filter, page, latest per key, replay, newest-first export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.order import Ordered

# --- fixed values -----------------------------------------------------------------------
AUDIT_SCHEMA = (
    "id string, occurred_at timestamp_ntz, user_id string, user_role string, event_type string, "
    "object_type string, object_id string, details string, correlation_id string"
)
EXPORT_COLUMNS = (
    "id", "occurred_at", "user_id", "user_role", "event_type",
    "object_type", "object_id", "correlation_id", "details_json",
)
# ------------------------------------------------------------------------------------------


def event_filter(df: DataFrame, time: str, since=None, until=None, **equal) -> DataFrame:
    """AND of the given conditions; each reaches the Parquet scan."""
    conditions: list[Column] = []
    if since is not None:
        conditions.append(F.col(time) >= F.lit(since))
    if until is not None:
        conditions.append(F.col(time) <= F.lit(until))
    conditions += [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Rows of one of the first pages (1-based): a top-k on ``number * size`` rows, not a full sort.

    For pages of any depth, or several of one table, see :func:`pages`.
    """
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    return page(df, order, number, size), df.count()


def pages(df: DataFrame, order: list[Column]) -> Ordered:
    """The table in the ranges of an order, written once: every page, its total and ranks without a top-k."""
    return Ordered(df, *order)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def latest_check_runs(runs: DataFrame, check: str = "name") -> DataFrame:
    """Newest run of each check; any "after" run beats every "before" run."""
    return latest_per_key(runs, [check], [(F.col("phase") == "after"), F.col("run_at"), F.col("id")])


def current_versions(versions: DataFrame, plan: str = "plan_id", number: str = "version_no") -> DataFrame:
    return versions.groupBy(plan).agg(F.max(number).alias(number))


def replay_after(df: DataFrame, time: str, key: str, after_key=None) -> DataFrame:
    """Events strictly later than the named one, oldest first; all when it is unknown."""
    if after_key is not None:
        ref = df.where(F.col(key) == F.lit(after_key)).agg(F.max(time)).first()[0]
        if ref is not None:
            df = df.where(F.col(time) > F.lit(ref))
    return df.orderBy(F.col(time).asc(), F.col(key).asc())


def top_export(df: DataFrame, time: str, key: str, details: Column, rows: int | None = None) -> DataFrame:
    """The newest ``rows`` rows, or all, newest first, with their details as JSON text."""
    out = df.withColumn("details_json", F.coalesce(details, F.lit("{}"))).orderBy(
        F.col(time).desc(), F.col(key).desc()
    )
    return out if rows is None else out.limit(rows)


class AuditLog:
    """Append-only log, one directory per day so a time filter prunes files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, AUDIT_SCHEMA)
        # the rows of a day meet, and a large day is split again: few files of useful size
        daily = df.withColumn("day", F.to_date("occurred_at")).hint("rebalance", "day")
        daily.write.mode("append").partitionBy("day").parquet(self.path)

    def read(self, since=None, until=None, event_type=None, user_id=None) -> DataFrame:
        df = self.spark.read.schema(AUDIT_SCHEMA + ", day date").parquet(self.path)
        if since is not None:
            df = df.where(F.col("day") >= F.lit(since).cast("date"))
        if until is not None:
            df = df.where(F.col("day") <= F.lit(until).cast("date"))
        return event_filter(df, "occurred_at", since, until, event_type=event_type, user_id=user_id).drop("day")

    def export_csv(self, path: str, **filters) -> None:
        top = top_export(self.read(**filters), "occurred_at", "id", F.col("details"))
        top.select(*EXPORT_COLUMNS).write.option("header", True).option("nullValue", "").csv(path)
