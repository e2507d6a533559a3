"""Event log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclean.operators.events import (
    AUDIT_SCHEMA,
    AuditLog,
    current_versions,
    event_filter,
    latest_per_key,
    page,
    pages,
    replay_after,
    top_export,
)
from sparkclean.queries import views
from sparkclean.queries.registry import query
from sparkclean.session import scratch_dir

_SINCE, _UNTIL = "2024-01-05 00:00:00", "2024-01-20 12:00:00"


@query(
    "events_filter",
    f"SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '{_SINCE}' AND ts <= TIMESTAMP '{_UNTIL}' AND event_type = 'click'",
)
def events_filter(spark, sf):
    e = views.table(spark, sf, "events")
    since, until = (F.lit(t).cast("timestamp_ntz") for t in (_SINCE, _UNTIL))
    return event_filter(e, "ts", since, until, event_type="click", user_id=None).select("event_id", "user_id", "value")


@query("events_page", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def events_page(spark, sf):
    e = views.table(spark, sf, "events")
    return page(e, [F.col("ts").desc(), F.col("event_id").desc()], number=3, size=25).select("event_id", "event_type")


@query(
    "events_deep_page",
    "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET (SELECT count(*) // 50 * 25 FROM events)",
)
def events_deep_page(spark, sf):
    """The page in the middle of the table."""
    found = pages(views.table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id").desc()])
    return found.page(found.total // 50 + 1, 25).select("event_id", "event_type", "ts")


@query("events_total", "SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def events_total(spark, sf):
    return views.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))


@query(
    "events_latest_per_key",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
       ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def events_latest(spark, sf):
    e = views.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(e, ["user_id"], [F.col("event_type") == "purchase", F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    "events_top_export",
    "SELECT event_id, event_type, props AS details_json FROM events",
)
def events_top(spark, sf):
    e = views.table(spark, sf, "events")
    details = F.replace(F.to_json(F.from_json("props", "k int")), F.lit(":"), F.lit(": "))
    return top_export(e, "ts", "event_id", details).select("event_id", "event_type", "details_json")


@query(
    "events_replay",
    "SELECT event_id FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 100)",
)
def events_replay(spark, sf):
    return replay_after(views.table(spark, sf, "events"), "ts", "event_id", 100).select("event_id")


@query("current_versions", "SELECT l_orderkey AS plan_id, max(l_linenumber) AS version_no FROM lineitem GROUP BY l_orderkey")
def versions(spark, sf):
    v = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("version_no"))
    return current_versions(v)


@query(
    "orders_newest_nulls_last",
    f"SELECT _rid, priority FROM ({views.MESSY_ORDERS}) ORDER BY priority DESC NULLS LAST, _rid LIMIT 40",
)
def newest(spark, sf):
    m = views.messy_orders(spark, sf)
    return page(m, [F.col("priority").desc_nulls_last(), F.col("_rid")], size=40).select("_rid", "priority")


@query(
    "audit_log",
    f"SELECT CAST(event_id AS VARCHAR) AS id, event_type, props AS details FROM events WHERE ts >= TIMESTAMP '{_SINCE}' AND event_type = 'error'",
)
def audit(spark, sf):
    log = AuditLog(spark, scratch_dir(spark, "audit"))
    names = [f.split()[0] for f in AUDIT_SCHEMA.split(", ")]
    e = views.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("occurred_at"),
        F.col("user_id").cast("string").alias("user_id"), F.lit("system").alias("user_role"), "event_type",
        F.lit("dataset").alias("object_type"), F.lit("events").alias("object_id"), F.col("props").alias("details"),
        F.lit(None).cast("string").alias("correlation_id"),
    ).select(*names)
    log.append(e.where("event_id % 2 = 0"))
    log.append(e.where("event_id % 2 = 1"))
    return log.read(since=F.lit(_SINCE).cast("timestamp_ntz"), event_type="error").select("id", "event_type", "details")
