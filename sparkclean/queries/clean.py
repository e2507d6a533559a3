"""Catalogue operations, their inverses and their losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclean.functions.nested import nested_summary, with_parsed_cells
from sparkclean.operators.base import ROW_ID, data_columns, q
from sparkclean.operators.catalogue import OPS, apply_inverse
from sparkclean.operators.identity import frame_equal
from sparkclean.operators.structure import has_exact_duplicates
from sparkclean.plans.loss import cumulative_loss_column, estimate_losses, losses_df
from sparkclean.plans.plan import step_diff
from sparkclean.queries import views
from sparkclean.queries.registry import query

_M = f"({views.MESSY_ORDERS})"


def _messy_op(name: str, op: str, column: str, params: dict, value_sql: str, show=None) -> None:
    """Apply one operation to one column of the messy orders and show that column."""

    @query(name, f"SELECT _rid, {value_sql} AS value FROM {_M}")
    def run(spark, sf):
        out = OPS[op].apply(views.messy_orders(spark, sf), {"column": column, **params})
        return out.select(ROW_ID, (show or (lambda c: c))(q(column)).alias("value"))


_messy_op(
    "op_replace_value", "replace_value", "priority", {"mapping": {"1-URGENT": "urgent", "5-LOW": "low"}},
    "CASE priority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE priority END",
)
_messy_op(
    "op_replace_value_join", "replace_value", "order_day",
    {"mapping": {f"{y}-{m:02d}-15": f"mid {y}-{m:02d}" for y in range(1990, 2010) for m in range(1, 13)}},
    "CASE WHEN order_day LIKE '____-__-15' AND order_day BETWEEN '1990' AND '2010' THEN 'mid ' || left(order_day, 7) ELSE order_day END",
)
_messy_op("op_fill_missing", "fill_missing", "priority", {"value": "unknown"}, "coalesce(priority, 'unknown')")
_messy_op("op_fill_missing_number", "fill_missing", "empty_col", {"value": 3}, "'3'")
_messy_op(
    "op_cast_float", "cast_type", "mixed_text", {"dtype": "float", "strip_chars": "$, "},
    "TRY_CAST(replace(replace(replace(mixed_text, '$', ''), ',', ''), ' ', '') AS DOUBLE)",
)
_messy_op(
    "op_cast_int", "cast_type", "price_text", {"dtype": "int", "strip_chars": "$"},
    "CAST(trunc(CAST(replace(price_text, '$', '') AS DOUBLE)) AS BIGINT)",
)
_messy_op("op_cast_string", "cast_type", "price", {"dtype": "string"}, "CAST(price AS VARCHAR)")
_messy_op(
    "op_cast_date", "cast_type", "day_text", {"dtype": "date"}, "order_day", lambda c: F.date_format(c, "yyyy-MM-dd")
)
_messy_op("op_standardise_lower", "standardise_format", "priority", {"format": "lower"}, "lower(priority)")
_messy_op("op_standardise_upper", "standardise_format", "day_text", {"format": "upper"}, "upper(day_text)")
_messy_op("op_standardise_strip", "standardise_format", "status_text", {"format": "strip"}, "trim(status_text)")
_messy_op("op_standardise_iso_date", "standardise_format", "day_text", {"format": "iso_date"}, "order_day")
_messy_op(
    "op_standardise_title", "standardise_format", "priority", {"format": "title"},
    """CASE priority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium'
       WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' WHEN '5-LOW' THEN '5-Low' END""",
)


@query("op_drop_column", f"SELECT _rid, order_number, price FROM {_M}")
def drop_column(spark, sf):
    df = views.messy_orders(spark, sf)
    for c in data_columns(df):
        if c not in ("order_number", "price"):
            df = OPS["drop_column"].apply(df, {"column": c})
    return df


def _derive(name: str, op: str, args: list, sql: str) -> None:
    @query(f"op_derive_{name}", f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql}, 6) AS derived FROM lineitem")
    def run(spark, sf):
        out = OPS["derive_column"].apply(
            views.table(spark, sf, "lineitem"), {"name": "derived", "expression": {"op": op, "args": args}}
        )
        return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("derived", 6).alias("derived"))


_derive("add", "add", [{"column": "l_quantity"}, {"column": "l_tax"}, {"literal": 1}], "l_quantity + l_tax + 1")
_derive("subtract", "subtract", [{"column": "l_extendedprice"}, {"column": "l_quantity"}], "l_extendedprice - l_quantity")
_derive("multiply", "multiply", [{"column": "l_quantity"}, {"column": "l_linenumber"}], "l_quantity * l_linenumber")
_derive(
    "divide", "divide", [{"column": "l_extendedprice"}, {"column": "l_discount"}],
    "CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE l_extendedprice / l_discount END",
)


@query(
    "op_deduplicate",
    "SELECT min(doc_id) AS doc_id, text, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY text",
)
def deduplicate(spark, sf):
    docs = views.with_rid(views.table(spark, sf, "documents"), "doc_id")
    return OPS["deduplicate"].apply(docs, {"subset": ["text"]}).drop(ROW_ID)


@query(
    "op_deduplicate_rows",
    f"SELECT min(_rid) AS _rid, event_id, user_id, event_type, value, props FROM ({views.DUP_EVENTS}) GROUP BY ALL",
)
def deduplicate_rows(spark, sf):
    return OPS["deduplicate"].apply(views.dup_events(spark, sf).drop("ts"), {"subset": None})


@query("exact_duplicates", f"""SELECT (SELECT count(*) FROM (SELECT 1 FROM ({views.DUP_EVENTS})
    GROUP BY event_id, ts, user_id, event_type, value, props HAVING count(*) > 1)) > 0 AS dup_events, false AS events""")
def exact_duplicates(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id")
    return spark.createDataFrame(
        [(has_exact_duplicates(views.dup_events(spark, sf)), has_exact_duplicates(e))], "dup_events boolean, events boolean"
    )


# --- nested ------------------------------------------------------------------------------------

_EVENT_CHILD = {"column": "props", "key_column": "event_id", "child_table": "Props"}
_LINES_CHILD = {"column": "line_items", "key_column": "order_no", "child_table": "LineItems"}


@query("op_expand_parent", "SELECT event_id, CAST(1 AS BIGINT) AS props_count FROM events")
def expand_parent(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id").select(ROW_ID, "event_id", "props")
    return OPS["expand_nested"].apply(e, _EVENT_CHILD).drop(ROW_ID)


@query("op_expand_child", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def expand_child(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id").select(ROW_ID, "event_id", "props")
    return OPS["expand_nested"].child_tables(e, _EVENT_CHILD)["Props"]


@query(
    "op_expand_child_lines",
    "SELECT l_orderkey AS order_no, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, round(l_extendedprice, 2) AS amount FROM lineitem",
)
def expand_child_lines(spark, sf):
    return OPS["expand_nested"].child_tables(views.order_lines(spark, sf), _LINES_CHILD)["LineItems"]


@query(
    "op_expand_child_messy",
    """SELECT event_id AS "_row", CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
       FROM (SELECT * FROM events WHERE event_id % 5 < 3 UNION ALL SELECT * FROM events WHERE event_id % 5 < 2)""",
)
def expand_child_messy(spark, sf):
    p = {"column": "details", "parent_key": "_row", "child_table": "Details"}
    return OPS["expand_nested"].child_tables(views.nested_events(spark, sf), p)["Details"]


_STATUS = """CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' WHEN 2 THEN 'partial' WHEN 3 THEN 'invalid' ELSE 'empty' END"""


@query(
    "nested_status",
    f"SELECT event_id, {_STATUS} AS status, CAST(CASE WHEN event_id % 5 < 2 THEN 2 WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS items FROM events",
)
def nested_status(spark, sf):
    parsed = with_parsed_cells(views.nested_events(spark, sf), "details")
    return parsed.select("event_id", "_nested.status", F.size("_nested.items").cast("long").alias("items"))


@query(
    "nested_summary",
    """SELECT count(*) FILTER (WHERE event_id % 5 = 0) AS ok, count(*) FILTER (WHERE event_id % 5 = 1) AS repaired,
         count(*) FILTER (WHERE event_id % 5 = 2) AS partial, count(*) FILTER (WHERE event_id % 5 = 3) AS invalid,
         count(*) FILTER (WHERE event_id % 5 = 4) AS empty,
         CAST(sum(CASE WHEN event_id % 5 < 2 THEN 2 WHEN event_id % 5 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS items FROM events""",
)
def summary(spark, sf):
    return nested_summary(views.nested_events(spark, sf), "details")


@query("join_children_without_parent", "SELECT CAST(0 AS BIGINT) AS orphans")
def orphans(spark, sf):
    parent = views.order_lines(spark, sf)
    child = OPS["expand_nested"].child_tables(parent, _LINES_CHILD)["LineItems"]
    return child.join(parent, "order_no", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


# --- inverses ------------------------------------------------------------------------------------


def _round_trip(name: str, op: str, params: dict, columns: list[str]) -> None:
    @query(f"inverse_{name}", f"SELECT _rid, {', '.join(columns)} FROM {_M}")
    def run(spark, sf):
        before = views.messy_orders(spark, sf).select(ROW_ID, *columns)
        after = OPS[op].apply(before, params)
        return apply_inverse(after, OPS[op].inverse(before, after, params))


_round_trip("replace_value", "replace_value", {"column": "priority", "mapping": {"1-URGENT": "x", "5-LOW": "y"}}, ["priority", "price"])
_round_trip("cast_type", "cast_type", {"column": "mixed_text", "dtype": "float", "strip_chars": "$, "}, ["mixed_text", "price"])
_round_trip("fill_missing", "fill_missing", {"column": "priority", "value": "5-LOW"}, ["priority", "price"])
_round_trip("drop_column", "drop_column", {"column": "price_text"}, ["order_number", "price_text", "price"])
_round_trip("standardise_format", "standardise_format", {"column": "day_text", "format": "iso_date"}, ["day_text", "price"])
_round_trip(
    "derive_column", "derive_column",
    {"name": "twice", "expression": {"op": "multiply", "args": [{"column": "price"}, {"literal": 2}]}}, ["order_number", "price"],
)


@query("inverse_deduplicate", f"SELECT _rid, event_id, user_id, event_type, value, props FROM ({views.DUP_EVENTS})")
def inverse_deduplicate(spark, sf):
    before, params = views.dup_events(spark, sf).drop("ts"), {"subset": ["event_id"]}
    after = OPS["deduplicate"].apply(before, params)
    return apply_inverse(after, OPS["deduplicate"].inverse(before, after, params))


@query("inverse_expand_nested", "SELECT event_id, props FROM events")
def inverse_expand_nested(spark, sf):
    before = views.with_rid(views.table(spark, sf, "events"), "event_id").select(ROW_ID, "event_id", "props")
    after = OPS["expand_nested"].apply(before, _EVENT_CHILD)
    return apply_inverse(after, OPS["expand_nested"].inverse(before, after, _EVENT_CHILD)).drop(ROW_ID)


@query("inverse_delta_cells", f"SELECT _rid, priority AS old FROM {_M} WHERE priority IN ('1-URGENT', '5-LOW')")
def delta_cells(spark, sf):
    before = views.messy_orders(spark, sf)
    params = {"column": "priority", "mapping": {"1-URGENT": "x", "5-LOW": "y", "2-HIGH": "2-HIGH"}}
    return OPS["replace_value"].inverse(before, OPS["replace_value"].apply(before, params), params).delta


@query("dedup_dropped_rows", f"SELECT _rid, event_id FROM ({views.DUP_EVENTS}) WHERE _rid % 2 = 1")
def dropped_rows(spark, sf):
    before, params = views.dup_events(spark, sf), {"subset": ["event_id"]}
    after = OPS["deduplicate"].apply(before, params)
    return OPS["deduplicate"].inverse(before, after, params).delta.select(ROW_ID, "event_id")


@query("frame_equality", "SELECT true AS same, false AS changed, false AS shorter")
def frame_equality(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id")
    shuffled = e.repartition("user_id")
    changed = e.withColumn("value", F.when(F.col("event_id") == 0, F.col("value") + 1).otherwise(F.col("value")))
    row = (frame_equal(e, shuffled), frame_equal(e, changed), frame_equal(e, e.where("event_id > 0")))
    return spark.createDataFrame([row], "same boolean, changed boolean, shorter boolean")


@query(
    "step_diff",
    f"SELECT _rid, day_text AS \"before\", order_day AS \"after\" FROM {_M} WHERE day_text <> order_day ORDER BY _rid LIMIT 5",
)
def diff(spark, sf):
    before = views.messy_orders(spark, sf)
    after = OPS["standardise_format"].apply(before, {"column": "day_text", "format": "iso_date"})
    return step_diff(before, after, "day_text")


# --- loss ------------------------------------------------------------------------------------------

_STEPS = [
    ("drop_column", {"column": "empty_col"}),
    ("cast_type", {"column": "price_text", "dtype": "float", "strip_chars": "$, "}),
    ("cast_type", {"column": "mixed_text", "dtype": "float", "strip_chars": "$, "}),
    ("replace_value", {"column": "priority", "mapping": {"1-URGENT": "urgent", "5-LOW": "low"}}),
    ("standardise_format", {"column": "day_text", "format": "iso_date"}),
    ("fill_missing", {"column": "priority", "value": "x"}),
    ("deduplicate", {"subset": ["batch"]}),
    ("drop_column", {"column": "total_copy", "redundant_with": "price"}),
    ("drop_column", {"column": "priority"}),
    ("derive_column", {"name": "n", "expression": {"op": "add", "args": [{"column": "price"}, {"literal": 1}]}}),
]
# step, operation, cells that change, cells counted as affected, cells lost
_LOSS = [
    (1, "drop_column", "0", "count(*)", "0"),
    (2, "cast_type", "count(*)", "count(*)", "0"),
    (3, "cast_type", "count(*)", "count(*)", "count(*) FILTER (WHERE mixed_text LIKE 'n/a%')"),
    (4, "replace_value", *["count(*) FILTER (WHERE priority IN ('1-URGENT', '5-LOW'))"] * 2, "0"),
    (5, "standardise_format", *["count(*) FILTER (WHERE day_text <> order_day)"] * 2, "0"),
    (6, "fill_missing", *["count(*) FILTER (WHERE priority IS NULL)"] * 2, "0"),
    (7, "deduplicate", *["11 * (count(*) - count(DISTINCT batch))"] * 2, "0"),
    (8, "drop_column", "0", "count(*)", "0"),
    (9, "drop_column", "count(priority)", "count(*)", "count(priority)"),
    (10, "derive_column", "count(*)", "count(*)", "0"),
]


@query(
    "loss_per_step",
    " UNION ALL ".join(
        f"SELECT {no} AS step_no, '{op}' AS op, CAST({cells} AS BIGINT) AS cells_affected, "
        f"round(({changed}) / (11.0 * count(*)), 6) AS estimated_loss, round(({lost}) / (11.0 * count(*)), 6) AS data_loss FROM {_M}"
        for no, op, changed, cells, lost in _LOSS
    ),
)
def loss_per_step(spark, sf):
    out = losses_df(spark, estimate_losses(views.messy_orders(spark, sf), _STEPS))
    return out.select(
        "step_no", "op", "cells_affected", F.round("estimated_loss", 6).alias("estimated_loss"),
        F.round("data_loss", 6).alias("data_loss"),
    )


@query(
    "loss_expand_nested",
    """SELECT 'expand_nested' AS op, count(*) AS cells_affected,
         round(count(*) FILTER (WHERE event_id % 5 IN (2, 3)) / (2.0 * count(*)), 6) AS estimated_loss FROM events""",
)
def loss_expand(spark, sf):
    p = {"column": "details", "child_table": "Details"}
    out = losses_df(spark, estimate_losses(views.nested_events(spark, sf), [("expand_nested", p)]))
    return out.select("op", "cells_affected", F.round("estimated_loss", 6).alias("estimated_loss"))


@query(
    "loss_cumulative",
    """SELECT l_returnflag, round(1 - product(1 - least(1, greatest(0, l))), 6) AS cumulative, round(1 - product(1 - least(1, greatest(0, l))), 6) <= 0.05 AS within
       FROM (SELECT l_returnflag, l_linenumber, avg(l_tax) / 2 AS l FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""",
)
def loss_cumulative(spark, sf):
    steps = views.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg((F.avg("l_tax") / 2).alias("l"))
    out = steps.groupBy("l_returnflag").agg(F.round(cumulative_loss_column(F.col("l")), 6).alias("cumulative"))
    return out.withColumn("within", F.col("cumulative") <= 0.05)
