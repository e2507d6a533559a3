"""Input views of the registered queries. Each is written twice: as DataFrame code and as
the same SELECT for the SQL oracle. The base tables hold no dirt, so the views add some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID

DOLLAR = "$"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_rid(df: DataFrame, key: str) -> DataFrame:
    """Use an existing unique number as the row id, so that SQL can name the same rows."""
    return df.select(F.col(key).cast("long").alias(ROW_ID), *df.columns)


def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    cents = price.cast("decimal(12,2)").cast("string")
    return table(spark, sf, "orders").select(
        k.alias(ROW_ID),
        F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 9, "0")).alias("order_number"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit("B"), (k % 7).cast("string")).alias("batch"),
        F.when(k % 5 == 0, F.concat(F.lit("n/a "), cents)).otherwise(F.concat(F.lit(DOLLAR), cents)).alias("mixed_text"),
        F.concat(F.lit(DOLLAR), cents).alias("price_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        F.when(k % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(k % 3 == 1, F.date_format("o_orderdate", "d MMM yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day_text"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")).alias("status_text"),
        F.lit(None).cast("string").alias("empty_col"),
        price.alias("price"),
        price.alias("total_copy"),
    )


MESSY_ORDERS = """
  SELECT o_orderkey AS _rid,
         'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_number,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
         'B' || CAST(o_orderkey % 7 AS VARCHAR) AS batch,
         CASE WHEN o_orderkey % 5 = 0 THEN 'n/a ' ELSE '$' END || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS mixed_text,
         '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price_text,
         strftime(o_orderdate, '%Y-%m-%d') AS order_day,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y')
              WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_text,
         '  ' || o_orderstatus || ' ' AS status_text,
         CAST(NULL AS VARCHAR) AS empty_col,
         o_totalprice AS price,
         o_totalprice AS total_copy
  FROM orders"""


def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    a, tax = F.col("l_extendedprice"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        F.monotonically_increasing_id().alias(ROW_ID),
        F.col("l_orderkey").alias("order_no"),
        a.alias("net"), (a * tax).alias("levy"), (a + a * tax).alias("gross"), F.col("l_discount").alias("rebate"),
    )


LINE_TOTALS = """
  SELECT l_orderkey AS order_no, l_extendedprice AS net, l_extendedprice * l_tax AS levy,
         l_extendedprice + l_extendedprice * l_tax AS gross, l_discount AS rebate
  FROM lineitem"""


def nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event records as lists in a cell; a fifth each: strict, single quotes, cut off,
    unreadable, not nested."""
    k, p = F.col("event_id"), F.col("props")
    two = F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))
    return with_rid(table(spark, sf, "events"), "event_id").select(
        ROW_ID,
        F.col("event_id"),
        F.when(k % 5 == 0, two)
        .when(k % 5 == 1, F.replace(two, F.lit('"'), F.lit("'")))
        .when(k % 5 == 2, F.concat(F.lit("["), p, F.lit(', {"k')))
        .when(k % 5 == 3, F.lit("[{nonsense"))
        .otherwise(F.lit("plain")).alias("details"),
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order, its lines as a JSON list. Lists are one order long; the rows of
    an order are few by the meaning of the key."""
    item = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.concat(F.lit(DOLLAR), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("amount"),
    )
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.collect_list(item)).alias("line_items")
    ).select(F.col("l_orderkey").alias(ROW_ID), F.col("l_orderkey").alias("order_no"), "line_items")


def dup_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    again = e.where("event_id % 10 = 0 OR event_id % 3 = 0")
    return e.select((F.col("event_id") * 2).alias(ROW_ID), *e.columns).unionByName(
        again.select((F.col("event_id") * 2 + 1).alias(ROW_ID), *e.columns)
    )


DUP_EVENTS = """
  SELECT event_id * 2 AS _rid, * FROM events
  UNION ALL SELECT event_id * 2 + 1 AS _rid, * FROM events WHERE event_id % 10 = 0 OR event_id % 3 = 0"""


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return with_rid(table(spark, sf, "part"), "p_partkey").select(
        ROW_ID,
        F.concat(
            F.col("p_type"),
            F.when(k % 8 == 1, F.lit(" Ltd")).when(k % 8 == 3, F.lit(", LLC")).otherwise(F.lit("")),
        ).alias("supplier"),
        F.concat(F.lit("PO-"), (k % 40).cast("string")).alias("code"),
    )


SUPPLIERS = """
  SELECT p_partkey AS _rid, p_type || CASE p_partkey % 8 WHEN 1 THEN ' Ltd' WHEN 3 THEN ', LLC' ELSE '' END AS supplier,
         p_type, 'PO-' || CAST(p_partkey % 40 AS VARCHAR) AS code
  FROM part"""
