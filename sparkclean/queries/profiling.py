"""Profile, inference and entity queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.functions.text import BOOLEAN_WORDS
from sparkclean.operators.base import ROW_ID
from sparkclean.operators.infer import infer_rules
from sparkclean.operators.profile import (
    ID_NAME,
    MONEY_NAME,
    first_samples,
    profile_kpis,
    profile_table,
    safe_samples,
    sparse_columns,
)
from sparkclean.operators.relations import arithmetic_candidates, arithmetic_counts, arithmetic_relations, fill_sources
from sparkclean.operators.spellings import entity_groups
from sparkclean.queries import views
from sparkclean.queries.registry import query
from sparkclean.sources.parquet import read_parquet

# --- oracle SQL for a profile ---------------------------------------------------------------

_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_TEXT_SHARES = f"""
      count(*) FILTER (WHERE regexp_matches(c, '^\\s*[\\[{{]') AND json_valid(c)) AS nested,
      count(*) FILTER (WHERE regexp_full_match(trim(replace(replace(c, '$', ''), ',', '')), '{_NUMBER}')) AS number,
      count(*) FILTER (WHERE length(trim(c)) >= 4 AND
                       try_strptime(c, ['%Y-%m-%d', '%m/%d/%Y', '%d %b %Y']) IS NOT NULL) AS day,
      count(*) FILTER (WHERE regexp_full_match(trim(c), '[A-Za-z]{{1,10}}[-_ ]?[0-9]{{2,12}}')) AS code,
      count(*) FILTER (WHERE trim(c) <> '') AS filled,
      count(*) FILTER (WHERE lower(trim(c)) IN ({", ".join(f"'{w}'" for w in BOOLEAN_WORDS)})) AS bool"""


def _column_sql(source: str, i: int, name: str, kind: str) -> str:
    low = name.lower()
    hint, money = bool(ID_NAME.search(low)), bool(MONEY_NAME.search(low))
    number = kind.startswith(("Int", "Float"))
    shares = _TEXT_SHARES if kind == "String" else "0 AS nested, 0 AS number, 0 AS day, 0 AS code, 0 AS filled, 0 AS bool"
    if kind == "Datetime":
        semantic = "'date'"
    elif number:
        semantic = f"CASE WHEN {hint} AND d / r > 0.9 THEN 'identifier' ELSE '{'integer' if kind[0] == 'I' else 'float'}' END"
    else:
        semantic = f"""CASE WHEN nested / n >= 0.5 THEN 'nested_json'
            WHEN number / n >= 0.8 THEN '{'currency' if money else 'numeric_text'}'
            WHEN day / n >= 0.8 THEN 'date'
            WHEN {hint} AND d / r > 0.9 THEN 'identifier'
            WHEN d / r > 0.9 AND filled > 0 AND code / filled >= 0.9 THEN 'identifier'
            WHEN d = 2 AND bool = n THEN 'boolean'
            WHEN d <= 50 THEN 'category' ELSE 'free_text' END"""
    mean = "avg(c)" if number else "CAST(NULL AS DOUBLE)"
    return f"""
  SELECT '{name}' AS name, {i} AS ordinal, '{kind}' AS physical_type,
         CASE WHEN n = 0 THEN 'unknown' ELSE {semantic} END AS semantic_type,
         r - n AS null_count, round((r - n) / r, 4) AS null_pct, d AS distinct_count,
         lo AS min_value, hi AS max_value, round(m, 4) AS mean_value,
         concat_ws(',',
           CASE WHEN n > 0 AND NOT nested / n >= 0.5 AND number / n >= 0.8 THEN 'numeric_as_text' END,
           CASE WHEN n = 0 THEN 'all_null' END,
           CASE WHEN (r - n) / r >= 0.95 THEN 'sparse_95' END,
           CASE WHEN d = 1 AND n = r THEN 'constant' END,
           CASE WHEN n > 0 AND nested / n >= 0.5 THEN 'nested_json' END,
           CASE WHEN d > 50 THEN 'high_cardinality' END) AS flags
  FROM (SELECT count(*) AS r, count(c) AS n, count(DISTINCT c) AS d, CAST(min(c) AS VARCHAR) AS lo,
               CAST(max(c) AS VARCHAR) AS hi, {mean} AS m, {shares}
        FROM (SELECT {name} AS c FROM {source}))"""


def profile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(_column_sql(source, i, n, k) for i, (n, k) in enumerate(columns.items()))


def _profile_df(df: DataFrame, name: str) -> DataFrame:
    out = profile_table(df, name).to_df(df.sparkSession)
    return out.withColumn("mean_value", F.round("mean_value", 4)).withColumn("flags", F.array_join("flags", ","))


_TABLES = {
    "customer": {"c_custkey": "Int64", "c_name": "String", "c_nationkey": "Int32", "c_acctbal": "Float64", "c_mktsegment": "String"},
    "orders": {"o_orderkey": "Int64", "o_custkey": "Int64", "o_orderstatus": "String", "o_totalprice": "Float64",
               "o_orderdate": "Datetime", "o_orderpriority": "String"},
    "lineitem": {"l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32",
                 "l_quantity": "Float64", "l_extendedprice": "Float64", "l_discount": "Float64", "l_tax": "Float64",
                 "l_returnflag": "String", "l_linestatus": "String", "l_shipdate": "Datetime"},
    "part": {"p_partkey": "Int64", "p_name": "String", "p_brand": "String", "p_type": "String", "p_size": "Int32",
             "p_retailprice": "Float64"},
    "events": {"event_id": "Int64", "ts": "Datetime", "user_id": "Int64", "event_type": "String", "value": "Float64",
               "props": "String"},
    "documents": {"doc_id": "Int64", "text": "String", "lang": "String", "source": "String", "n_chars": "Int64"},
}
MESSY_COLUMNS = {
    "order_number": "String", "priority": "String", "batch": "String", "mixed_text": "String", "price_text": "String",
    "order_day": "String", "day_text": "String", "status_text": "String", "empty_col": "String",
    "price": "Float64", "total_copy": "Float64",
}


def _register(name: str, columns: dict[str, str]) -> None:
    @query(f"profile_{name}", profile_sql(name, columns))
    def run(spark, sf):
        return _profile_df(read_parquet(spark, f"{sf}/{name}.parquet"), name)


for _name, _columns in _TABLES.items():
    _register(_name, _columns)

_MESSY = f"(SELECT * FROM ({views.MESSY_ORDERS}))"


@query("profile_messy_orders", profile_sql(_MESSY, MESSY_COLUMNS))
def profile_messy_orders(spark, sf):
    return _profile_df(views.messy_orders(spark, sf), "messy_orders")


@query(
    "profile_kpis",
    f"""SELECT 'messy_orders' AS table_name, count(*) AS row_count, 11 AS column_count,
          CAST((count(priority) < count(*))::INT + 1 AS BIGINT) AS columns_with_nulls, 0 AS nested_columns,
          'all-null-columns;numeric-as-text-columns;sparse-columns' AS issues
        FROM ({views.MESSY_ORDERS})""",
)
def kpis(spark, sf):
    p = profile_table(views.messy_orders(spark, sf), "messy_orders")
    k = profile_kpis(p)
    row = (p.table_name, k["row_count"], k["column_count"], k["columns_with_nulls"], k["nested_columns"], ";".join(p.issues))
    return spark.createDataFrame(
        [row], "table_name string, row_count bigint, column_count int, columns_with_nulls bigint, nested_columns int, issues string"
    )


@query(
    "sparse_columns",
    f"SELECT 'empty_col' AS name FROM ({views.MESSY_ORDERS}) HAVING count(*) - count(empty_col) >= 0.95 * count(*)",
)
def sparse(spark, sf):
    names = sparse_columns(views.messy_orders(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(
    "first_samples",
    """SELECT 0 AS ordinal, 'event_type' AS "column", event_id AS "row", event_type AS "value" FROM
         (SELECT * FROM events ORDER BY event_id LIMIT 10)
       UNION ALL SELECT 1, 'props', event_id, props FROM (SELECT * FROM events ORDER BY event_id LIMIT 10)""",
)
def samples(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id")
    return first_samples(e.select(ROW_ID, "event_type", "props"))


@query(
    "safe_samples",
    """SELECT 0 AS ordinal, 'event_type' AS "column", string_agg(CASE WHEN length(event_type) > 4 THEN left(event_type, 2) || '***' ELSE event_type END, '|' ORDER BY event_id) AS samples
       FROM (SELECT * FROM events ORDER BY event_id LIMIT 5)""",
)
def masked_samples(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id")
    return safe_samples(e.select(ROW_ID, "event_type")).withColumn("samples", F.array_join("samples", "|"))


# --- rules -------------------------------------------------------------------------------------


@query(
    "rules_messy_orders",
    f"""WITH m AS ({views.MESSY_ORDERS})
      SELECT 'all_null' AS rule_type, 'empty_col' AS columns, CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS detail
        FROM m HAVING count(empty_col) = 0
      UNION ALL SELECT 'primary_key', 'order_number', 1.0, NULL FROM m
        HAVING count(DISTINCT order_number) = count(*) AND count(order_number) = count(*)
      UNION ALL SELECT 'arithmetic', 'total_copy,price', round(avg((abs(price - total_copy) <= 1e-6)::INT), 4), 'equality' FROM m
        HAVING avg((abs(price - total_copy) <= 1e-6)::INT) >= 0.95
      UNION ALL SELECT 'semantic_type', s.c, 0.9, s.t FROM (VALUES ('order_number', 'identifier'), ('priority', 'category'),
          ('batch', 'category'), ('price_text', 'currency'), ('order_day', 'date'), ('day_text', 'date'),
          ('status_text', 'category'), ('price', 'float'), ('total_copy', 'float')) s(c, t)
      UNION ALL SELECT 'cross_field_fill', 'priority,batch', 0.85, min(batch) FILTER (WHERE priority IS NULL) FROM m
        HAVING count(DISTINCT batch) FILTER (WHERE priority IS NULL) = 1
           AND count(DISTINCT batch) FILTER (WHERE priority IS NOT NULL) > 1""",
)
def rules_messy_orders(spark, sf):
    df = views.messy_orders(spark, sf).drop("mixed_text")
    rules = infer_rules(df, profile_table(df))

    def detail(r):
        return {
            "arithmetic": r.expression.get("kind"),
            "semantic_type": r.expression.get("semantic_type"),
            "cross_field_fill": r.expression.get("value"),
        }.get(r.rule_type)

    rows = [(r.rule_type, ",".join(r.columns), float(r.confidence), detail(r)) for r in rules]
    return spark.createDataFrame(rows, "rule_type string, columns string, confidence double, detail string")


_ARITH = ["net", "levy", "gross", "rebate"]


def _arith_sql() -> str:
    parts = []
    for cols in arithmetic_candidates(_ARITH):
        gap = f"abs({cols[0]} - ({' + '.join(cols[1:])}))"
        parts.append(
            f"SELECT '{','.join(cols)}' AS candidate, count(*) FILTER (WHERE {gap} <= 1e-6) AS matching_rows, "
            f"count({gap}) AS comparable_rows FROM t"
        )
    return f"WITH t AS ({views.LINE_TOTALS}) " + " UNION ALL ".join(parts)


@query("rule_arithmetic_candidates", _arith_sql())
def arithmetic(spark, sf):
    tests = list(arithmetic_candidates(_ARITH))
    counts = arithmetic_counts(views.line_totals(spark, sf), tests)
    rows = [(",".join(c), m, n) for c, (m, n) in zip(tests, counts)]
    return spark.createDataFrame(rows, "candidate string, matching_rows bigint, comparable_rows bigint")


# sixty columns: a base, multiples of it by powers that no sum of two others gives, and a few sums and copies of them
_WIDE = [f"w{i:02d}" for i in range(57)]
_WIDE_SUMS = {"x_total": ("w03", "w50"), "x_gross": ("w10", "w11"), "x_copy": ("w20",)}


def _wide_sql() -> str:
    columns = ", ".join(f"l_extendedprice * {1.3 + i * i * 0.37!r} + l_partkey * {i % 7}" + f" + l_quantity * {i % 11} AS {n}" for i, n in enumerate(_WIDE))
    sums = ", ".join(f"{' + '.join(parts)} AS {n}" for n, parts in _WIDE_SUMS.items())
    return f"SELECT *, {sums} FROM (SELECT {columns} FROM lineitem)"


@query(
    "rule_arithmetic_wide",
    f"""WITH t AS ({_wide_sql()})
      SELECT 'x_total,w03,w50' AS relation, count(*) FILTER (abs(x_total - (w03 + w50)) <= 1e-6) AS matching_rows, count(*) AS comparable_rows FROM t
      UNION ALL SELECT 'x_gross,w10,w11', count(*) FILTER (abs(x_gross - (w10 + w11)) <= 1e-6), count(*) FROM t
      UNION ALL SELECT 'w20,x_copy', count(*) FILTER (abs(w20 - x_copy) <= 1e-6), count(*) FROM t""",
)
def arithmetic_wide(spark, sf):
    """Over 100,000 sums of sixty columns: two hold, and one column is a copy (and so both stand in no other sum)."""
    price = F.col("l_extendedprice")
    columns = [(price * (1.3 + i * i * 0.37) + F.col("l_partkey") * (i % 7) + F.col("l_quantity") * (i % 11)).alias(n) for i, n in enumerate(_WIDE)]
    df = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(ROW_ID), *columns)
    df = df.withColumns({n: reduce(lambda x, y: x + y, map(F.col, parts)) for n, parts in _WIDE_SUMS.items()})
    names = df.columns[1:]
    rows = df.count()
    found = arithmetic_relations(df, names, dict.fromkeys(names, rows))
    return spark.createDataFrame([(",".join(c), m, n) for c, m, n in found], "relation string, matching_rows bigint, comparable_rows bigint")


_FILL_SQL = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 14 <> 0 THEN 'C' || o_custkey END AS clerk, 'B' || (o_orderkey % 7) AS batch, o_orderkey % 2 AS even,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN 'open' ELSE 'none' END AS state
  FROM orders"""
_FILL_TARGETS, _FILL_OTHERS = ("priority", "clerk", "price"), ("o_orderkey", "priority", "clerk", "batch", "even", "price", "state")


def _fill_pairs_sql() -> str:
    parts = [
        f"""SELECT '{t}' AS target, '{o}' AS source, CAST(min({o}) FILTER ({t} IS NULL) AS VARCHAR) AS value FROM t
            HAVING count({o}) FILTER ({t} IS NULL) = count(*) FILTER ({t} IS NULL) AND count(DISTINCT {o}) FILTER ({t} IS NULL) = 1
               AND count(DISTINCT {o}) FILTER ({t} IS NOT NULL) > 1"""
        for t in _FILL_TARGETS for o in _FILL_OTHERS if o != t
    ]
    return f"WITH t AS ({_FILL_SQL}) " + " UNION ALL ".join(parts)


@query("rule_cross_field_fill", _fill_pairs_sql())
def cross_field_fill(spark, sf):
    """Three columns with missing values against all others, in one scan."""
    k = F.col("o_orderkey")
    df = views.table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 14 != 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("clerk"),
        F.concat(F.lit("B"), (k % 7).cast("string")).alias("batch"), (k % 2).alias("even"),
        F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, "open").otherwise("none").alias("state"),
    )
    nulls = df.agg(*[F.count_if(F.col(t).isNull()).alias(t) for t in _FILL_TARGETS]).first().asDict()
    found = [(t, o, str(v)) for t, o, v in fill_sources(df, nulls, list(_FILL_OTHERS))]
    return spark.createDataFrame(found, "target string, source string, value string")


@query(
    "rule_one_to_many",
    """SELECT 'props' AS columns, 'event_id' AS parent_key, 'Props' AS child_table, count(*) AS item_count, 'k' AS item_keys
       FROM events WHERE json_valid(props)""",
)
def one_to_many(spark, sf):
    e = views.with_rid(views.table(spark, sf, "events"), "event_id").select(ROW_ID, "event_id", "props")
    rules = [r for r in infer_rules(e, profile_table(e)) if r.rule_type == "one_to_many"]
    rows = [
        (",".join(r.columns), r.expression["parent_key"], r.expression["child_table"], r.expression["item_count"],
         ",".join(r.evidence["sample_item_keys"]))
        for r in rules
    ]
    return spark.createDataFrame(
        rows, "columns string, parent_key string, child_table string, item_count bigint, item_keys string"
    )


@query(
    "entity_groups",
    f"""WITH v AS (SELECT supplier, p_type, count(*) AS n FROM ({views.SUPPLIERS}) GROUP BY ALL)
      SELECT 'supplier' AS "column",
             arg_max(trim(supplier), (n, -length(supplier))) AS canonical,
             string_agg(supplier, '|' ORDER BY n DESC, length(supplier), supplier) AS variants
      FROM v GROUP BY p_type
      UNION ALL SELECT DISTINCT 'code', code, code FROM ({views.SUPPLIERS})""",
)
def entities(spark, sf):
    found = entity_groups(views.suppliers(spark, sf), ["supplier", "code"])
    return found.select("column", "canonical", F.array_join("variants", "|").alias("variants"))
