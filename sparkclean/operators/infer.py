"""Rule inference: seven kinds of rules from a table and its profile."""

from __future__ import annotations

import itertools
import json
import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkclean.functions.nested import child_table_name, with_parsed_cells
from sparkclean.operators.base import ROW_ID, is_numeric, q
from sparkclean.operators.profile import CATEGORY_MAX, TableProfile
from sparkclean.operators.relations import EQUAL_TOLERANCE, arithmetic_relations, fill_sources, untested_candidates
from sparkclean.operators.spellings import category_groups
from sparkclean.session import scratch_dir

log = logging.getLogger(__name__)

NAMED_KEYS = 5000  # item keys that the evidence of a rule names; a rule with more also says how many there are

RULE_SCHEMA = (
    "rule_type string, columns array<string>, expression string, confidence double, evidence string, source string"
)


@dataclass
class InferredRule:
    rule_type: str
    columns: list[str]
    expression: dict[str, Any]
    confidence: float
    evidence: dict[str, Any] = field(default_factory=dict)
    source: str = "deterministic"


def rules_df(spark, rules: list[InferredRule]) -> DataFrame:
    rows = [
        (r.rule_type, r.columns, json.dumps(r.expression, default=str), float(r.confidence),
         json.dumps(r.evidence, default=str), r.source)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


# --- numeric relations ---------------------------------------------------------------------------


def _pick_target(a: str, b: str) -> tuple[str, str]:
    """Which of two equal columns is the redundant one: the one named like a total if only
    one is, else the one later in the alphabet."""
    totals = ["total" in x.lower() for x in (a, b)]
    if totals[0] != totals[1]:
        return (a, b) if totals[0] else (b, a)
    return (a, b) if a.lower() > b.lower() else (b, a)


def _arithmetic_rules(df: DataFrame, profile: TableProfile, budget: int | None) -> list[InferredRule]:
    numeric = [f.name for f in df.schema.fields if f.name != ROW_ID and is_numeric(f.dataType)]
    if left := untested_candidates(len(numeric), budget):
        log.warning("%d arithmetic candidates are not tested: the budget is %d", left, budget)
    present = {c.name: profile.row_count - c.null_count for c in profile.columns}
    rules = []
    for cols, hits, rows in arithmetic_relations(df, numeric, present, budget):
        evidence = {"matching_rows": hits, "total_rows": rows, "tolerance": EQUAL_TOLERANCE}
        if len(cols) == 2:
            target, formula = _pick_target(*cols)
            names, kind = [target, formula], "equality"
        else:
            target, formula = cols[0], f"{cols[1]} + {cols[2]}"
            names, kind = list(cols), "sum"
        rules.append(InferredRule(
            "arithmetic", names, {"target": target, "formula": formula, "kind": kind}, round(hits / rows, 4), evidence
        ))
    return rules


# --- nested records, fills -----------------------------------------------------------------------


def nested_facts(df: DataFrame, column: str) -> tuple[int, int, list[str]]:
    """Items in all cells, number of different item keys, and these keys in order: all of them, or the first
    ``NAMED_KEYS`` if there are more. No more than those reach the driver."""
    parsed = with_parsed_cells(df.select(q(column).alias("c")), "c", "p").select(F.col("p.items").alias("items"))
    # one pass: the distinct keys of a cell travel with its item count, NULL carries the count
    names = F.array_distinct(F.flatten(F.transform("items", F.map_keys)))
    marks = F.concat(F.array(F.lit(None).cast("string")), names)
    counted = (
        parsed.select(F.size("items").cast("long").alias("n"), marks.alias("marks"))
        .select("n", F.explode_outer("marks").alias("k"))
        .groupBy("k")
        .agg(F.sum("n").alias("n"))
    )
    path, seen = scratch_dir(df.sparkSession, "item_keys"), Observation("item_keys")
    total = F.max(F.when(F.col("k").isNull(), F.col("n")))
    counted.observe(seen, total.alias("items"), F.count("k").alias("keys")).select("k").write.parquet(path)
    found = df.sparkSession.read.schema("k string").parquet(path).where(F.col("k").isNotNull())
    got = seen.get
    return got["items"] or 0, got["keys"], [r["k"] for r in found.orderBy("k").limit(NAMED_KEYS).collect()]


def _fill_rules(df: DataFrame, profile: TableProfile) -> list[InferredRule]:
    targets = {c.name: c.null_count for c in profile.columns if 2 <= c.null_count < profile.row_count}
    others = [c.name for c in profile.columns if _can_compare(df, c.name)]
    return [
        InferredRule(
            "cross_field_fill", [target, other], {"target": target, "source": other, "value": value},
            0.85, {"null_rows_matched": targets[target]},
        )
        for target, other, value in fill_sources(df, targets, others)
    ]


def _can_compare(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant", "array", "struct", "binary")


def infer_rules(
    df: DataFrame,
    profile: TableProfile,
    arithmetic_tests: int | None = None,
    max_variants: int | None = None,
) -> list[InferredRule]:
    rows = profile.row_count
    rules = [
        InferredRule("all_null", [c.name], {"column": c.name}, 1.0, {"null_pct": c.null_pct, "row_count": rows})
        for c in profile.columns
        if rows and c.null_count == rows
    ]
    key = next(
        (
            c.name
            for c in profile.columns
            if c.semantic_type == "identifier" and c.null_count == 0 and c.distinct_count == rows > 0
        ),
        None,
    )
    if key:
        rules.append(InferredRule(
            "primary_key", [key], {"column": key}, 1.0, {"distinct_count": rows, "row_count": rows}
        ))

    text = [
        c for c in profile.columns
        if c.semantic_type in ("category", "free_text") and 2 <= c.distinct_count <= CATEGORY_MAX
    ]
    if text:
        groups: dict[str, list[dict]] = {}
        # at most CATEGORY_MAX rows per column
        for r in category_groups(df, [c.name for c in text], max_variants).orderBy("column", "group_no").collect():
            groups.setdefault(r["column"], []).append({"canonical": r["canonical"], "variants": list(r["variants"])})
        for c in text:
            found = groups.get(c.name, [])
            varied = sum(len(g["variants"]) > 1 for g in found)
            if varied:
                rules.append(InferredRule(
                    "entity_group", [c.name], {"column": c.name, "groups": found},
                    round(1.0 - varied / c.distinct_count, 4),
                    {
                        "distinct_count": c.distinct_count,
                        "groups_with_variants": varied,
                        "total_variants": sum(len(g["variants"]) for g in found),
                    },
                ))

    rules += _arithmetic_rules(df, profile, arithmetic_tests)

    for c in profile.columns:
        if c.semantic_type == "nested_json":
            total, different, keys = nested_facts(df, c.name)
            rules.append(InferredRule(
                "one_to_many", [c.name],
                {"parent_key": key or "_row", "child_table": child_table_name(c.name), "item_count": total},
                1.0, {"sample_item_keys": keys} | ({"item_keys": different} if different > len(keys) else {}),
            ))
    rules += [
        InferredRule(
            "semantic_type", [c.name], {"column": c.name, "semantic_type": c.semantic_type},
            0.9, {"physical_type": c.physical_type},
        )
        for c in profile.columns
        if c.semantic_type not in ("unknown", "free_text")
    ]
    return rules + _fill_rules(df, profile)


def merge_rules(*sources: list[InferredRule]) -> list[InferredRule]:
    """Earlier sources win on the same (rule type, columns)."""
    seen: dict[tuple, InferredRule] = {}
    for rule in itertools.chain(*sources):
        seen.setdefault((rule.rule_type, tuple(rule.columns)), rule)
    return list(seen.values())
