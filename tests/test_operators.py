"""Catalogue operations: round trips (also property-based), losses, validation."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, schema_of
from sparkclean.operators.catalogue import OPS, apply_inverse, get_op, register
from sparkclean.operators.identity import content_hash, frame_equal, with_row_ids
from sparkclean.operators import spellings
from sparkclean.operators.spellings import category_groups, entity_groups, spelling_groups, spelling_members
from sparkclean.operators.structure import has_exact_duplicates
from sparkclean.plans.loss import cumulative_loss, estimate_losses, estimate_step_loss, within_threshold

CASES = [
    ("replace_value", "status string", [("a",), ("b",), (None,), ("a",)], {"column": "status", "mapping": {"a": "x", "b": "b"}}),
    ("replace_value", "status string", [("k1",), ("k39",), (None,), ("z",)], {"column": "status", "mapping": {f"k{i}": f"v{i}" for i in range(50)}}),
    ("fill_missing", "amount double", [(1.0,), (None,), (3.0,)], {"column": "amount", "value": 0}),
    ("drop_column", "a bigint, b string, c double", [(1, "x", 1.5), (2, None, None)], {"column": "b"}),
    ("cast_type", "val string, k int", [("$10", 1), ("x", 2), (None, 3), ("1,200.5", 4)], {"column": "val", "dtype": "float", "strip_chars": "$,"}),
    ("deduplicate", "id bigint, name string", [(1, "a"), (1, "a"), (2, "b"), (1, "c"), (None, "d"), (None, "d")], {"subset": None}),
    ("deduplicate", "id bigint, name string", [(1, "a"), (1, "z"), (2, "b"), (None, "c"), (None, "d")], {"subset": ["id"]}),
    ("derive_column", "qty double, unit_price double", [(2.0, 3.0), (None, 1.0)],
     {"name": "total", "expression": {"op": "multiply", "args": [{"column": "qty"}, {"column": "unit_price"}]}}),
    ("expand_nested", "order_id bigint, lines string", [(1, '[{"a": 1}, {"a": 2}]'), (2, None), (3, "[{bad")],
     {"column": "lines", "key_column": "order_id", "child_table": "Lines"}),
    ("standardise_format", "code string", [("  a ",), ("b",), (None,)], {"column": "code", "format": "strip"}),
    ("standardise_format", "day string", [("5 Apr 2025",), ("nope",), ("2025-01-01",)], {"column": "day", "format": "iso_date"}),
]


@pytest.mark.parametrize("op,schema,rows,params", CASES)
def test_round_trip(frame, op, schema, rows, params):
    before = frame(schema, *rows)
    OPS[op].validate(params, schema_of(before))
    after = OPS[op].apply(before, params)
    restored = apply_inverse(after, OPS[op].inverse(before, after, params))
    assert frame_equal(restored, before)
    if op != "deduplicate":
        assert restored.columns == before.columns


def values(df, column):
    return [r[0] for r in df.orderBy("_rid").select(column).collect()]


def test_apply_results(frame):
    v = frame("val string", "$10", "1,200.5", "x", None, "12.9")
    cast = lambda d, s="$,": values(OPS["cast_type"].apply(v, {"column": "val", "dtype": d, "strip_chars": s}), "val")
    assert cast("float") == [10.0, 1200.5, None, None, 12.9]
    assert cast("int") == [10, 1200, None, None, 12]
    assert cast("string") == ["10", "1200.5", "x", None, "12.9"]
    d = frame("id bigint, name string", (1, "a"), (2, "b"), (1, "c"))
    kept = OPS["deduplicate"].apply(d, {"subset": ["id"]}).orderBy("_rid").collect()
    assert [(r["_rid"], r["name"]) for r in kept] == [(0, "a"), (1, "b")]


def test_divide_by_zero(frame):
    df = frame("a double, b bigint", (1.0, 0), (0.0, 0), (6.0, 3))
    p = {"name": "r", "expression": {"op": "divide", "args": [{"column": "a"}, {"column": "b"}]}}
    got = values(OPS["derive_column"].apply(df, p), "r")
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == 2.0


def test_expand_child(frame):
    df = frame(
        "order_id bigint, lines string",
        (7, '[{"sku": "A", "amount": "$1,140.00", "qty": 1}, {"sku": null, "amount": "2.50"}]'),
        (8, "[{'sku': 'C', 'extra': {'deep': True}, 'order_id': 5}]"), (9, "text"),
    )
    p = {"column": "lines", "key_column": "order_id", "child_table": "Lines"}
    child = OPS["expand_nested"].child_tables(df, p)["Lines"]
    assert child.columns == ["order_id", "sku", "amount", "qty", "extra.deep", "order_id_item"]
    assert dict(child.dtypes)["amount"] == "double" and dict(child.dtypes)["qty"] == "bigint"
    assert sorted(tuple(r) for r in child.fillna("").collect())[0][:4] == (7, "", 2.5, None)
    parent = OPS["expand_nested"].apply(df, p)
    assert parent.columns == ["_rid", "order_id", "lines_count"] and values(parent, "lines_count") == [2, 1, 0]
    by_row = OPS["expand_nested"].child_tables(df, {**p, "key_column": "_row"})["Lines"]
    assert by_row.columns[0] == "_row" and sorted(r[0] for r in by_row.collect()) == [0, 0, 1]


def test_child_without_items(frame):
    df = frame("id bigint, lines string", (1, "x"), (2, None))
    child = OPS["expand_nested"].child_tables(df, {"column": "lines", "key_column": "id", "child_table": "C"})["C"]
    assert child.columns == ["id"] and child.count() == 0


BAD = [
    ("replace_value", {"column": "n", "mapping": {"a": "b"}}), ("replace_value", {"column": "s", "mapping": {}}),
    ("replace_value", {"column": "zz", "mapping": {"a": "b"}}), ("replace_value", {"column": "s", "mapping": {"a": 1}}),
    ("fill_missing", {"column": "s"}), ("fill_missing", {"column": "s", "value": [1]}), ("fill_missing", {"column": "n", "value": "text"}),
    ("drop_column", {"column": "zz"}), ("drop_column", {}), ("cast_type", {"column": "s", "dtype": "decimal"}),
    ("deduplicate", {"subset": "s"}), ("deduplicate", {"subset": ["zz"]}),
    ("derive_column", {"name": "", "expression": {}}), ("derive_column", {"name": "s", "expression": {"op": "add", "args": [{"literal": 1}] * 2}}),
    ("derive_column", {"name": "x", "expression": {"op": "power", "args": [{"literal": 1}] * 2}}),
    ("derive_column", {"name": "x", "expression": {"op": "add", "args": [{"literal": True}, {"literal": 1}]}}),
    ("derive_column", {"name": "x", "expression": {"op": "add", "args": [{"column": "s"}, {"literal": 1}]}}),
    ("derive_column", {"name": "x", "expression": {"op": "add", "args": [{"literal": 1}]}}), ("derive_column", {"name": "x", "expression": 5}),
    ("expand_nested", {"column": "n", "child_table": "C"}), ("expand_nested", {"column": "s", "child_table": ""}),
    ("expand_nested", {"column": "s", "child_table": "C", "key_column": "zz"}),
    ("standardise_format", {"column": "s", "format": "snake"}), ("standardise_format", {"column": "n", "format": "lower"}),
]


@pytest.mark.parametrize("op,params", BAD)
def test_validation(op, params):
    with pytest.raises((ValueError, TypeError)):
        OPS[op].validate(params, {"s": "String", "n": "Float64"})


def test_catalogue_is_closed():
    assert len(OPS) == 8
    with pytest.raises(ValueError):
        get_op("explode_everything")
    with pytest.raises(ValueError):
        register(OPS["cast_type"])


def test_losses(frame):
    df = frame("a string, b double, c double", ("x", 1.0, 1.0), ("y", None, None), ("x", 3.0, 3.0), (None, 4.0, 4.0))
    steps = [
        ("replace_value", {"column": "a", "mapping": {"x": "z", "y": "y"}}), ("fill_missing", {"column": "b", "value": 0}),
        ("drop_column", {"column": "b"}), ("drop_column", {"column": "c", "redundant_with": "b"}),
        ("cast_type", {"column": "b", "dtype": "string"}), ("deduplicate", {"subset": ["a"]}),
        ("derive_column", {"name": "d", "expression": {"op": "add", "args": [{"column": "b"}, {"literal": 1}]}}),
        ("standardise_format", {"column": "a", "format": "upper"}),
    ]
    got = estimate_losses(df, steps)
    assert [round(x.estimated_loss, 4) for x in got] == [round(n / 12, 4) for n in (2, 1, 3, 0, 3, 3, 4, 3)]
    assert [x.cells_affected for x in got] == [2, 1, 4, 4, 3, 3, 4, 3]
    assert got[1].data_loss == 0 and got[2].data_loss == 0.25
    empty = df.where("false")
    assert all(x.estimated_loss == 0 for x in estimate_losses(empty, steps))


def test_large_mapping_loss(frame):
    df = frame("s string", "k1", "k2", "zz", None)
    p = {"column": "s", "mapping": {f"k{i}": f"v{i}" for i in range(60)}}
    assert estimate_step_loss(df, "replace_value", p).cells_affected == 2


def test_cumulative_loss():
    assert cumulative_loss([]) == 0.0
    assert cumulative_loss([0.01, 0.02]) == pytest.approx(1 - 0.99 * 0.98)
    assert cumulative_loss([2.0]) == 1.0 and cumulative_loss([-1.0]) == 0.0
    assert within_threshold(0.05) and not within_threshold(0.0501)


def test_duplicates_and_equality(spark, frame):
    df = frame("a bigint, b string", (1, "x"), (1, "x"), (2, None))
    assert has_exact_duplicates(df) and not has_exact_duplicates(df.where("_rid > 0"))
    assert frame_equal(df, df.repartition(3)) and not frame_equal(df, df.where("_rid > 0"))
    assert not frame_equal(df, df.select("_rid", "b", "a"))
    nan = frame("x double", float("nan"), 1.0)
    assert frame_equal(nan, frame("x double", None, 1.0))
    assert content_hash(df) == content_hash(df.repartition(3)) != content_hash(df.where("_rid > 0"))
    ids = with_row_ids(spark.range(100).repartition(5).withColumnRenamed("id", "v"))
    assert ids.select("_rid").distinct().count() == 100


# --- property based ---------------------------------------------------------------------------------

texts = st.one_of(st.none(), st.sampled_from(["a", " b ", "B", "", "x y", "1", "$2", "5 Apr 2025"]))
numbers = st.one_of(st.none(), st.sampled_from([0.0, 1.0, -2.5, 100.25]))
tables = st.lists(st.tuples(texts, numbers), min_size=1, max_size=20)
relaxed = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize(
    "op,params",
    [
        ("replace_value", {"column": "s", "mapping": {"a": "b", "B": "c"}}),
        ("fill_missing", {"column": "n", "value": 7}),
        ("drop_column", {"column": "s"}),
        ("cast_type", {"column": "s", "dtype": "float", "strip_chars": "$"}),
        ("deduplicate", {"subset": None}),
        ("deduplicate", {"subset": ["s"]}),
        ("derive_column", {"name": "d", "expression": {"op": "divide", "args": [{"column": "n"}, {"literal": 2}]}}),
        ("expand_nested", {"column": "s", "child_table": "C"}),
        ("standardise_format", {"column": "s", "format": "title"}),
    ],
)
def test_round_trip_property(frame, op, params):
    @relaxed
    @given(tables)
    def check(rows):
        before = frame("s string, n double", *rows)
        after = OPS[op].apply(before, params)
        assert frame_equal(apply_inverse(after, OPS[op].inverse(before, after, params)), before)

    check()


def groups_of(rows):
    return sorted((r["canonical"], list(r["variants"])) for r in rows)


def test_spelling_groups_do_not_depend_on_size(spark):
    """Rounds over pairs give the groups of the choice one by one, also with many values of one first word."""
    names = ["Acme", "Acme Co", "ACME-Co", "Acme, Co", "Beta.com", "Beta.com Ltd", "Beta", "(x", "", "Acme Trading", "Acme Trading Co"]
    names += [f"Acme {i} of the long list of the firms of the land" for i in range(1010)]
    df = spark.createDataFrame(list(enumerate(names)), f"{ROW_ID} bigint, firm string")
    got = groups_of(entity_groups(df, ["firm"]).collect())
    assert got == groups_of(spelling_groups([(v, 1, i) for i, v in enumerate(names)]))
    assert any(set(v) >= {"Acme", "Acme Co", "ACME-Co"} for _, v in got)


@pytest.mark.parametrize("cap", [None, 3])
def test_spelling_rounds_equal_the_choice_one_by_one(spark, cap):
    r = random.Random(11)
    parts = ["", " a", "-b", ", c", " (d", " ab", "  a", " A", "e"]
    rows = []
    for _ in range(700):
        rows.append((r.choice(["ab", "abc", "Ab", "", "x y"]) + "".join(r.choice(parts) for _ in range(r.randint(0, 4))) + r.choice(["", " "]), r.choice(["p", "p q", None])))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"{ROW_ID} bigint, firm string, other string")
    found = entity_groups(df, ["firm", "other"], cap).collect()
    for k, column in enumerate(["firm", "other"]):
        counts = {}
        for i, row in enumerate(rows):
            if row[k] is not None:
                n, first = counts.get(row[k], (0, i))
                counts[row[k]] = (n + 1, first)
        want = groups_of(spelling_groups([(v, n, first) for v, (n, first) in counts.items()], max_variants=cap))
        assert groups_of(x for x in found if x["column"] == column) == want
    assert groups_of(category_groups(df, ["firm", "other"], cap).collect()) == groups_of(found)
    assert spelling_members(df.where("1 = 0"), ["firm"]).collect() == []


@pytest.mark.parametrize("hot", [3, 100_000])
def test_spelling_pairs_need_texts_only_after_other_boundaries(spark, monkeypatch, hot):
    """Pairs and scores equal those of all pairs; a hot root is shared by tasks, and blanks need no texts."""
    r = random.Random(5)
    parts = [" a", "-b", ", c", " (d", " ab", "  a", "\ta", "\u2003a a", "e", " " + "long " * 15 + "z"]
    texts = {(r.choice(["ab", "b a", "x"]) + "".join(r.choice(parts) for _ in range(r.randint(0, 5)))).strip() for _ in range(250)}
    nodes = spark.createDataFrame([("c0", i, v) for i, v in enumerate(sorted(texts))], "col_no string, node int, spelling string")
    monkeypatch.setattr(spellings, "HOT", hot)
    got = {(p["x"], p["y"]): p["score"] for p in spellings.variant_pairs(nodes).collect()}
    own = sorted(texts)
    want = {(i, j): s for i, x in enumerate(own) for j, y in enumerate(own) if i != j and (s := spellings.variant_score(x, y)) >= 60}
    assert got == want and len(want) > 100
    root = spark.range(300).selectExpr("'c0' as col_no", "int(id) as node", "if(id = 0, 'northern house', concat('northern house ', id)) as spelling")
    monkeypatch.setattr(spellings, "_score", F.udf(lambda a, b: 1 / 0, "double"))
    assert spellings.variant_pairs(root).count() == 598


def test_spelling_chain_and_hub(spark):
    """A chain in which every spelling is like the next ones, and a root that all others extend."""
    chain = ["a" + " b" * i for i in range(12)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(chain + ["Northern House"] + [f"Northern House {i}" for i in range(3000)])], f"{ROW_ID} bigint, firm string")
    got = {r["canonical"]: r["n"] for r in spelling_members(df, ["firm"]).groupBy("canonical").agg(F.count("*").alias("n")).collect()}
    want = spelling_groups([(v, 1, i) for i, v in enumerate(chain)])
    assert got == {**{g["canonical"]: len(g["variants"]) for g in want}, "Northern House": 3001}

