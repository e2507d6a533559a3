"""Cells and keys that are too many for one list."""

import pytest
from pyspark.sql import functions as F

from sparkclean.functions import nested
from sparkclean.functions.nested import nested_summary, read_cell, read_large_cell
from sparkclean.operators import infer
from sparkclean.operators.derive import ExpandNested
from sparkclean.operators.infer import nested_facts

CELLS = [
    '[{"a": 1}, {"b": [1, 2]}, 3]', "[{'a': 1}, {'b': (1, 2,)}, None,]", "[{'a': 1}, {'b'", '[{"a": 1}, {"b": 2', "[]", "[,]", "[ ]",
    "[{'a': 1},,]", "[{'a': 1}] x", '[{"a": 1}] 2', "[{'a': 1}, 'x' 'y']", "[nonsense", "[{'a': {'b': True, None: 2}}]", "{'a': 1}", '{"a": 1}',
    "[['x'], {'a': 1}]", "[[{'a': 1}]]", "[{'a': 1} {'b': 2}]", "[1 2]", "[{}, {'a': []}]", '[{"a": NaN}]', "[", "[{'a': 1}], [{'b': 2}]", " [{'a': ']'}] ",
    "[(), {'a': 1}]", "[:1]", "['a': 1]", "[{'a': 1}, -]", "[{'a': 0x1}]", "[\"\\u12\"]", "({'a': 1},)", "plain",
    "[{'a': 1, 'True': 'None, True'}, { 'b' : -2.50 , 'c': None}, {'d': True}, {'e': False}]", "[{'a': 01}, {'b': 2}]", "[{'a': 1.}, {'b': 2}]",
    "[{'a': 1}, {'b': 2},]", "[{'a': 1}, {'b': 2},,]", "[{'a': 1}, {'b': 2}, {'c\\n': 'é'}, {'d': \"x'y\"}]", "[{'a': 1,}, {'b': 2}]", "[{'a': 1}, {'b': 2}",
    "[{'a': 1}, {'b': 2}] x", "[{'a': -0}, {'a': -0.0}, {'a': 1e5}, {'a': Truey}]", "[{'a': 1, 'a': 2}, {'b': 2}]", "[{'a': 1}, {'b': 2}, 'x']",
]


@pytest.mark.parametrize("cell", CELLS)
@pytest.mark.parametrize("size", [1, 2000])
def test_reading_in_parts_is_reading_at_once(cell, size, monkeypatch):
    monkeypatch.setattr(nested, "PART_ITEMS", size)
    *parts, (status, end) = read_large_cell(cell)
    assert end is None
    assert (status, [x for form, items in parts if form == status for x in items]) == read_cell(cell)


def test_large_cells_are_counted_in_parts(spark, monkeypatch):
    filler = "x" * 3000
    cells = [f"[{{'a': {i}, 'b': '{filler}'}}, {{'a': 2}}]" for i in range(3)] + ["[{'a': 1}]", '[{"a": 1}, {"a": 2}]', None, "plain", f"[{{\"a\": 1}}, {{'{filler}", f"[{filler}"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    want = nested_summary(df, "c").first()
    seen = []
    monkeypatch.setattr(nested, "LARGE_BYTES", 1000)
    whole = nested._large_cells
    monkeypatch.setattr(nested, "_large_cells", lambda d: seen.append(d.count()) or whole(d))
    assert nested_summary(df, "c").first() == want
    assert seen == [5] and tuple(want) == (1, 4, 1, 1, 2, 10)


def test_item_keys_that_reach_the_driver_are_bounded(spark, monkeypatch):
    df = spark.range(50).select(F.concat(F.lit("[{'k"), F.col("id").cast("string"), F.lit("': 1}, {'k': 2}]")).alias("c"))
    assert nested_facts(df, "c") == (100, 51, sorted(["k", *(f"k{i}" for i in range(50))]))
    monkeypatch.setattr(infer, "NAMED_KEYS", 3)
    assert nested_facts(df, "c") == (100, 51, ["k", "k0", "k1"])
    assert nested_facts(df.limit(0), "c") == (0, 0, [])


def test_fields_are_ordered_by_their_first_place_without_a_sort(spark):
    rows = [(5, '[{"z": 1}, {"b": "$1.50", "a": true}]'), (2, '[{"b": "$2.25"}, {"c": 1.5, "a": false}]'), (1, '[{"y": "n"}]'), (2, '[{"w": 1}]')]
    df = spark.createDataFrame(rows, "_rid bigint, c string")
    op, p = ExpandNested(), {"column": "c", "parent_key": "_row", "child_table": "C"}
    assert op.child_fields(df, p) == [("y", "string"), ("b", "cents"), ("w", "bigint"), ("c", "double"), ("a", "boolean"), ("z", "bigint")]
