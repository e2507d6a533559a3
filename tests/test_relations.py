"""Relations between columns and order statistics against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkclean.operators import relations
from sparkclean.operators.base import ROW_ID
from sparkclean.operators.order import Ordered
from sparkclean.operators.relations import arithmetic_candidates, arithmetic_relations, candidate_counts, fill_sources


def numbers(seed, rows, columns):
    """Columns of which some are sums or copies of others, nearly always, at the limit, or only where not null."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        row = [round(r.uniform(0, 100), 2) for _ in range(columns - 6)]
        row += [row[0] + row[1], row[2], row[1] + row[3] if i % 100 >= 3 else -1.0, row[1] + row[4] if i % 100 >= 6 else -1.0]
        row += [row[0] + row[3] if i < 5 else None, math.nan if i % 3 else row[5]]
        out.append([None if r.random() < 0.02 else x for x in row])
    return out


def plain_relations(rows, names):
    found = []
    for cols in arithmetic_candidates(names):
        at = [names.index(c) for c in cols]
        full = [[row[i] for i in at] for row in rows if all(row[i] is not None for i in at)]
        hits = sum(abs(a - sum(rest)) <= 1e-6 for a, *rest in full)
        if full and hits / len(full) >= 0.95:
            found.append((cols, hits, len(full)))
    return found


@pytest.mark.parametrize(("seed", "rows"), [(1, 500), (2, 40), (3, 3), (4, 0)])
def test_arithmetic_relations(spark, seed, rows):
    names = [f"a.{i}" for i in range(13)]
    data = numbers(seed, rows, 13)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"{ROW_ID} bigint, " + ", ".join(f"`{n}` double" for n in names)).repartition(3)
    present = {n: sum(r[i] is not None for r in data) for i, n in enumerate(names)}
    want = plain_relations(data, names)
    assert arithmetic_relations(df, names, present) == want
    if rows == 500:
        assert {("a.7", "a.0", "a.1"), ("a.2", "a.8"), ("a.9", "a.1", "a.3")} <= {c for c, _, _ in want}
        assert arithmetic_relations(df, names, present, budget=100) == plain_relations(data, names)[: len(arithmetic_relations(df, names, present, budget=100))]
        exact = candidate_counts(df, names, [(7, 0, 1), (2, 8)])
        assert [x.tolist() for x in exact] == [[m for c, m, _ in want if c in (("a.7", "a.0", "a.1"), ("a.2", "a.8"))][::-1], [n for c, _, n in want if c in (("a.7", "a.0", "a.1"), ("a.2", "a.8"))][::-1]]


def test_part_disproves_most_candidates(spark, monkeypatch):
    """All rows are read twice, whatever the number of candidates, and the second time for few of them."""
    seen = []
    count = relations.candidate_counts
    monkeypatch.setattr(relations, "candidate_counts", lambda df, names, c: seen.append(len(c)) or count(df, names, c))
    names = [f"a{i}" for i in range(20)]
    data = numbers(5, 3000, 20)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"{ROW_ID} bigint, " + ", ".join(f"{n} double" for n in names))
    present = {n: sum(r[i] is not None for r in data) for i, n in enumerate(names)}
    found = arithmetic_relations(df, names, present)
    assert seen[0] == math.comb(20, 2) + 20 * math.comb(19, 2) and len(seen) == 2 and seen[1] < 700
    assert ("a14", "a0", "a1") in [c for c, _, _ in found]


def plain_fills(rows, names, targets):
    found = []
    for t, o in itertools.product(targets, names):
        if t == o:
            continue
        there = [r[o] for r in rows if r[t] is None]
        here = {r[o] for r in rows if r[t] is not None and r[o] is not None}
        if None not in there and len(set(there)) == 1 and len(here) > 1:
            found.append((t, o, there[0]))
    return found


def test_fill_sources(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        row = {"k": i, "s": r.choice(["x", "y", ""]), "n": r.choice([1.5, 2.5, 3.5, None]), "b": r.random() < 0.5, "d": None if i % 3 else "d"}
        row |= {f"t{j}": None if (i * 7 + j) % 61 == 0 else j for j in range(70)}
        row |= {"a": None if row["s"] == "x" else "a", "c": None if row["n"] == 2.5 else 1, "e": None if row["b"] else "e", "f": None if row["s"] == "" else "f"}
        rows.append(row)
    names = list(rows[0])
    types = {"k": "bigint", "s": "string", "n": "double", "b": "boolean", "d": "string", "a": "string", "e": "string", "f": "string"}
    df = spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join(f"{n} {types.get(n, 'int')}" for n in names)).repartition(4)
    targets = {n: c for n in names if 2 <= (c := sum(x[n] is None for x in rows)) < len(rows)}
    assert len(targets) > 62
    got = fill_sources(df, targets, names)
    assert got == plain_fills(rows, names, targets)
    assert {("a", "s", "x"), ("c", "n", 2.5), ("f", "s", "")} <= set(got)
    assert fill_sources(df, {}, names) == [] and fill_sources(df.where("1 = 0"), targets, names) == []


# --- order statistics ----------------------------------------------------------------------------


def test_pages_of_any_depth(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1, 2, 3]), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, p int, _place string").repartition(5)
    order = [F.col("p").desc_nulls_last(), F.col("k")]
    want = [k for k, *_ in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = Ordered(df, *order)
        assert len(found._parts) > 1 and found.total == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for number, size in [(1, 20), (50, 20), (100, 20), (101, 20), (3, 700), (1, 5000), (2, 1999)]:
        page = found.page(number, size)
        assert page.columns == df.columns
        assert [x["k"] for x in page.collect()] == want[(number - 1) * size : number * size]
    ranks = {x["k"]: x["rank"] for x in found.ranked("rank").collect()}
    assert [k for k, _ in sorted(ranks.items(), key=lambda x: x[1])] == want and sorted(ranks.values()) == list(range(1, 2001))


def test_a_page_reads_its_range_only(spark):
    """No task is given more than the rows of the ranges that hold the page."""
    df = spark.range(40_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = Ordered(df, F.col("h"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    page = found.page(1000, 20)
    assert page.count() == 20
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_place), GreaterThanOrEqual(_place," in plan
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_order_of_nothing(spark):
    found = Ordered(spark.createDataFrame([], "k int"), F.col("k"))
    assert (found.total, found.page().collect(), found.ranked("r").collect()) == (0, [], [])
