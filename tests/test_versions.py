"""Hash trees and incremental execution."""

import random

import pytest
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID
from sparkclean.operators.tree import LEAF_BITS, HashTree, frame_difference, rows_of_leaves
from sparkclean.plans.incremental import execute_incremental
from sparkclean.plans.plan import Plan, Step
from sparkclean.plans.versions import VersionStore

SCHEMA = f"{ROW_ID} bigint, `a.b` string, x double, n int"


def table(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def test_difference_of_tables(spark):
    r = random.Random(4)
    a = {k: (r.choice(["x", "", None]), r.choice([1.5, None, float("nan")]), r.choice([1, None])) for k in [*range(40), *range(1 << 40, (1 << 40) + 5), -7, -(1 << 50), (1 << 62)]}
    b = dict(a)
    for k in (3, 1 << 40, -7):
        b[k] = ("other", 2.0, None)
    del b[5], b[1 << 62]
    b |= {99: (None, None, None), 1 << 33: ("new", 0.0, 1)}
    b[7], b[8] = (None, 1.5, 1), ("x", None, 1)
    a[7], a[8] = b[8], b[7]  # two rows that change places
    want = sorted([(3, "changed"), (1 << 40, "changed"), (-7, "changed"), (5, "gone"), (1 << 62, "gone"), (99, "added"), (1 << 33, "added"), (7, "changed"), (8, "changed")])
    left, right = table(spark, a), table(spark, b).select("n", "x", "`a.b`", ROW_ID)
    assert sorted(map(tuple, frame_difference(left, right).collect())) == want
    assert frame_difference(left, left.repartition(3)).collect() == []
    assert HashTree.build(left).root() == HashTree.build(left.repartition(5)).root() != HashTree.build(table(spark, b)).root()
    none = left.where("1 = 0")
    assert HashTree.build(none).root() == (0, 0, 0)
    assert {x["kind"] for x in frame_difference(none, left).collect()} == {"added"}
    with pytest.raises(ValueError):
        frame_difference(left, right.drop("n"))


def test_difference_reads_the_ranges_that_changed(spark, tmp_path):
    """One changed row in twenty leaves: the scan gives the rows of one row group, not the table."""
    rows = 20 << LEAF_BITS
    df = spark.range(rows).select(F.col("id").alias(ROW_ID), F.xxhash64("id").alias("x"))
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    writer = lambda d: d.coalesce(1).write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 1000)
    writer(df).parquet(a)
    writer(df.withColumn("x", F.when(F.col(ROW_ID) == 50_000, F.lit(0)).otherwise(F.col("x")))).parquet(b)
    left, right = spark.read.parquet(a), spark.read.parquet(b)
    leaves = HashTree.build(left).differing_leaves(HashTree.build(right))
    assert [x["leaf"] for x in leaves.collect()] == [50_000 >> LEAF_BITS]
    assert [tuple(x) for x in frame_difference(left, right).collect()] == [(50_000, "changed")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        part = rows_of_leaves(left, leaves)
        assert len(part.collect()) == 1 << LEAF_BITS
        scan = part._jdf.queryExecution().executedPlan()
        found = part._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert found.metrics().apply("numOutputRows").value() <= rows // 2, scan.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def steps(*subset):
    found = [
        Step("standardise_format", {"column": "name", "format": "upper"}), Step("fill_missing", {"column": "zone", "value": "none"}),
        Step("expand_nested", {"column": "items", "key_column": "k", "child_table": "Items"}),
    ]
    if subset:
        found.append(Step("deduplicate", {"subset": None if subset == ("*",) else list(subset)}))
    found.append(Step("cast_type", {"column": "size", "dtype": "float", "strip_chars": ""}))
    for i, s in enumerate(found, 1):
        s.step_no, s.decision = i, "accepted"
    return Plan(found, status="approved")


@pytest.mark.parametrize("subset", [(), ("name",)])
def test_incremental_equals_the_full_run(spark, tmp_path, subset):
    r = random.Random(8)
    row = lambda k: (f"k{k % 40}", r.choice(["a", "A", "b", None]), r.choice(["z", None]), r.choice(['[{"n": 1}]', '[{"n": 1}, {"n": 2}]', None]), r.choice(["1", "2.5", "x", None]))
    schema = f"{ROW_ID} bigint, k string, name string, zone string, items string, size string"
    data = {k: row(k) for k in range(60)}
    store, plan = VersionStore(spark, str(tmp_path / "v")), steps(*subset)
    store.execute(plan, spark.createDataFrame([(k, *v) for k, v in data.items()], schema))
    for turn in range(3):
        if turn == 0:  # lists stay as they are
            data |= {k: (data[k][0], "C", *data[k][2:]) for k in (3, 9)}
        elif turn == 1:
            for k in (0, 1, 30):
                del data[k]
            data |= {k: row(k) for k in (5, 6, 100, 101)}
        df = spark.createDataFrame([(k, *v) for k, v in data.items()], schema).repartition(2)
        number = execute_incremental(store, plan, df)
        main, children = plan.run(df)
        plain = lambda d: sorted(map(repr, d.collect()))
        assert store.read(number).columns == main.columns and plain(store.read(number)) == plain(main)
        assert plain(store.read_children(number)["Items"]) == plain(children["Items"])
        paths = [store.record(n)["children"]["Items"] for n in (number, max(1, number - 2) if turn else len(plan.steps))]
        assert (paths[0] == paths[1]) == (turn != 1)
    assert store.record(number)["path"] == store.record(number - 2)["path"]  # the last turn changed nothing
    assert store.same_rows(number, number - 2) and store.verify_files(number)
    with pytest.raises(ValueError):
        execute_incremental(store, plan, df.drop("zone"))
