"""Hash trees: which rows of two tables differ, without reading the parts that do not."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.operators.base import ROW_ID, data_columns
from sparkclean.operators.identity import row_hash
from sparkclean.session import scratch_dir

LEAF_BITS = 12  # a leaf covers 4,096 row ids
FAN_BITS = 13  # a node covers 8,192 nodes of the level below
TOP = 4  # 12 + 4 * 13 = 64: one node, or one for ids below zero as well
MOST_RANGES = 500

TREE_SCHEMA = "level int, node bigint, n bigint, x bigint, s decimal(38,0)"


def _mark() -> list[Column]:
    """Rows, xor and sum of hashes: what a node keeps of its rows, however they are divided below it."""
    return [F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").cast("decimal(38,0)").alias("s")]


class HashTree:
    """Marks of ranges of row ids, level by level, stored as a table.

    A row's hash is of its id and its columns, nulls and NaN included as in
    :func:`~sparkclean.operators.identity.row_hash`. The leaves are one aggregate with map-side combine (row ids of a
    scan run on, so a task holds few leaves); each level above is 8,192 times smaller. Row ids must be unique.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._table = spark.read.schema(TREE_SCHEMA).parquet(path)

    @classmethod
    def build(cls, df: DataFrame, path: str | None = None) -> HashTree:
        spark = df.sparkSession
        path = path or scratch_dir(spark, "tree")
        h = F.xxhash64(F.col(ROW_ID), row_hash(df))
        rows = df.select(F.shiftright(ROW_ID, LEAF_BITS).alias("node"), F.lit(1).alias("n"), h.alias("x"), F.pmod(h, F.lit(2**31 - 1)).cast("decimal(28,0)").alias("s"))
        level = rows.groupBy("node").agg(*_mark())
        for k in range(TOP + 1):
            level.select(F.lit(k).alias("level"), "node", "n", "x", "s").write.mode("overwrite").parquet(f"{path}/level={k}")
            below = spark.read.schema("node bigint, n bigint, x bigint, s decimal(38,0)").parquet(f"{path}/level={k}")
            level = below.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*_mark())
        return cls(spark, path)

    def level(self, k: int) -> DataFrame:
        """Nodes of one level; the others are other folders and are not read."""
        return self._table.where(F.col("level") == k).select("node", "n", "x", "s")

    def root(self) -> tuple[int, int, int]:
        r = self.level(TOP).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bit_xor("x"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
        return int(r[0]), int(r[1]), int(r[2])

    def differing_leaves(self, other: HashTree) -> DataFrame:
        """(leaf) whose marks are not the same: from the root down, only below nodes that differ."""
        found: DataFrame | None = None
        for k in range(TOP, -1, -1):
            a, b = self.level(k), other.level(k)
            if found is not None:
                a, b = (x.join(found, F.shiftright("node", FAN_BITS) == F.col("leaf"), "left_semi") for x in (a, b))
            a, b = a.toDF("leaf", "n", "x", "s"), b.toDF("leaf", "n2", "x2", "s2")
            both = a.join(b, "leaf", "full_outer")
            found = both.where("not (n <=> n2 and x <=> x2 and s <=> s2)").select("leaf")
        return found


def _ranges(leaves: list[int]) -> Iterator[tuple[int, int]]:
    """First and last row id of runs of leaves that follow one another."""
    start = last = None
    for leaf in sorted(leaves):
        if last is None or leaf != last + 1:
            if start is not None:
                yield start << LEAF_BITS, ((last + 1) << LEAF_BITS) - 1
            start = leaf
        last = leaf
    if start is not None:
        yield start << LEAF_BITS, ((last + 1) << LEAF_BITS) - 1


def rows_of_leaves(df: DataFrame, leaves: DataFrame) -> DataFrame:
    """The rows of some leaves. Up to a bounded number of ranges they are a condition that reaches the scan, where
    Parquet statistics rule out the other row groups; more are a semi-join."""
    some = [r[0] for r in leaves.limit(MOST_RANGES + 1).collect()]
    if len(some) > MOST_RANGES:
        return df.join(leaves, F.shiftright(ROW_ID, LEAF_BITS) == F.col("leaf"), "left_semi")
    inside = F.lit(False)
    for first, last in _ranges(some):
        inside = inside | F.col(ROW_ID).between(first, last)
    return df.where(inside)


def frame_difference(a: DataFrame, b: DataFrame, tree_a: HashTree | None = None, tree_b: HashTree | None = None) -> DataFrame:
    """(_rid, kind) of the rows that differ between two tables: ``added`` and ``gone`` in ``b``, or ``changed``.

    Columns and types must be the same. Given the trees of both, only the leaves that differ are read; rows are
    compared by their columns, NULL and NaN being equal to themselves. Equal tables give no rows.
    """
    fields = lambda d: sorted((f.name, f.dataType.simpleString()) for f in d.schema.fields)
    if fields(a) != fields(b):
        raise ValueError("the tables have other columns or types")
    leaves = (tree_a or HashTree.build(a)).differing_leaves(tree_b or HashTree.build(b))
    path = scratch_dir(a.sparkSession, "leaves")
    leaves.write.parquet(path)
    leaves = a.sparkSession.read.schema("leaf bigint").parquet(path)
    names = data_columns(a)
    values = lambda d: F.struct(F.lit(1).alias("here"), *[d[f"`{n.replace('`', '``')}`"].alias(f"c{i}") for i, n in enumerate(names)])
    left, right = (rows_of_leaves(d, leaves) for d in (a, b))
    left, right = left.select(ROW_ID, values(left).alias("old")), right.select(ROW_ID, values(right).alias("new"))
    both = left.join(right, ROW_ID, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").otherwise("changed")
    return both.select(ROW_ID, kind.alias("kind"))
