"""Order statistics of a table: the rank of every row and any page, without a task that sees all rows."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.session import scratch_dir

_ROW_BITS = 33  # of monotonically_increasing_id: partition number above, row of the partition below


class Ordered:
    """A table written once in the ranges of an order, each range sorted.

    One range shuffle, whatever is asked afterwards. The place of a row is (range, row in the range) in one number, so
    places grow with the order; the counts per range, one number for each shuffle partition, turn places into ranks.
    A page is a place interval: the Parquet statistics of all other ranges rule them out, and nothing is sorted but
    the rows of the page. Rows that are equal in the order keep one fixed place, but which one is not defined: add
    columns until the order is total. Ranks start at 1, nulls stand where ``order`` puts them, an empty table has no
    ranges and empty pages. Give a last column that differs between equal rows if one key may hold a large part of
    the table, since a range bound cannot fall between rows that are equal.
    """

    def __init__(self, df: DataFrame, *order: Column, path: str | None = None):
        self.columns = df.columns
        self._place = "_place"
        while self._place in (c.lower() for c in df.columns):
            self._place += "_"
        path = path or scratch_dir(df.sparkSession, "ordered")
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = placed.withColumn(self._place, F.monotonically_increasing_id())
        placed.write.parquet(path)
        self._table = df.sparkSession.read.schema(placed.schema).parquet(path)
        part = F.shiftright(self._place, _ROW_BITS)
        found = sorted(map(tuple, self._table.groupBy(part.alias("part")).count().collect()))
        self._parts = [p for p, _ in found]
        self._ends = list(accumulate(n for _, n in found))
        self.total = self._ends[-1] if found else 0

    def _place_of(self, rank: int) -> int:
        """Place of the row with this rank, counted from 0."""
        k = bisect_right(self._ends, rank)
        return (self._parts[k] << _ROW_BITS) + rank - (self._ends[k - 1] if k else 0)

    def rows(self, first: int, count: int) -> DataFrame:
        """``count`` rows from rank ``first`` (counted from 0) on, in order."""
        last = min(first + count, self.total) - 1
        if first < 0 or last < first:
            return self._table.where(F.lit(False)).select(*self.columns)
        inside = F.col(self._place).between(self._place_of(first), self._place_of(last))
        return self._table.where(inside).orderBy(self._place).select(*self.columns)

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        """Rows of one page (1-based) of any depth."""
        return self.rows((number - 1) * size, size)

    def ranked(self, name: str) -> DataFrame:
        """All rows with their rank (from 1) in the column ``name``; a map of one entry per range, no shuffle."""
        before = dict(zip(self._parts, [0, *self._ends], strict=False))
        part, row = F.shiftright(self._place, _ROW_BITS), F.col(self._place).bitwiseAND((1 << _ROW_BITS) - 1)
        if not before:
            return self._table.select(*self.columns, F.lit(None).cast("bigint").alias(name))
        starts = F.array(*[F.lit(before.get(p, 0)).cast("bigint") for p in range(self._parts[-1] + 1)])
        return self._table.select(*self.columns, (F.get(starts, part.cast("int")) + row + 1).alias(name))
