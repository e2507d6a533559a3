"""Relations between columns: sums and equalities of numbers, values that stand where another column is missing."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.operators.base import ROW_ID, q

# --- fixed values ------------------------------------------------------------------------
EQUAL_TOLERANCE = 1e-6
EQUAL_SHARE = 0.95
# -------------------------------------------------------------------------------------------
FEW = 50  # so many candidates are counted as expressions of one aggregate
PART = 0.08  # of the rows: somewhat more than the share of misses that disproves a candidate
CANDIDATES_PER_SCAN = 1_000_000
ROWS_PER_BLOCK = 1000


def arithmetic_candidates(columns: list[str], budget: int | None = None) -> Iterator[tuple[str, ...]]:
    """Pairs (a = b) first, then triples (a = b + c); all of them unless a budget is given."""
    pairs = itertools.combinations(columns, 2)
    triples = (
        (a, b, c)
        for a in columns
        for b, c in itertools.combinations([x for x in columns if x != a], 2)
    )
    return itertools.islice(itertools.chain(pairs, triples), budget)


def untested_candidates(columns: int, budget: int | None) -> int:
    """How many candidates of that many columns a budget leaves out."""
    total = math.comb(columns, 2) + columns * math.comb(max(columns - 1, 0), 2)
    return max(0, total - budget) if budget is not None else 0


def arithmetic_counts(df: DataFrame, candidates: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """(matching rows, comparable rows) of a few candidates in one aggregate."""
    if not candidates:
        return []
    aggs = []
    for i, cols in enumerate(candidates):
        a, *rest = [q(c).cast("double") for c in cols]
        gap = F.abs(a - (rest[0] if len(rest) == 1 else rest[0] + rest[1]))
        aggs.append(F.count_if(gap <= EQUAL_TOLERANCE).alias(f"m{i}"))
        aggs.append(F.count(gap).alias(f"n{i}"))
    r = df.agg(*aggs).first()
    return [(r[f"m{i}"], r[f"n{i}"]) for i in range(len(candidates))]


# --- many candidates -----------------------------------------------------------------------------


def _by_sum(candidates: list[tuple[int, ...]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Candidates that share the right side: (b, c or -1, columns a, places in the list)."""
    groups: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for place, (a, b, *c) in enumerate(candidates):
        left, where = groups.setdefault((b, c[0] if c else -1), ([], []))
        left.append(a)
        where.append(place)
    return [(b, c, np.array(left), np.array(where)) for (b, c), (left, where) in groups.items()]


def block_counts(values: np.ndarray, there: np.ndarray, groups: list, hits: np.ndarray, rows: np.ndarray) -> None:
    """Add matching and comparable rows of a block to ``hits`` and ``rows``; columns by rows, ``there`` where not null."""
    full = bool(there.all())
    with np.errstate(invalid="ignore", over="ignore"):
        for b, c, left, where in groups:
            right = values[b] if c < 0 else values[b] + values[c]
            close = np.abs(values[left] - right) <= EQUAL_TOLERANCE
            if full:
                hits[where] += np.count_nonzero(close, axis=1)
                rows[where] += values.shape[1]
            else:
                both = there[left] & (there[b] if c < 0 else there[b] & there[c])
                hits[where] += np.count_nonzero(close & both, axis=1)
                rows[where] += np.count_nonzero(both, axis=1)


def candidate_counts(df: DataFrame, columns: list[str], candidates: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(matching rows, comparable rows) of any number of candidates, given as column numbers, in one scan.

    A task keeps two numbers per candidate and sends them once; the driver gets as many.
    """
    groups, size, names = _by_sum(candidates), len(candidates), [f"c{i}" for i in range(len(columns))]

    def run(batches):
        hits, rows = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(start, ROWS_PER_BLOCK)
                there = np.array([part.column(n).is_valid().to_numpy(zero_copy_only=False) for n in names])
                values = np.array([part.column(n).fill_null(0.0).to_numpy(zero_copy_only=False) for n in names])
                block_counts(values, there, groups, hits, rows)
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(hits[seen]), pa.array(rows[seen])], ["candidate", "hits", "rows"])

    numbers = df.select(*[q(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    sums = numbers.mapInArrow(run, "candidate bigint, hits bigint, rows bigint").groupBy("candidate").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    found = sums.toArrow()  # at most one row per candidate of the scan
    hits, rows = np.zeros(size, np.int64), np.zeros(size, np.int64)
    where = found["candidate"].to_numpy()
    hits[where], rows[where] = found["hits"].to_numpy(), found["rows"].to_numpy()
    return hits, rows


def part_of_rows(df: DataFrame, share: float = PART) -> DataFrame:
    """The rows whose hashed id falls into a share of all hashes."""
    return df.where(F.pmod(F.xxhash64(F.col(ROW_ID)), F.lit(10_000)) < round(share * 10_000))


def arithmetic_relations(
    df: DataFrame, columns: list[str], present: dict[str, int], budget: int | None = None, share: float = EQUAL_SHARE
) -> list[tuple[tuple[str, ...], int, int]]:
    """(columns, matching rows, comparable rows) of all candidates that hold on ``share`` of their comparable rows.

    ``present`` holds the rows in which each column is not null. Elimination with proof: no candidate has more
    comparable rows than its scarcest column, so one that misses on more than 1 - ``share`` of that many rows is out
    whatever the other rows hold. A part of the rows somewhat larger than that disproves all that hardly ever hold;
    the rest, and all that the part could not disprove, are counted on all rows. Nothing is decided by an estimate.
    Two scans for each million of candidates.
    """
    left = arithmetic_candidates(columns, budget)
    number = {c: i for i, c in enumerate(columns)}
    found: list[tuple[tuple[str, ...], int, int]] = []
    while chunk := list(itertools.islice(left, CANDIDATES_PER_SCAN)):
        if len(chunk) <= FEW:
            counted = arithmetic_counts(df, chunk)
        else:
            coded = [tuple(number[c] for c in names) for names in chunk]
            hits, rows = candidate_counts(part_of_rows(df), columns, coded)
            most = np.array([min(present[c] for c in names) for names in chunk], np.float64)
            stays = np.flatnonzero(rows - hits <= (1 - share) * most * (1 + 1e-9))
            chunk = [chunk[i] for i in stays]
            if not chunk:
                continue
            hits, rows = candidate_counts(df, columns, [coded[i] for i in stays])
            counted = list(zip(hits.tolist(), rows.tolist(), strict=True))
        found += [(names, m, n) for names, (m, n) in zip(chunk, counted, strict=True) if n and m / n >= share]
    return found


# --- values beside missing ones ---------------------------------------------------------------------


_PLAIN = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
_BITS = 62


def _marks(df: DataFrame, name: str) -> list:
    """What tells whether all values of a column are one: the values, or two hashes of a text."""
    if isinstance(df.schema[name].dataType, _PLAIN):
        return [q(name)]
    return [F.when(q(name).isNotNull(), F.xxhash64(q(name))), F.when(q(name).isNotNull(), F.xxhash64(F.lit(1), q(name)))]


def fill_sources(df: DataFrame, targets: dict[str, int], others: list[str]) -> list[tuple[str, str, Any]]:
    """(target, other, value): where the target is null the other column always holds that one value, elsewhere more.

    ``targets`` holds the nulls of each target. One scan for any number of pairs: rows are aggregated by the pattern
    of their null targets, count and range of every other column at once; each pattern then counts for all targets, on
    either side. Texts take part as two 64-bit hashes, so the aggregate stays a hash aggregate; the value itself is
    read from the first row that has it.
    """
    if not targets or not others:
        return []
    names = list(targets)
    patterns = [
        reduce(lambda x, y: x.bitwiseOR(y), [F.when(q(t).isNull(), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, t in enumerate(names[s : s + _BITS])]).alias(f"p{s // _BITS}")
        for s in range(0, len(names), _BITS)
    ]
    marks = {o: _marks(df, o) for o in others}
    columns = [(f"o{i}_{k}", m) for i, o in enumerate(others) for k, m in enumerate(marks[o])]
    rows = df.select(*patterns, *[m.alias(c) for c, m in columns])
    keys = [f"p{i}" for i in range(len(patterns))]
    first = [x for c, _ in columns for x in (F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))]
    by_pattern = rows.groupBy(*keys).agg(*first)
    gone = [F.col(f"p{k // _BITS}").bitwiseAND(F.lit(1 << (k % _BITS))) != 0 for k in range(len(names))]
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), g.alias("gone")) for k, g in enumerate(gone)])).alias("s")
    then = [x for c, _ in columns for x in (F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_a").alias(f"{c}_a"), F.max(f"{c}_b").alias(f"{c}_b"))]
    table = by_pattern.select(sides, *[f"{c}_{x}" for c, _ in columns for x in "nab"]).groupBy("s").agg(*then)
    found = {(r["s"]["target"], r["s"]["gone"]): r for r in table.collect()}  # two rows per target
    out = []
    for k, target in enumerate(names):
        there, here = found.get((k, True)), found.get((k, False))
        for i, other in enumerate(others):
            parts = [f"o{i}_{m}" for m in range(len(marks[other]))]
            if other == target or there is None or here is None or there[f"{parts[0]}_n"] != targets[target]:
                continue
            one = all(there[f"{p}_a"] == there[f"{p}_b"] for p in parts)
            varies = any(here[f"{p}_a"] is not None and here[f"{p}_a"] != here[f"{p}_b"] for p in parts)
            if one and varies:
                value = there[f"{parts[0]}_a"] if len(parts) == 1 else df.where(q(target).isNull()).select(q(other)).first()[0]
                out.append((target, other, value))
    return out
