"""Groups of spellings: the most frequent spelling takes all that extend it, or that it extends, and are like it."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.text import WHITESPACE, strip_ws
from sparkclean.operators.base import ROW_ID, q
from sparkclean.operators.profile import CATEGORY_MAX
from sparkclean.session import scratch_dir

# --- fixed values ------------------------------------------------------------------------
VARIANT_SCORE = 60.0
VARIANT_BOUNDARY = " ,(-"
KEY_LENGTH = 64  # characters of a key that is the text itself
HOT = 100_000  # rows of one key that are not left to one task
# -------------------------------------------------------------------------------------------


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    row = 0
    for ch in b:
        x = row | where.get(ch, 0)
        row = x & ~(x - ((row << 1) | 1))
    return bin(row).count("1")


def variant_score(a: str, b: str) -> float:
    """Similarity (0..100) of the sorted words of two spellings; 0 unless one spelling
    extends the other at a word boundary."""
    short, long = sorted((a, b), key=len)
    if not long.startswith(short):
        return 0.0
    if len(long) > len(short) and long[len(short)] not in VARIANT_BOUNDARY:
        return 0.0
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    if not x and not y:
        return 100.0
    return 200.0 * common_subsequence(x, y) / (len(x) + len(y))


def spelling_groups(
    counts: list[tuple[str, int, int]], cutoff: float = VARIANT_SCORE, max_variants: int | None = None
) -> list[dict[str, Any]]:
    """Greedy groups over (value, count, first row): the most frequent spelling that is
    still free takes every free spelling that scores at least ``cutoff`` with it."""
    size = {v: n for v, n, _ in counts}
    order = [v for v, n, first in sorted(counts, key=lambda t: (-t[1], len(t[0]), t[2]))]
    spellings: dict[str, list[str]] = {}
    for v in order:
        spellings.setdefault(v.strip().lower(), []).append(v)
    free = list(spellings)
    groups = []
    while free:
        head = free[0]
        scored = [(variant_score(head, s), i, s) for i, s in enumerate(free)]
        # ``head`` itself always scores: an empty or one-word spelling equals itself
        hits = sorted((t for t in scored if t[0] >= cutoff), key=lambda t: (-t[0], t[1]))[:max_variants]
        taken = {s for _, _, s in hits} or {head}
        members = sorted(
            (v for s in taken for v in spellings[s]), key=lambda v: (-size[v], len(v), v)
        )
        groups.append({"canonical": members[0].strip(), "variants": members})
        free = [s for s in free if s not in taken]
    return groups


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_no, value, n, first row) of the values of the columns."""
    values = [q(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    return (
        df.select(ROW_ID, *values)
        .unpivot(ROW_ID, [f"c{i}" for i in range(len(columns))], "col_no", "value")
        .where(F.col("value").isNotNull())
        .groupBy("col_no", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first"))
    )


def category_groups(df: DataFrame, columns: list[str], max_variants: int | None = None) -> DataFrame:
    """(column, group_no, canonical, variants) of columns that a profile has found to hold few values.

    The values of a column are one group in one task: for columns of any size see :func:`entity_groups`, which
    gives the same groups.
    """
    return _in_one_task(_values(df, columns), columns, max_variants)


def _in_one_task(values: DataFrame, columns: list[str], max_variants: int | None) -> DataFrame:
    names = {f"c{i}": c for i, c in enumerate(columns)}

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        found = spelling_groups(list(zip(pdf["value"], pdf["n"], pdf["first"])), max_variants=max_variants)
        return pd.DataFrame({
            "column": [names[pdf["col_no"].iloc[0]]] * len(found),
            "group_no": range(len(found)),
            "canonical": [g["canonical"] for g in found],
            "variants": [g["variants"] for g in found],
        })

    return values.groupBy("col_no").applyInPandas(
        cluster, "column string, group_no int, canonical string, variants array<string>"
    )


# --- columns of any size --------------------------------------------------------------------------


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession, "spellings")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@F.pandas_udf(T.DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([variant_score(x, y) for x, y in zip(a, b)], dtype="float64")


def _words_size(text: str) -> Column:
    """Characters of the words of a text that neither begins nor ends with white space, joined by one blank."""
    solid = F.length(F.translate(text, WHITESPACE, ""))
    return solid + F.size(F.split(text, f"[{WHITESPACE}]+")) - 1


def _exact_key(text: Column) -> Column:
    return F.when(F.length(text) <= KEY_LENGTH, text).otherwise(F.concat(F.lit("sha256 "), F.sha2(text, 256)))


def _join_hot(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """Inner join of stored tables on unique keys of ``right``; ``counts`` holds the keys with ``HOT`` rows or more in
    ``left``: at most one for ``HOT`` rows, so their rows of ``right`` travel and no task gets all rows of such a key."""
    hot = F.broadcast(_kept(right.join(F.broadcast(counts), keys, "left_semi")))
    rest = left.join(F.broadcast(counts), keys, "left_anti").join(right, keys)
    return left.join(hot, keys).unionByName(rest)


def variant_pairs(nodes: DataFrame, cutoff: float = VARIANT_SCORE) -> DataFrame:
    """(col_no, x, y, score) of all spellings that score ``cutoff`` or more, each pair in both directions.

    ``nodes`` holds (col_no, node, spelling), without white space at the ends of a spelling. The shorter spelling is a
    prefix of the longer one that ends before a boundary: a spelling gives one row per such prefix, and these meet the
    spellings by length and text (by SHA-256, if long). A prefix too short for the cutoff, whatever the words are, is
    left out at once. Before a blank the words of the prefix are words of the longer spelling, and in sorted order one
    is a subsequence of the other: the score follows from their sizes. Other texts are joined to what met and compared.
    """
    nodes = nodes.withColumn("length", F.length("spelling")).withColumn("size", _words_size("spelling"))
    solid = F.length(F.translate("spelling", WHITESPACE, ""))  # the longer text has as many characters at least
    least = F.greatest(F.lit(1), F.ceil(solid * cutoff / (200.0 - cutoff)).cast("int") - 1)
    longer = nodes.where("length > 1").select("*", solid.alias("solid"), least.alias("least")).where("least < length")
    ends = F.filter(
        F.sequence(F.col("least"), F.col("length") - 1),
        lambda i: F.lit(VARIANT_BOUNDARY).contains(F.substring(F.col("spelling"), i + 1, F.lit(1))),
    )
    starts = longer.select("col_no", F.col("node").alias("long"), "spelling", F.col("size").alias("long_size"), "solid", F.explode(ends).alias("end"))
    starts = starts.where(F.col("end") * (200.0 - cutoff) >= F.col("solid") * cutoff)
    prefix = F.substring(F.col("spelling"), F.lit(1), F.col("end"))
    blank = F.substring(F.col("spelling"), F.col("end") + 1, F.lit(1)) == " "
    starts = _kept(starts.select("col_no", "long", "end", "long_size", blank.alias("blank"), _exact_key(prefix).alias("key")))
    known = nodes.select("col_no", F.col("node").alias("short"), F.col("length").alias("end"), F.col("size").alias("short_size"), _exact_key(F.col("spelling")).alias("key"))
    keys = ["col_no", "end", "key"]
    counts = _kept(starts.groupBy(*keys).count().where(F.col("count") >= HOT).select(*keys))
    met = _kept(_join_hot(starts, known, keys, counts).drop("end", "key"))
    score = 200.0 * F.col("short_size") / (F.col("short_size") + F.col("long_size"))
    scored = met.where("blank").select("col_no", "short", "long", score.alias("score"))
    others = met.where("not blank").select("col_no", "short", "long")
    for name in ("short", "long"):
        text = nodes.select("col_no", F.col("node").alias(name), F.col("spelling").alias(f"{name}_text"))
        others = others.join(text, ["col_no", name])
    others = others.select("col_no", "short", "long", _score("short_text", "long_text").alias("score"))
    scored = scored.unionByName(others).where(F.col("score") >= cutoff)
    both = F.explode(F.array(F.struct(F.col("short").alias("x"), F.col("long").alias("y")), F.struct(F.col("long").alias("x"), F.col("short").alias("y"))))
    return scored.select("col_no", both.alias("p"), "score").select("col_no", "p.x", "p.y", "score")


def _heads(pairs: DataFrame) -> DataFrame:
    """(col_no, y, head): of every spelling in ``pairs`` that another takes, the first head it is like.

    The greedy choice in parallel rounds: a spelling that comes before all its free neighbours is the head that the
    choice one by one would make as well, since none of these is taken before. Heads and what they take leave, and the
    next round begins. A spelling goes to the first of all heads it is like, because that one chose first.
    """
    free, heads = pairs, None
    while True:
        first = free.groupBy("col_no", "x").agg(F.min("y").alias("m")).where("x < m").select("col_no", "x")
        first = _kept(first)
        heads = first if heads is None else heads.unionByName(first)
        taken = free.join(first, ["col_no", "x"], "left_semi").select("col_no", F.col("y").alias("x"))
        gone = first.unionByName(taken).distinct()
        free = free.join(gone, ["col_no", "x"], "left_anti")
        free = _kept(free.join(gone.withColumnRenamed("x", "y"), ["col_no", "y"], "left_anti").select("col_no", "x", "y", "score"))
        if free.isEmpty():
            break
    found = pairs.join(heads, ["col_no", "x"], "left_semi").groupBy("col_no", "y").agg(F.min("x").alias("head"))
    return found.where("head < y")


def _capped_heads(pairs: DataFrame, max_variants: int) -> DataFrame:
    """As :func:`_heads`, but a head takes its ``max_variants`` - 1 best only; the others stay free.

    A head may choose if it comes before all free spellings up to two steps away: nobody before it can take what it takes.
    """
    best = Window.partitionBy("col_no", "x").orderBy(F.col("score").desc(), "y")
    free, members = pairs, None
    while True:
        near = free.groupBy("col_no", "x").agg(F.min(F.least("x", "y")).alias("m"))
        far = free.join(near.select("col_no", F.col("x").alias("y"), "m"), ["col_no", "y"]).groupBy("col_no", "x").agg(F.min("m").alias("m"))
        first = _kept(far.where("x = m").select("col_no", "x"))
        chosen = free.join(first, ["col_no", "x"], "left_semi").withColumn("place", F.row_number().over(best)).where(F.col("place") < max_variants)
        chosen = _kept(chosen.select("col_no", "y", F.col("x").alias("head")))
        members = chosen if members is None else members.unionByName(chosen)
        gone = first.unionByName(chosen.select("col_no", F.col("y").alias("x"))).distinct()
        free = free.join(gone, ["col_no", "x"], "left_anti")
        free = _kept(free.join(gone.withColumnRenamed("x", "y"), ["col_no", "y"], "left_anti").select("col_no", "x", "y", "score"))
        if free.isEmpty():
            return members


def spelling_members(df: DataFrame, columns: list[str], max_variants: int | None = None) -> DataFrame:
    """(column, value, n, group, canonical): a row for every distinct value, ``group`` alike for values of one group.

    No group is in one task: pairs come from an equi-join on prefixes, heads from rounds of aggregates and joins whose
    results are written, and a spelling that very many others extend is a key that Spark can split. Null values belong
    to no group; a column without values gives no rows.
    """
    return _members(_kept(_values(df, columns)), columns, max_variants)


def _members(values: DataFrame, columns: list[str], max_variants: int | None) -> DataFrame:
    values = values.withColumn("spelling", F.lower(strip_ws(F.col("value"))))
    # places in the order of choice name the spellings: count, length, first row
    rank = F.struct((-F.col("n")).alias("n"), F.length("value").alias("length"), F.col("first"))
    nodes = _kept(values.groupBy("col_no", "spelling").agg(F.min(rank).alias("node")))
    pairs = _kept(variant_pairs(nodes))
    if pairs.isEmpty():
        grouped = nodes.withColumn("head", F.col("node"))
    else:
        taken = _heads(pairs) if max_variants is None else _capped_heads(pairs, max_variants)
        grouped = nodes.join(taken.withColumnRenamed("y", "node"), ["col_no", "node"], "left").withColumn("head", F.coalesce("head", "node"))
    members = _kept(values.join(grouped.select("col_no", "spelling", "head"), ["col_no", "spelling"]))
    first = F.min_by("value", F.struct(-F.col("n"), F.length("value"), F.col("value")))
    best = _kept(members.groupBy("col_no", "head").agg(first.alias("canonical"), F.count("*").alias("size")))
    counts = best.where(F.col("size") >= HOT).select("col_no", "head")
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"c{i}"), F.lit(c))])
    return _join_hot(members, best.drop("size"), ["col_no", "head"], counts).select(
        names[F.col("col_no")].alias("column"), "value", "n", F.xxhash64("head").alias("group"), strip_ws(F.col("canonical")).alias("canonical")
    )


def entity_groups(df: DataFrame, columns: list[str], max_variants: int | None = None) -> DataFrame:
    """(column, canonical, variants) of the spellings of text columns of any number of values.

    A row holds all variants of its group, most frequent first; where a group may be very large, take
    :func:`spelling_members`, which has one row per value. A column of at most ``CATEGORY_MAX`` values is grouped in
    one task, others in rounds: the groups are the same.
    """
    values = _kept(_values(df, columns))
    counts = values.groupBy("col_no").count().collect()  # one row per column
    few = [r["col_no"] for r in counts if r["count"] <= CATEGORY_MAX]
    small = _in_one_task(values.where(F.col("col_no").isin(few)), columns, max_variants).select("column", "canonical", "variants")
    if len(few) == len(counts):
        return small
    order = F.struct((-F.col("n")).alias("n"), F.length("value").alias("length"), F.col("value"))
    members = _members(values.where(~F.col("col_no").isin(few)), columns, max_variants)
    groups = members.groupBy("column", "group", "canonical").agg(F.array_sort(F.collect_list(order)).alias("found"))
    large = groups.select("column", "canonical", F.col("found.value").alias("variants"))
    return large.unionByName(small) if few else large
