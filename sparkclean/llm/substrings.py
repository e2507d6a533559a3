"""Removal of passages that repeat across documents.

Every window of ``size`` consecutive words has a Karp-Rabin hash. The windows of a document fall into stretches with
one minimum of the hashes of their shorter windows; equal windows have equal minima, so a stretch whose minimum is in
one document alone holds no repeated window and is not counted further. The windows of the other stretches are
counted in Spark with the smallest document that has them, and the repeated ones of each document merge into maximal
removal intervals. Documents that are equal word for word meet once, as whole documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import (
    batches_of,
    bounded_batches,
    gram_hashes,
    key_bitmap,
    lists_of,
    mix,
    split_by_bitmap,
    stored,
    word_hashes,
    words,
)

WINDOW = 50


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive hashes."""
    out, size = h, 1
    while size * 2 <= width:
        out, size = np.minimum(out[: len(out) - size], out[size:]), size * 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _inside(offsets: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the window of ``size`` at each flat position stays within its list."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(total)
    return at + size <= ends


def stretches(own: DataFrame, size: int) -> DataFrame:
    """_id, _th, ``whole`` (hash of all words), ``n_words`` of each row without stretch (``minimum`` null), and a row
    per stretch: ``minimum``, ``start``, ``length`` (windows)."""
    short = (size + 1) // 2
    schema = pa.schema([
        ("_id", pa.int64()), ("_th", pa.int64()), ("whole", pa.int64()), ("n_words", pa.int64()), ("minimum", pa.int64()),
        ("start", pa.int64()), ("length", pa.int64()),
    ])

    def run(batches):
        for batch in batches:
            values, offsets = lists_of(batch.column("_words"))
            ids, th = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            lengths = np.diff(offsets)
            # all words in order: a sum of position-dependent hashes
            place = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
            with np.errstate(over="ignore"):
                parts = np.concatenate([[np.uint64(0)], np.cumsum(mix(values * np.uint64(0x9E3779B97F4A7C15) + mix(place.astype(np.uint64) + np.uint64(7))))])
                whole = (parts[offsets[1:]] - parts[offsets[:-1]]).view(np.int64)
            none = np.zeros(len(ids), np.int64)
            yield from batches_of(
                {"_id": ids, "_th": th, "whole": whole, "n_words": lengths, "minimum": [None] * len(ids), "start": none, "length": none}, schema
            )
            if len(values) < size:
                continue
            low = _minima(gram_hashes(values, short), size - short + 1)
            ok = np.flatnonzero(_inside(offsets, size, len(values))[: len(low)])
            if not len(ok):
                continue
            row = np.repeat(np.arange(len(ids)), lengths)[ok]
            new = np.r_[True, (low[ok[1:]] != low[ok[:-1]]) | (row[1:] != row[:-1])]
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(ok)])
            row = row[first]
            yield from batches_of(
                {
                    "_id": ids[row], "_th": th[row], "whole": whole[row], "n_words": lengths[row], "minimum": low[ok[first]].view(np.int64),
                    "start": ok[first] - offsets[row], "length": many,
                }, schema,
            )

    return own.select("_id", "_th", word_hashes(F.col("_text")).alias("_words")).mapInArrow(
        run, "_id bigint, _th bigint, whole bigint, n_words bigint, minimum bigint, start bigint, length bigint"
    )


def windows(own: DataFrame, size: int) -> DataFrame:
    """_id, _th, ``hash`` and ``start`` of every window of the stretches listed in ``_runs``."""
    schema = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("hash", pa.int64()), ("start", pa.int64())])

    def run(batches):
        for batch in batches:
            values, offsets = lists_of(batch.column("_words"))
            ids, th = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            runs = batch.column("_runs")
            many = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            start = flat.field("start").to_numpy() + np.repeat(offsets[:-1], many)
            length = flat.field("length").to_numpy()
            if not len(start):
                continue
            row = np.repeat(np.repeat(np.arange(len(ids)), many), length)
            at = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            found = gram_hashes(values, size)[at].view(np.int64)
            yield from batches_of({"_id": ids[row], "_th": th[row], "hash": found, "start": at - offsets[row]}, schema)

    return own.select("_id", "_th", word_hashes(F.col("_text")).alias("_words"), "_runs").mapInArrow(
        run, "_id bigint, _th bigint, hash bigint, start bigint"
    )


def _merged(starts: Column, size: int) -> Column:
    """Maximal [from, to) intervals that windows at the sorted ``starts`` cover."""
    opens = F.filter(starts, lambda x, k: (k == 0) | (x > F.get(starts, k - 1) + size))
    closes = F.filter(starts, lambda x, k: (k == F.size(starts) - 1) | (F.get(starts, k + 1) > x + size))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("from"), (b + size).alias("to")))


def removals(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(the rows as ``_id``, ``_th``, ``_text``; the intervals to remove as ``_id``, ``_th``, ``_cut``)."""
    bounded_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    known = own.filter("_id is not null")
    found = stored(stretches(known, size), "substring-stretches")
    rows, runs = found.filter("minimum is null"), found.filter("minimum is not null")
    # documents of equal words: the first one speaks for all, the others go whole
    first = stored(rows.filter(F.col("n_words") >= size).groupBy("whole", "n_words").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "substring-copies")
    copied = first.filter("_n > 1")
    copies = rows.select("_id", "_th", "whole", "n_words").join(copied, ["whole", "n_words"]).filter("_id > _first").select("_id", "_th", "n_words")
    copies = stored(copies.distinct(), "substring-whole")
    shared = (
        runs.groupBy("minimum")
        .agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"))
        .filter("_a <> _b")
        .select("minimum")
    )
    shared = stored(shared, "substring-shared")
    there = (
        runs.select("_id", "_th", "minimum", "start", "length")
        .join(shared, "minimum", "left_semi")
        .join(copies.select("_id", "_th"), ["_id", "_th"], "left_anti")
        .select("_id", "_th", "start", "length")
        .distinct()  # repeated rows
        .groupBy("_id", "_th")
        .agg(F.collect_list(F.struct("start", "length")).alias("_runs"))  # at most as long as the document
    )
    there = stored(there, "substring-runs")
    near, _ = split_by_bitmap(known, "_th", key_bitmap(there, "_th"))
    wanted = near.join(there, ["_id", "_th"])
    found = stored(windows(wanted, size).select("hash", "_id", "_th", "start"), "substring-windows")
    owner = found.groupBy("hash").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first <> _last").drop("_last")
    owner = stored(owner, "substring-owners")
    cut = (
        found.join(owner, "hash")
        .filter("_id > _first")
        .groupBy("_id", "_th")
        .agg(F.array_sort(F.collect_set("start")).alias("_starts"))  # at most as many as the document has words
        .select("_id", "_th", _merged(F.col("_starts"), size).alias("_cut"))
    )
    whole = copies.select("_id", "_th", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to"))).alias("_cut"))
    return own, stored(cut.unionByName(whole), "substring-cuts")


def deduplicated(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_words``, ``n_removed``, ``removed`` (word intervals [from, to)), ``kept_text`` (words joined by a space).

    Removes each word that lies in a window of ``size`` words that also starts in a document with a smaller id, all
    judged on the input. Null and short texts have no window and stay; a null text has no words. Ids are integers; rows
    of one id never remove each other, rows with a null id neither remove nor lose anything.
    """
    own, cuts = removals(docs, size, id_col, text_col)
    near, far = split_by_bitmap(own, "_th", key_bitmap(cuts, "_th"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    both = near.join(cuts, ["_id", "_th"], "left").select("_id", "_text", F.coalesce("_cut", none).alias("removed"))
    both = both.unionByName(far.select("_id", "_text", none.alias("removed"))).withColumn("_words", words(F.col("_text")))
    kept = F.when(F.size("removed") == 0, F.col("_words")).otherwise(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size("removed")),
                lambda k: F.slice(
                    "_words",
                    (F.when(k == 0, F.lit(0)).otherwise(F.get("removed", k - 1)["to"]) + 1).cast("int"),
                    (F.when(k == F.size("removed"), F.size("_words").cast("long")).otherwise(F.get("removed", k)["from"]) - F.when(k == 0, F.lit(0)).otherwise(F.get("removed", k - 1)["to"])).cast("int"),
                ),
            )
        )
    )
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return both.select(
        F.col("_id").alias(id_col), F.size("_words").cast("long").alias("n_words"), gone.alias("n_removed"), "removed",
        F.array_join(kept, " ").alias("kept_text"),
    )
