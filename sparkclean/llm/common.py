"""Helpers shared by the operators on text corpora.

Conventions of every operator of this subpackage:

* A caller names the id and text columns; only these are read, so further columns of any name do no harm.
* A null text counts as the empty text unless the operator says otherwise. Repeated rows are kept apart by
  (id, hash of the text): equal rows get equal results, rows that share only the id keep their own.
* What has to be read twice is written to the folder that ``spark.checkpoint.dir`` names, so a lost executor
  costs its running tasks only.
"""

from __future__ import annotations

import ctypes
import json
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"
SMALL_BATCH = "2m"  # of whole texts or their words: what is made of a batch takes several times its size


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a lineage cut that survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Batches for Python are bounded by bytes as well as rows, because one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def literal_rows(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A small constant table as an expression: no RDD, no Python on executors."""
    text = json.dumps(list(rows), ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs without the six ASCII white-space characters; empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def give_back() -> None:
    """Hand memory that this process has freed back to the system; else it counts until the worker ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; when a task is over, its worker keeps no memory that it no longer uses."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def worker_cache(name: str, make: Callable):
    """An object kept by a Python worker across tasks (functions travel by value, their globals do not last).

    A worker keeps one: the object of another operator, or of another fit, is let go before a new one is made.
    """
    store = sys.modules.setdefault("_sparkclean_worker", types.ModuleType("_sparkclean_worker"))
    if getattr(store, "name", None) != name:
        store.name = store.value = None
        give_back()
        store.value = make()
        store.name = name
    return store.value


class Remembered:
    """A dictionary of two generations with a bound on the characters of its keys.

    Entries in use move to the new generation; when that is full it becomes the old one and the one before is let go,
    so frequent keys stay. ``fill`` makes sure that ``new`` holds all keys asked for.
    """

    def __init__(self, most_chars: int, entry: int = 150):
        self.most, self.entry = most_chars, entry  # entry: bytes that an entry takes apart from its key
        self.new: dict = {}
        self.old: dict = {}
        self.chars = 0

    def fill(self, keys: Iterable, make: Callable[[list], Iterable]) -> dict:
        """The new generation, holding ``keys``; ``make`` gives the values of those that neither generation has."""
        if self.chars > self.most:
            self.old, self.new, self.chars = self.new, {}, 0
        new, old = self.new, self.old
        away = [k for k in keys if k not in new]
        lost = [k for k in away if k not in old]
        for k in away:
            if k in old:
                new[k] = old[k]
        if lost:
            new.update(zip(lost, make(lost), strict=True))
        self.chars += sum(map(len, away)) + self.entry * len(away)
        return new


# ---------------------------------------------------------------- arrays of hashes inside tasks


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of ``h`` (uint64); doubling instead of n passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, width, power = None, 0, _BASE  # polynomial in the base, joined from powers of two
    block, size = mix(h + np.uint64(1)), 1
    with np.errstate(over="ignore"):
        left = n
        while True:
            if left & 1:
                if out is None:
                    out, width = block, size
                else:
                    m = len(h) - (width + size) + 1
                    out, width = out[:m] * power + block[width : width + m], width + size
            left >>= 1
            if not left:
                return mix(out[: len(h) - n + 1])
            m = len(block) - size
            block, size, power = block[:m] * power + block[size : size + m], size * 2, power * power


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (uint64) and offsets of an Arrow list<int64> column."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def batches_of(columns: dict, schema: pa.Schema, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    total = len(next(iter(columns.values())))
    for start in range(0, total, rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name][start : start + rows], f.type) for f in schema], schema=schema
        )


# ---------------------------------------------------------------- joins


BITMAP_BITS = 24


def _slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << BITMAP_BITS) - 1)


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """2^24 bits of key hashes in at most 2^18 rows, whatever the number of keys: a safe broadcast."""
    slot = _slot(F.col(key))
    return (
        keys.select(slot.alias("_s"))
        .select(F.shiftright("_s", 6).alias("_w"), F.expr("shiftleft(1L, cast(_s & 63 as int))").alias("_b"))
        .groupBy("_w")
        .agg(F.bit_or("_b").alias("_b"))
    )


def split_by_bitmap(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the set, rows whose key is not): the second part needs no shuffle."""
    slot = _slot(F.col(key))
    marked = (
        df.withColumn("_s", slot)
        .withColumn("_w", F.shiftright("_s", 6))
        .join(F.broadcast(bitmap), "_w", "left")
        .withColumn("_hit", F.expr("coalesce(_b, 0L) & shiftleft(1L, cast(_s & 63 as int)) <> 0"))
        .drop("_s", "_w", "_b")
    )
    return marked.filter("_hit").drop("_hit"), marked.filter("not _hit").drop("_hit")
