"""Importance resampling: documents drawn so that their n-grams look like those of a target text.

Method: a 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes of a text, ``bytes.split`` gives
the words, ``zlib.crc32`` seeded with the checksum of the words before extends a run by one word, and counters reduce
the checksums to buckets. The log ratio of target and corpus, smoothed, is the gain of a bucket; a document weighs the
sum of its features' gains, and Gumbel noise from a hash of its id turns the largest scores into a draw without
replacement in proportion to the weights.

Scale: two passes over the texts. The first sends at most ``buckets`` rows a task into one sum, whose result (one
number per bucket, a parameter) is all that reaches the driver; the second is a narrow map. Ranks come from the range
partitions of :class:`~sparkclean.operators.order.Ordered`, on rows without text, so neither a hot source nor equal
scores meet in one task.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import bounded_batches, stored
from sparkclean.operators.order import Ordered

BUCKETS, PERCENT, LEAST_WORDS, SEED, SCALE = 10_000, 10, 20, 2024, 1000


def byte_table() -> bytes:
    """Digits, lower-case letters and bytes from 0x80 on stand for themselves, A-Z for a-z, all others for a blank."""
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for byte in chain(b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


def text_features(words: list[bytes], n: int) -> list[int]:
    """Checksums of all runs of 1 to ``n`` words joined by one space."""
    level = list(map(zlib.crc32, words))
    out, spaced = level, [b" " + w for w in words] if n > 1 else []
    for k in range(1, n):
        level = list(map(zlib.crc32, spaced[k:], level))
        out = out + level
    return out


def _features(texts: list, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of several texts one after the other, features of each text, words of each text."""
    table = byte_table()
    words = [(t or b"").translate(table).split() for t in texts]
    found = [text_features(w, n) for w in words]
    size = np.array([len(f) for f in found], np.int64)
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
    return flat % buckets, size, np.array([len(w) for w in words], np.int64)


def _binary(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket; null texts have none."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_features(_binary(batch, "_text"), n, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    own = docs.select(F.col(text_col).cast("binary").alias("_text"))
    sums = own.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, count in sums.collect():  # at most ``buckets`` rows
        out[bucket] = count
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, in doubles."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weights(
    docs: DataFrame, gain: np.ndarray, n: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """id, the columns of ``keep``, ``n_words``, ``n_features`` and ``weight`` of every row; 0 without features."""
    bounded_batches(docs.sparkSession)
    names = dict.fromkeys([id_col, *keep])
    inner = [f"_k{i}" for i in range(len(names))]
    own = docs.select(*[F.col(c).alias(k) for c, k in zip(names, inner, strict=True)], F.col(text_col).cast("binary").alias("_text"))
    schema = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in inner)
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            flat, size, words = _features(_binary(batch, "_text"), n, buckets)
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            ends = np.cumsum(size)
            columns = [*[batch.column(k) for k in inner], pa.array(words), pa.array(size), pa.array(sums[ends] - sums[ends - size])]
            yield pa.RecordBatch.from_arrays(columns, [*inner, "n_words", "n_features", "weight"])

    found = own.mapInArrow(run, f"{schema}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumnsRenamed(dict(zip(inner, names, strict=True)))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` of every row; ``rank`` is null if it is not drawn.

    Drawn are the ``percent`` of the rows with at least ``least_words`` words that score highest, ties to the smaller
    id, null ids last. Null and empty texts have no features and the weight 0. Repeated rows are rows of their own:
    they have equal scores and follow one another in rank. An empty table gives no rows; an empty target makes rare
    features weigh more than frequent ones, as the formula says. Columns of other names are not read.
    """
    gain = gains(bucket_counts(docs, n, buckets, text_col), bucket_counts(target, n, buckets, target_col))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(F.log(-F.log(share)) * -SCALE)
    scored = weights(docs, gain, n, id_col, text_col).withColumn("score", score)
    scored = stored(scored.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "importance")
    able = scored.filter(F.col("n_words") >= least_words)
    ordered = Ordered(able, F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_salt"))
    drawn = ordered.total * percent // 100
    ranked = ordered.ranked("rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("_salt")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; of rows that share an id all that one draw names. Ids are needed."""
    found = resample(docs, target, id_col=id_col, **options)
    names = found.filter(F.col("rank").isNotNull()).select(id_col).distinct()
    return docs.join(names, id_col, "left_semi")
