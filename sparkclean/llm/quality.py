"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is compressed block by
block with each; the normalised difference of the compressed sizes, over all blocks and at its extremes, with the
sizes relative to the text, goes into a logistic calibration fitted on labelled rows that built no dictionary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import SMALL_BATCH, bounded_batches, fold_of, giving_back, literal_rows, stored, worker_cache

BLOCK = 512  # bytes
SAMPLE_BLOCKS = 8  # blocks that one labelled text gives to a dictionary, spread over the whole text
MAX_ROWS = 4000  # labelled rows of each class that build the dictionaries
MAX_CALIBRATION = 8000  # labelled rows of each class that fit the calibration
DICTIONARY_BYTES = 110 * 1024
LEVEL = 3
PREDICT_AT = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = (0.0,)


def _compressor(content: bytes):
    import zstandard

    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    trained = zstandard.ZstdCompressionDict(content)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False)


def _features(text: bytes, good, bad) -> list[float]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
    g = np.fromiter((len(good.compress(x)) for x in blocks), float, len(blocks))
    b = np.fromiter((len(bad.compress(x)) for x in blocks), float, len(blocks))
    size = np.fromiter((len(x) + 8 for x in blocks), float, len(blocks))
    each, total = (g - b) / (g + b), (g.sum() - b.sum()) / (g.sum() + b.sum())
    length = math.log(size.sum())
    return [
        total, each.max(), each.min(), g.sum() / size.sum(), b.sum() / size.sum(),
        (g / size).min(), (b / size).min(), length, total * length,
    ]


def features(df: DataFrame, model: QualityModel, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and an array ``features`` per row."""
    bounded_batches(df.sparkSession, size=SMALL_BATCH)
    good, bad = model.good, model.bad
    own = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = own.drop("_text").withColumn("features", F.array(F.lit(0.0))).schema

    def run(batches):
        pair = worker_cache(f"quality_{hash((good, bad))}", lambda: (_compressor(good), _compressor(bad)))
        for batch in batches:
            found = [_features(t.as_py().encode("utf-8", "surrogatepass"), *pair) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*keep, "features"]
            )

    return own.mapInArrow(giving_back(run), schema)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS, max_calibration: int = MAX_CALIBRATION,
) -> QualityModel:
    """Fit on a bounded sample of the labelled documents outside fold ``held_out``.

    Per class at most ``max_rows`` documents (never more than half of the class) build a dictionary, each giving at
    most ``SAMPLE_BLOCKS`` blocks, and ``max_calibration`` others fit the calibration; the choice follows a hash of
    the id. Null labels and ids are left out; of several labels or texts of an id the smallest counts. With one
    class only, or no rows, every score is the share of label 1 (one half without rows).
    """
    spark = docs.sparkSession
    own = (
        labels.filter(F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.when(F.col(label_col) == 1, 1).otherwise(0).alias("_label"))
        .filter(fold_of(F.col("_id"), folds) != held_out)
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    )
    counts = {r["_label"]: r["count"] for r in own.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return QualityModel(b"", b"", weights=((20.0 if 1 in counts else -20.0) if counts else 0.0,))
    chosen = []
    for label, n in counts.items():
        top = own.filter(F.col("_label") == label).orderBy(F.xxhash64(F.lit("quality"), F.col("_id")), "_id")
        ids = top.limit(min(max_rows, n // 2) + max_calibration).collect()
        chosen += [{"_id": r["_id"], "_label": label, "_fit": i >= min(max_rows, n // 2)} for i, r in enumerate(ids)]
    kind = own.schema["_id"].dataType.simpleString()
    sample = literal_rows(spark, chosen, f"_id: {kind}, _label: int, _fit: boolean")
    texts = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .join(F.broadcast(sample), "_id")
        .groupBy("_id", "_label", "_fit")
        .agg(F.min("_text").alias("_text"))
    )
    texts = stored(texts, "quality-sample")
    # blocks are cut by characters; a text gives at most SAMPLE_BLOCKS of them, from all over
    many = F.greatest(F.lit(1), F.ceil(F.length("_text") / BLOCK)).cast("int")
    apart = F.greatest(many / SAMPLE_BLOCKS, F.lit(1.0))
    spread = F.transform(
        F.sequence(F.lit(0), F.least(many, F.lit(SAMPLE_BLOCKS)) - 1),
        lambda i: F.substr("_text", (F.floor(i * apart) * BLOCK + 1).cast("int"), F.lit(BLOCK)),
    )
    got = texts.filter("not _fit").select("_label", "_id", spread.alias("_blocks")).orderBy("_id").collect()
    samples = {k: [b.encode() for r in got if r["_label"] == k for b in r["_blocks"] if b] for k in (0, 1)}
    raw = QualityModel(_dictionary(samples[1] or [b" "]), _dictionary(samples[0] or [b" "]))
    fitted = features(texts.filter("_fit"), raw, "_text", ["_label"]).collect()
    share = counts[1] / (counts[0] + counts[1])
    return _calibrated(raw, [r["features"] for r in fitted], [r["_label"] for r in fitted], share)


def _calibrated(raw: QualityModel, rows: list, labels: list[int], share: float) -> QualityModel:
    """Logistic regression by Newton steps; classes are weighted to the share that they have in the labels."""
    x, y = np.array(rows, float).reshape(len(rows), -1), np.array(labels, float)
    if len(set(labels)) < 2:
        return QualityModel(raw.good, raw.bad, weights=(math.log(share / (1 - share)),))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    ridge = 1e-3 * len(x) / 1000 * np.eye(a.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(raw.good, raw.bad, tuple(mean), tuple(scale), tuple(w))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if not given), ``score`` (0 to 1, higher is better) and ``predicted`` of every row.

    Null and empty texts are compressed as the empty text and get a score like any other.
    """
    keep = docs.columns if keep is None else keep
    if not model.mean:
        value = F.lit(1 / (1 + math.exp(-model.weights[0])))
        return docs.select(*keep).withColumn("score", value).withColumn("predicted", (value >= PREDICT_AT).cast("int"))
    names = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), F.col(text_col).alias("_body"))
    found = features(own, model, "_body", names)
    terms: list[Column] = [F.lit(model.weights[0])]
    terms += [
        (F.col("features")[i] - m) / s * w
        for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights[1:], strict=True))
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    value = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
    return found.select(
        *(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), value.alias("score"),
        (value >= PREDICT_AT).cast("int").alias("predicted"),
    )
