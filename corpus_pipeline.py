"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; :func:`run` writes each
stage to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.llm import decontaminate, jaccard, lines, packing, quality
from sparkclean.llm.common import key_bitmap, read_table, split_by_bitmap, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; the columns stay."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").drop("score", "predicted")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of boilerplate templates; ``n_chars`` is counted anew."""
    return lines.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).drop("dropped_lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity of 0.8 or more) the document with the smallest id; of rows
    that share an id all stay, or none; documents without an id stay."""
    found = jaccard.classes(docs, n=5, percent=80)
    gone = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    near, far = split_by_bitmap(docs, "doc_id", key_bitmap(gone, "doc_id"))
    return near.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(far)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
