"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Values are plain Spark settings; anything the caller already set wins.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # small batches: one cell may hold megabytes of text
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "sparkclean", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str = "work") -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the place all executors can reach.

    Only a local-mode session without that setting falls back to a temporary folder;
    on a cluster a missing setting is an error, because a folder of one machine would
    be lost with that machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="sparkclean-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sparkclean/{label}-{uuid.uuid4().hex[:12]}"


def bytes_within(df, limit_bytes: int, bytes_per_row: int) -> bool:
    """True when ``df`` is proven to fit ``limit_bytes``: counts at most limit+1 rows."""
    max_rows = max(1, limit_bytes // max(1, bytes_per_row))
    return df.limit(max_rows + 1).count() <= max_rows
