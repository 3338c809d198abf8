"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast by hint only when Catalyst's size estimate is below this.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def build_session(cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session used by tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def keep_last_duplicate_key(spark: SparkSession) -> None:
    """JSON objects with a repeated key keep the last value, as Python's parser does."""
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only for a side with a proven size bound.

    Above the bound the plan is left alone: AQE still converts to a broadcast when the
    measured shuffle size allows it, and otherwise splits skewed partitions.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of few splits, before work that is heavy per row.

    A scan that already has a split per core, as any large table has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """Folder for stream checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; a temporary one is used only where
    that is unset on a local master, as in tests. A cluster without it is an error: each
    executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        token = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
        return f"{base.rstrip('/')}/paperloom/{purpose}-{token}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{purpose}-", dir=os.environ.get("TMPDIR"))
