"""Streaming reports and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.sources.snapshots import SnapshotTable


def timeline_stream(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Documents, completed and failed per day of a stream; rows later than ``lateness`` are dropped."""
    return (
        rows.withWatermark("request_timestamp", lateness)
        .groupBy(F.window("request_timestamp", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .select(F.to_date("window.start").alias("date"), "n", "completed", "failed")
    )


def upsert_stream(
    updates: DataFrame, path: str, checkpoint: str, key: str | Sequence[str] = "id", order: Sequence[str] = ("version",),
    output_mode: str = "append", compact_after: int = 16,
) -> StreamingQuery:
    """Upsert each micro-batch into the stored table at ``path``: of rows with one key the greatest by ``order`` stands.

    A batch becomes a delta, once, however often it runs; every ``compact_after`` deltas are folded into the table,
    so reading costs the table and a few deltas, not the history. Read it with ``read_upserts``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = SnapshotTable(batch.sparkSession, path, key, order)
        table.append(batch, checkpoint, batch_id)
        if table.open_deltas() >= compact_after:
            table.compact()

    return (
        updates.writeStream.foreachBatch(write).outputMode(output_mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_upserts(spark: SparkSession, path: str, key: str | Sequence[str] = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """The newest row per key of a table kept by ``upsert_stream``."""
    return SnapshotTable(spark, path, key, order).read()


def run_to_files(stream: DataFrame, out_dir: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there now and return its output as a batch frame."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_dir)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out_dir)
