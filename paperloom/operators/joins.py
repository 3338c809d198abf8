"""Joins of documents with configurations, chunks, runs, selections and corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import columns as C
from paperloom.operators.ordering import latest_by, run_numbers
from paperloom.session import broadcast_if_small

DEFAULT_CHUNK_PAGES = 10


def with_config(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """Add the dataset's configuration columns to each row.

    A dataset without one gets the first configuration by name; when there is none at all,
    ``config_error`` is set.
    """
    extra = [c for c in configs.columns if c != "dataset"]
    table = configs.select("dataset", F.struct(*extra).alias("__cfg"))
    # One row, read as a scalar subquery: no join for the fallback.
    first = table.agg(F.min_by("__cfg", "dataset").alias("f")).scalar()
    joined = docs.join(broadcast_if_small(table), "dataset", "left").withColumn("__cfg", F.coalesce("__cfg", first))
    return joined.select(
        *docs.columns,
        *[
            F.coalesce(F.col(f"__cfg.{c}"), F.lit(DEFAULT_CHUNK_PAGES)).alias(c)
            if c == "max_pages_per_chunk" else F.col(f"__cfg.{c}").alias(c)
            for c in extra
        ],
        F.when(F.col("__cfg").isNull(), F.lit("no dataset configurations found")).alias("config_error"),
    )


def align_chunks(parts: dict[str, DataFrame]) -> DataFrame:
    """Line up per-chunk results by document and position.

    Each frame has ``id, chunk_idx, value``; a stage without the chunk leaves null.
    """
    named = [df.select("id", "chunk_idx", F.col("value").alias(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.join(b, ["id", "chunk_idx"], "full_outer"), named)


def merge_runs(runs: DataFrame, files: Sequence[str]) -> DataFrame:
    """Run table: a row per metric, a column ``Run n`` per listed file; a metric missing in a run is null.

    A run that is not listed fails the job. ``runs_by_metric`` needs no list.
    """
    stray = F.raise_error(F.concat(F.lit("run not listed: "), F.coalesce("file", F.lit("null")))).cast("string")
    listed = runs.withColumn("file", F.when(F.col("file").isin(*files), F.col("file")).otherwise(stray))
    wide = listed.groupBy("metric").pivot("file", list(files)).agg(F.first("value"))
    return wide.select("metric", *[F.col(f"`{f}`").alias(f"Run {i}") for i, f in enumerate(files, 1)])


def runs_by_metric(runs: DataFrame) -> DataFrame:
    """The same table for any number of runs: (metric, runs), a map of run number to value; a run without the metric is absent."""
    numbered = run_numbers(runs)
    entries = F.array_sort(F.collect_list(F.struct(F.col("run_number").cast("int").alias("key"), "value")))
    return numbered.groupBy("metric").agg(F.map_from_entries(entries).alias("runs"))


def select_rows(df: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the selection."""
    return df.join(chosen.select(key), key, "left_semi")


def unconfigured_datasets(blobs: DataFrame, configs: DataFrame) -> DataFrame:
    """Dataset folders in storage that have no configuration."""
    parts = F.split("blob_name", "/")
    folders = (
        blobs.filter(F.size(parts) >= 2).select(C.non_empty(parts[0]).alias("dataset"))
        .filter(F.col("dataset").isNotNull()).distinct()
    )
    return folders.join(configs.select("dataset"), "dataset", "left_anti")


def latest_correction_join(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """``current_extraction``: the newest correction's data, else the original extraction."""
    newest = latest_by(corrections, ["document_id"], ["ts", "correction_id"]).select(
        "document_id", "corrected_data", F.col("ts").alias("last_correction_timestamp")
    )
    joined = docs.join(newest, "document_id", "left")
    return joined.select(
        *docs.columns,
        F.coalesce("corrected_data", "extraction").alias("current_extraction"),
        F.col("last_correction_timestamp").isNotNull().alias("human_corrected"),
        "last_correction_timestamp",
    )


def schema_coverage(template: DataFrame, extracted: DataFrame, key: str = "id") -> DataFrame:
    """Template leaf paths against extracted ones: present, missing or extra.

    ``template(key, path)`` and ``extracted(key, path)`` carry leaf paths; list positions
    are generalised to ``[*]`` first.
    """
    general = F.regexp_replace("path", r"\[\d+\]", "[*]").alias("path")
    t = template.select(key, general).distinct().withColumn("__t", F.lit(True))
    e = extracted.select(key, general).distinct().withColumn("__e", F.lit(True))
    state = F.when(F.col("__e").isNull(), "missing").when(F.col("__t").isNull(), "extra").otherwise("present")
    return t.join(e, [key, "path"], "full_outer").select(key, "path", state.alias("coverage"))
