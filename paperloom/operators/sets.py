"""Set operations on dataset names and extracted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.functions import columns as C


def storage_folders(blobs: DataFrame) -> DataFrame:
    parts = F.split("blob_name", "/")
    return (
        blobs.filter(F.size(parts) >= 2).select(C.non_empty(parts[0]).alias("dataset"))
        .filter(F.col("dataset").isNotNull()).distinct()
    )


def all_datasets(configs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Configured datasets and storage folders; 'default-dataset' when there are neither."""
    names = configs.select("dataset").union(storage_folders(blobs)).distinct()
    one = configs.sparkSession.range(1).select(F.lit(C.DEFAULT_DATASET).alias("dataset"))
    return names.union(one.filter(names.agg(F.count(F.lit(1))).scalar() == 0))


def distinct_datasets(rows: DataFrame) -> DataFrame:
    return rows.select("dataset").distinct().orderBy("dataset")


def field_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves held by one side only, as (keys, path, value, side).

    Both sides go through one aggregation instead of two set differences; equal leaves
    cancel before the shuffle.
    """
    cols = [*keys, "path", "value"]
    signed = before.select(*cols, F.lit(1).alias("n")).union(after.select(*cols, F.lit(-1).alias("n")))
    net = signed.groupBy(*cols).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)
    side = F.when(F.col("n") > 0, F.lit("removed")).otherwise(F.lit("added"))
    copies = F.array_repeat(side, F.abs("n").cast("int"))
    return net.select(*cols, F.explode(copies).alias("side"))
