"""Ordered computations that never gather one key's rows in one task.

A window over a key sorts all its rows in a single task, and one key may hold a third of a
table. These helpers cut a key's rows into buckets that follow the order (an hour of a
timestamp, a range of a number), work inside each (key, bucket), and carry only one summary
row per bucket across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BUCKET = "__bucket"


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    out: str,
    value: Column | None = None,
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` (1 by default) per key in order.

    ``bucket`` must not decrease along ``order``.
    """
    value = F.lit(1) if value is None else value
    rows = df.withColumns({_BUCKET: bucket, "__v": value})
    totals = rows.groupBy(*keys, _BUCKET).agg(F.sum("__v").alias("__t"))
    before = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = W.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("__in", F.sum("__v").over(inside))
        .join(offsets, [*keys, _BUCKET])
        .withColumn(out, F.col("__in") + F.col("__before"))
        .drop("__in", "__before", "__v", _BUCKET)
        .select(*df.columns, out)
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """1-based position per key in the given order."""
    return running_sum(df, keys, order, bucket, out)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Add ``out``: the value of the row before, per key in order; null on a key's first row."""
    rows = df.withColumn(_BUCKET, bucket)
    lasts = rows.groupBy(*keys, _BUCKET).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = lasts.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy(_BUCKET))).drop("__last")
    inside = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (
        rows.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__prev", F.lag(value).over(inside))
        .join(carried, [*keys, _BUCKET])
        .withColumn(out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__prev")))
        .select(*df.columns, out)
    )


def salt(*cols: str, parts: int = 256) -> Column:
    """A stable spread of rows over ``parts`` groups, independent of the grouping key."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")
