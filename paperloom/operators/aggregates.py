"""Operational analytics over document rows (see ``document_rows``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.functions import skew

STATUSES = ["completed", "processing", "failed"]

# How recorded errors start, and the class each start stands for.
ERROR_CLASSES = {
    "OCR processing error": "ocr",
    "GPT extraction error": "extraction",
    "GPT evaluation error": "evaluation",
    "Summary processing error": "summary",
    "Processing error": "processing",
}
# Lower bounds of the confidence bands, best first.
CONFIDENCE_BANDS = {
    "1.0": 1.0, "0.9-0.99": 0.9, "0.7-0.89": 0.7, "0.5-0.69": 0.5, "0.3-0.49": 0.3, "0.1-0.29": 0.1, "0.0": 0.0,
}


def status_counts(rows: DataFrame) -> DataFrame:
    """Documents per status with their share in percent; statuses without documents are left out."""
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # The window spans one row per status.
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.select("status", "n", F.round(100.0 * F.col("n") / total, 4).alias("share"))


def dataset_status_pivot(rows: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.groupBy("dataset").agg(*counts)


def files_per_dataset(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def daily_timeline(rows: DataFrame) -> DataFrame:
    """Documents, completed and failed per day, in date order."""
    return (
        rows.groupBy(F.to_date("request_timestamp").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .orderBy("date")
    )


def summary_stats(rows: DataFrame) -> DataFrame:
    """One row: documents, mean seconds of completed ones, pages, success rate in percent."""
    done = F.col("status") == "completed"
    seconds = F.when(done & (F.col("total_time_seconds") != 0), F.col("total_time_seconds"))
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total_docs"),
        F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 1).alias("avg_time"),
        F.coalesce(F.sum("num_pages"), F.lit(0)).cast("bigint").alias("total_pages"),
        F.round(F.when(n > 0, 100.0 * F.count_if(done) / n).otherwise(F.lit(0.0)), 1).alias("success_rate"),
    )


def store_stats(rows: DataFrame) -> DataFrame:
    n, done = F.count(F.lit(1)), F.count_if("processing_completed")
    return rows.agg(
        n.alias("total_documents"),
        done.alias("completed_documents"),
        (n - done).alias("pending_documents"),
        F.when(n > 0, done / n).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between the least and greatest value; empty bins are left out.

    The bounds are one row beside every other, so the table is read twice; the counting pass combines before it shuffles.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("lo"), ((F.max("v") - F.min("v")) / bins).alias("width"))
    place = F.when(F.col("width") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        values.join(F.broadcast(bounds))  # one row
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def exact_percentiles(rows: DataFrame, column: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated percentiles as rows (share, value), without one task seeing all values.

    A mergeable quantile summary gives for each share two values that enclose it; by the summary's error they hold 4 in
    ``accuracy`` of all values between them, however these are distributed. A second pass counts the values inside, one by
    one, and those between the enclosures as a whole, with their ends; ranks are running counts over those few rows.
    """
    shares = sorted(set(map(float, shares)))
    values = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = [max(0.0, s - 2 / accuracy) for s in shares], [min(1.0, s + 2 / accuracy) for s in shares]
    found = values.agg(F.percentile_approx("v", ends[0] + ends[1], accuracy).alias("q"), F.count("v").alias("total"))
    bounds = found.select(F.slice("q", 1, len(shares)).alias("lo"), F.slice("q", len(shares) + 1, len(shares)).alias("hi"), "total")
    placed = values.join(F.broadcast(bounds)).withColumn("region", F.size(F.filter("lo", lambda x: x <= F.col("v"))))  # one row
    lo, hi = F.get("lo", F.col("region") - 1), F.get("hi", F.col("region") - 1)
    inside = F.coalesce(F.col("v") <= hi, F.lit(False))
    part = F.when(inside & (hi > lo), F.least(F.floor((F.col("v") - lo) / (hi - lo) * 998), F.lit(998))).when(inside, 0).otherwise(999)
    counts = placed.groupBy((F.col("region") * 1000 + part).alias("bucket"), F.when(inside, F.col("v")).alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.any_value("total").alias("total"))
    ranked = skew.running_sum(counts, [], ["lowest"], F.col("bucket"), "upto", F.col("n"))
    at = F.col("share") * (F.col("total") - 1)
    low_rank, high_rank = F.floor(at), F.ceil(at)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    near = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(low_rank.between(first, last) | high_rank.between(first, last))

    def value(rank: Column) -> Column:
        known = F.when((F.col("lowest") == F.col("highest")) | (rank == last), F.col("highest")).when(rank == first, F.col("lowest"))
        return F.max(F.when(rank.between(first, last), F.coalesce(known, F.raise_error(F.lit("rank outside its enclosure")).cast("double"))))

    return near.groupBy("share").agg((value(low_rank) + (value(high_rank) - value(low_rank)) * F.max(at - low_rank)).alias("value"))


def error_classes(rows: DataFrame) -> DataFrame:
    """Recorded errors per class."""
    text = F.col("error")
    label = F.lit("other")
    for start, name in ERROR_CLASSES.items():
        label = F.when(F.startswith(text, F.lit(start)), F.lit(name)).otherwise(label)
    return (
        rows.select(F.explode("errors").alias("error"))
        .groupBy(label.alias("error_class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def service_metrics(rows: DataFrame, since: Column) -> DataFrame:
    """Report rows (metric, value) on documents requested at or after ``since``."""
    recent = rows.filter(F.col("request_timestamp") >= since)
    n, done, failed = F.count(F.lit(1)), F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    summary = recent.agg(
        n.cast("double").alias("total_documents"),
        done.cast("double").alias("successful_extractions"),
        failed.cast("double").alias("failed_extractions"),
        F.when(n > 0, F.round(100.0 * done / n, 1)).otherwise(F.lit(0.0)).alias("success_rate"),
        F.round(F.avg("total_time_seconds"), 4).alias("avg_processing_time"),
    )
    long = summary.unpivot([], summary.columns, "metric", "value")
    times = exact_percentiles(recent, "total_time_seconds", [0.5, 0.95, 0.99]).select(
        F.concat(F.lit("p"), F.round(F.col("share") * 100).cast("int"), F.lit("_processing_time")).alias("metric"),
        F.round("value", 4).alias("value"),
    )
    errors = error_classes(recent).select(
        F.concat(F.lit("errors_"), "error_class").alias("metric"), F.col("n").cast("double").alias("value")
    )
    return long.union(times).union(errors)


def confidence_stats(fields: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Per document: fields seen, fields in schema, presence ratio, confidence and counts per band.

    ``fields(id, path, confidence)`` are enriched leaves; ``schema_fields(id, n_schema)``.
    """
    c = F.col("confidence")
    band = F.lit("none")
    for name, low in reversed(CONFIDENCE_BANDS.items()):
        band = F.when(c >= low, F.lit(name)).otherwise(band)
    counts = [F.count_if(F.col("band") == name).alias(f"band_{name}") for name in CONFIDENCE_BANDS]
    seen = fields.withColumn("band", band).groupBy("id").agg(
        F.count(F.lit(1)).alias("fields_seen"),
        F.round(100.0 * F.sum(c), 4).alias("confidence_sum_percent"),
        F.round(100.0 * F.avg(c), 4).alias("confidence_mean_percent"),
        *counts,
    )
    joined = schema_fields.join(seen, "id", "left")
    return joined.withColumn(
        "presence_ratio",
        F.when(F.col("n_schema") > 0, F.coalesce("fields_seen", F.lit(0)) / F.col("n_schema")),
    )


def corrections_summary(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("corrections_count"),
        F.max("ts").alias("last_correction_timestamp"),
        F.lit(True).alias("human_corrected"),
    )


def token_usage(responses: DataFrame, by: Sequence[str] = ("dataset", "date")) -> DataFrame:
    names = ("prompt_tokens", "completion_tokens")
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    return responses.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("responses")).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")
    )


def scatter_points(rows: DataFrame) -> DataFrame:
    """Point sets (id, series, x, y, pages): size and pages against seconds, and seconds over time."""
    t, pages = F.col("total_time_seconds"), F.col("num_pages")
    epoch = F.unix_timestamp(F.col("request_timestamp").cast("timestamp")).cast("double")

    def point(series, x):
        return F.struct(F.lit(series).alias("series"), x.cast("double").alias("x"))

    sets = F.array(
        F.when(t.isNotNull(), point("size", F.col("blob_size"))),
        F.when((pages != 0) & (t != 0), point("pages", pages)),
        F.when((pages > 0) & t.isNotNull(), point("time", epoch)),
    )
    points = rows.select("id", F.explode(F.array_compact(sets)).alias("p"), t.alias("y"), pages.alias("pages"))
    return points.select("id", "p.series", "p.x", "y", "pages")


def scatter_density(points: DataFrame, bins: int = 50) -> DataFrame:
    """Counts over a grid per series, for point sets too large to draw."""
    bounds = points.groupBy("series").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c):
        width = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins
        inside = F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / width), F.lit(bins - 1))
        return F.when(width > 0, inside).otherwise(F.lit(0)).cast("int").alias(f"{c}_bin")

    return (
        points.join(F.broadcast(bounds), "series")  # one row per series, three in all
        .groupBy("series", cell("x"), cell("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
