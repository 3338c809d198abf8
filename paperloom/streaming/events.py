"""Storage events as a stream: source, duplicates, and new document records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions import columns as C
from paperloom.functions.json_text import is_strict_json, list_items, strict_variant
from paperloom.operators.joins import with_config
from paperloom.operators.predicates import VALIDATION_EVENT, filter_events
from paperloom.operators.projections import init_document
from paperloom.schemas import EVENT
from paperloom.session import keep_last_duplicate_key

# Fixed value: events are redelivered for at most this long.
EVENT_LIFE = "24 hours"


def stream_pushes(spark: SparkSession, path: str, max_files: int | None = None, layout: str = "files") -> DataFrame:
    """Stream of pushed elements: ``body`` (its JSON), ``event`` (null if it is none), ``error``.

    Layout "files" takes a file as one value if it is exactly one, and otherwise every line of it as one; "lines"
    always takes lines, for files too large to be held whole. A value is an event or a list of events; each element of
    a list is judged alone, so a broken one costs no other.
    """
    keep_last_duplicate_key(spark)
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = F.col("value")
    bodies = F.split(text, "[\r\n]+")
    if layout == "files":
        bodies = F.when(is_strict_json(text), F.array(text)).otherwise(bodies)
    rows = reader.text(path, wholetext=layout == "files").select(F.explode(bodies).alias("body")).filter(F.trim("body") != "")
    value = strict_variant(F.col("body"))
    opened = rows.select("body", value.alias("v")).select("body", F.explode(F.coalesce(list_items(F.col("v")), F.array("v"))).alias("e"))
    parsed = F.from_json(F.to_json("e"), EVENT)
    one = opened.select(F.coalesce(F.to_json("e"), "body").alias("body"), F.when(F.startswith(F.schema_of_variant("e"), F.lit("OBJECT")), parsed).alias("event"))
    event = F.when(F.col("event.id").isNotNull(), F.col("event"))
    return one.select("body", event.alias("event")).withColumn("error", F.when(F.col("event").isNull(), F.lit("not an event")))


def stream_push_errors(spark: SparkSession, path: str, max_files: int | None = None, layout: str = "files") -> DataFrame:
    """Pushes and elements of pushes that ``stream_blob_events`` cannot read: ``body, error``."""
    return stream_pushes(spark, path, max_files, layout).filter(F.col("error").isNotNull()).select("body", "error")


def stream_blob_events(spark: SparkSession, path: str, max_files: int | None = None, layout: str = "files") -> DataFrame:
    """Stream of pushed events; handshakes are dropped, broken pushes go to ``stream_push_errors``.

    Columns: event_id, event_type, event_time, subject, url, content_length.
    """
    return (
        stream_pushes(spark, path, max_files, layout)
        .filter(F.col("error").isNull()).select("event.*")
        .filter(F.col("eventType") != VALIDATION_EVENT)
        .select(
            F.col("id").alias("event_id"),
            F.col("eventType").alias("event_type"),
            C.parse_ts(F.col("eventTime")).cast("timestamp").alias("event_time"),
            "subject",
            F.col("data.url").alias("url"),
            F.col("data.contentLength").alias("content_length"),
        )
    )


def dedupe_events(events: DataFrame, life: str = EVENT_LIFE) -> DataFrame:
    """Each event once, however often it is delivered within its life. State is bounded by that life."""
    return events.withWatermark("event_time", life).dropDuplicatesWithinWatermark(["event_id"])


def ingest_stream(events: DataFrame, configs: DataFrame) -> DataFrame:
    """New document records for blob-created events of the datasets container; stateless."""
    landed = filter_events(events).select(
        "blob_name", "dataset",
        F.col("content_length").alias("blob_size"),
        F.lit(None).cast("int").alias("num_pages"),
        F.col("event_time").cast("timestamp_ntz").alias("request_timestamp"),
    )
    return init_document(with_config(landed, configs))
