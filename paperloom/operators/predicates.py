"""Filters, searches and validations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.functions import columns as C
from paperloom.functions import skew
from paperloom.functions.json_text import kind_of, object_entries
from paperloom.operators.ordering import first_with_total
from paperloom.schemas import optional

# Fixed values of the storage events.
BLOB_CREATED = "Microsoft.Storage.BlobCreated"
VALIDATION_EVENT = "Microsoft.EventGrid.SubscriptionValidationEvent"
DATASETS_SUBJECT = "/blobServices/default/containers/datasets/blobs/"


def filter_docs(rows: DataFrame, dataset: str | None = None, status: str | None = None) -> DataFrame:
    if dataset:
        rows = rows.filter(F.col("dataset") == dataset)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows


def filter_explore(
    rows: DataFrame,
    datasets: Sequence[str] | None = None,
    finished: str = "All",
    date_range: Sequence[str] = (),
) -> DataFrame:
    """Dataset selection, finished state and an inclusive date range.

    Rows that are not finished are those failed or waiting. As in the legacy screen a range
    with one end keeps nothing.
    """
    if datasets is not None:
        rows = rows.filter(F.col("dataset").isin(*datasets))
    done = C.is_true(F.col("processing_completed"))
    if finished == "Finished":
        rows = rows.filter(done)
    elif finished == "Not Finished":
        rows = rows.filter(~done)
    if len(date_range) == 2:
        lo, hi = (F.lit(d).cast("date") for d in date_range)
        rows = rows.filter(F.to_date("request_timestamp").between(lo, hi))
    elif date_range:
        rows = rows.filter(F.lit(False))
    return rows


def search_names(rows: DataFrame, q: str) -> DataFrame:
    """Case-insensitive literal substring of file name or dataset."""
    if not q:
        return rows
    needle = F.lower(F.lit(q))
    return rows.filter(F.contains(F.lower("file_name"), needle) | F.contains(F.lower("dataset"), needle))


def search_content(
    docs: DataFrame, q: str, dataset: str | None = None, limit: int = 20
) -> DataFrame:
    """Documents whose name, extraction or text holds the lower-cased query.

    ``docs`` has ``id, dataset, file_name, status, extraction, ocr_output``. Every row says
    where it matched and how many documents matched in all; the first ``limit`` by id are
    kept. The texts are read once, by ``first_with_total``, and hits are not shuffled.
    """
    needle = F.lit(q.lower())
    places = {"filename": "file_name", "extraction": "extraction", "ocr_text": "ocr_output"}
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(c), needle), F.lit(n)) for n, c in places.items()]))
    if dataset:
        docs = docs.filter(F.col("dataset") == dataset)
    matches = docs.select("id", F.col("file_name").alias("filename"), "dataset", "status", hits.alias("match_in")).filter(
        F.size("match_in") > 0
    )
    return first_with_total(matches, "id", limit, "total_matches")


def filter_events(events: DataFrame) -> DataFrame:
    """Blob-created events of the datasets container as (filename, dataset, blob_path, blob_name).

    Files must lie in a folder. The place is read from the URL, or from ``subject``, where the frame has
    it, if the URL gives none. Works on batch and streaming frames with ``event_id, event_type, url``.
    """
    parts = C.blob_url_parts(F.col("url"))
    segments = F.split(parts["blob_name"], "/")
    of_url = F.when(
        F.contains("url", F.lit("/datasets/")) & (parts["container"] == "datasets") & (F.size(segments) >= 2),
        F.struct(
            F.element_at(segments, -1).alias("filename"), segments[0].alias("dataset"),
            F.concat(F.lit("/datasets/"), parts["blob_name"]).alias("blob_path"),
        ),
    )
    place = F.coalesce(of_url, subject_parts(F.col("subject"))) if "subject" in events.columns else of_url
    return (
        events.filter(F.col("event_type") == BLOB_CREATED).withColumn("p", place).filter(F.col("p").isNotNull())
        .select(
            *[c for c in events.columns if c != "event_type"], "p.filename", "p.dataset", "p.blob_path",
            F.substring("p.blob_path", F.lit(len("/datasets/") + 1), F.length("p.blob_path")).alias("blob_name"),
        )
    )


def subject_parts(subject: Column) -> Column:
    """struct(filename, dataset, blob_path) of an event subject, null outside the datasets container."""
    rest = F.replace(subject, F.lit(DATASETS_SUBJECT), F.lit(""))
    cut = F.split(rest, "/")
    return F.when(
        F.contains(subject, F.lit(DATASETS_SUBJECT)) & (F.size(cut) > 1),
        F.struct(
            F.element_at(cut, -1).alias("filename"), cut[0].alias("dataset"),
            F.concat(F.lit("/datasets/"), rest).alias("blob_path"),
        ),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``reason``, null for an acceptable (filename, dataset, blob_path) request."""
    missing = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in ("filename", "dataset", "blob_path")]
    names = F.concat_ws(", ", *missing)
    path = C.blob_path_parts(F.col("blob_path"))
    return requests.withColumn(
        "reason",
        F.when(names != "", F.concat(F.lit("missing: "), names)).otherwise(path["error"]),
    )


def validate_dataset_config(configs: DataFrame, existing: DataFrame) -> DataFrame:
    """Check new dataset configurations; ``reason`` is null for a valid one.

    With neither text nor images switched on, text is switched on.
    """
    name, prompt = F.col("dataset"), F.col("model_prompt")
    bare = F.length(F.regexp_replace(prompt, r"^\s+|\s+$", ""))
    schema = F.try_parse_json(F.col("example_schema"))
    known = existing.select("dataset").distinct().withColumn("__known", F.lit(True))
    reason = (
        F.when(C.non_empty(name).isNull(), F.lit("dataset_name is required"))
        .when(C.non_empty(prompt).isNull(), F.lit("system_prompt is required"))
        .when(F.col("example_schema").isNull(), F.lit("output_schema is required"))
        .when(~name.rlike("^[a-zA-Z0-9-]+$"), F.lit("invalid characters in dataset_name"))
        .when(~F.length(name).between(2, 50), F.lit("dataset_name must have 2 to 50 characters"))
        .when(bare < 10, F.lit("system_prompt must have at least 10 characters"))
        .when(F.coalesce(kind_of(schema) != "object", F.lit(True)), F.lit("output_schema must be an object"))
        .when(F.col("__known"), F.lit("dataset already exists"))
    )
    out = configs.join(known, "dataset", "left").withColumn("reason", reason).drop("__known")
    if "include_ocr" in configs.columns and "include_images" in configs.columns:
        out = out.withColumn("include_ocr", F.col("include_ocr") | ~F.col("include_images"))
    return out


def chunk_size_guard(c: Column) -> Column:
    """struct(size, oversized): below 1 becomes 10; above 50 is kept and flagged."""
    return F.struct(
        F.when(c < 1, F.lit(10)).otherwise(F.coalesce(c, F.lit(10))).alias("size"),
        F.coalesce(c > 50, F.lit(False)).alias("oversized"),
    )


def suspicious_extractions(docs: DataFrame, column: str = "extraction") -> DataFrame:
    """Extractions with fewer than three fields, or carrying an error marker."""
    fields = F.map_keys(object_entries(F.col(column)))
    marked = F.array_contains(fields, "error") | F.array_contains(fields, "extraction_failed")
    return (
        docs.withColumn("n_fields", F.size(fields))
        .withColumn("has_error_marker", F.coalesce(marked, F.lit(False)))
        .filter(fields.isNotNull() & ((F.col("n_fields") < 3) | F.col("has_error_marker")))
    )


def with_optional(df: DataFrame, *names: str) -> DataFrame:
    """Add missing text columns as null, so validations can name them."""
    return df.select(*df.columns, *[optional(df, n).alias(n) for n in names if n not in df.columns])
