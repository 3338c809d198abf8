"""Document store on files: reading, upserts, deletes, appended human input, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions import columns as C
from paperloom.operators.ordering import latest_by
from paperloom.schemas import DOCUMENTS


def read_blobs(
    spark: SparkSession, root: str, dataset: str | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Files below ``root/{dataset}/``: name, size, extension, time; contents are never loaded.

    Page counts come from ``pages(blob_name, num_pages)`` and apply to PDF files only.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/{dataset}" if dataset else base)
        .select("path", F.col("length").alias("blob_size"), "modificationTime")
    )
    name = F.substring_index("path", f"{base.split('://')[-1]}/", -1)
    listed = files.select(
        name.alias("blob_name"), "blob_size", C.extension(name).alias("extension"),
        F.col("modificationTime").alias("request_timestamp"),
    )
    if pages is None:
        return listed.withColumn("num_pages", F.lit(None).cast("int"))
    known = F.when(F.col("extension") == "pdf", F.col("num_pages"))
    return listed.join(pages.select("blob_name", "num_pages"), "blob_name", "left").withColumn("num_pages", known)


def read_documents(spark: SparkSession, path: str, dataset: str | None = None, format: str = "parquet") -> DataFrame:
    """The whole store, or one dataset of it: the filter prunes partitions written by dataset."""
    reader = spark.read.schema(DOCUMENTS)
    docs = reader.json(path) if format == "json" else spark.read.parquet(path)
    return docs.filter(F.col("dataset") == dataset) if dataset else docs


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Store records by dataset. A large dataset spreads over many files and tasks."""
    docs.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("dataset").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, key: str = "id", order: Sequence[str] = ("version",)) -> DataFrame:
    """Target with the newest update of each key in place of, or beside, its rows.

    The target is filtered, not regrouped: with few updates it is never shuffled.
    """
    newest = latest_by(updates, [key], list(order)).select(target.columns)
    return target.join(newest.select(key), key, "left_anti").select(target.columns).union(newest)


def delete_by_ids(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def missing_ids(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids that are not stored; deleting them is reported, not an error."""
    return ids.select(key).distinct().join(target.select(key), key, "left_anti")


def replace_blob(listing: DataFrame, uploads: DataFrame) -> DataFrame:
    """Blob listing after uploads with overwrite.

    ``uploads`` has ``dataset, file_name, blob_size, version`` and the four step switches;
    a blob is queued when any of them is on.
    """
    name = F.concat(F.col("dataset"), F.lit("/"), F.col("file_name"))
    switches = [F.coalesce(F.col(c), F.lit(False)) for c in ("run_ocr", "run_gpt_vision", "run_summary", "run_evaluation")]
    new = uploads.select(
        name.alias("blob_name"), C.document_id(name).alias("id"), "blob_size", F.greatest(*switches).alias("queued"), "version",
    )
    return upsert(listing.select("blob_name", "id", "blob_size", "queued"), new, "blob_name")


def append_corrections(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Accepted corrections, appended to ``path`` when given; those without data are left out."""
    accepted = rows.filter(F.col("corrected_data").isNotNull()).select(
        "document_id", "correction_id", "ts",
        F.coalesce("corrector_id", F.lit("anonymous")).alias("corrector_id"),
        F.coalesce("notes", F.lit("")).alias("notes"), "corrected_data",
    )
    if path:
        accepted.write.mode("append").parquet(path)
    return accepted


def append_feedback(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Accepted feedback: ratings from 1 to 10."""
    accepted = rows.filter(F.col("rating").between(1, 10)).select("document_id", "event_id", "ts", "rating", "comments")
    if path:
        accepted.write.mode("append").parquet(path)
    return accepted


def export_result(docs: DataFrame, path: str, kind: str) -> None:
    """Per-dataset files of extraction or evaluation JSON, or of summary texts."""
    field = {
        "extraction": "extracted_data.gpt_extraction_output",
        "evaluation": "extracted_data.gpt_extraction_output_with_evaluation",
        "summary": "extracted_data.gpt_summary_output",
    }
    if kind not in field:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(field)}")
    value = F.col(field[kind])
    if kind == "summary":
        text = docs.filter(C.non_empty(value).isNotNull()).select("dataset", F.concat(F.lit("# "), "id", F.lit("\n\n"), value, F.lit("\n")).alias("value"))
        text.write.mode("overwrite").partitionBy("dataset").text(path)
    else:
        data = docs.filter(value.isNotNull()).select("dataset", "id", value.alias(kind))
        data.write.mode("overwrite").partitionBy("dataset").json(path)
