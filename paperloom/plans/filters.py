"""Queries for filters, searches and validations (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import predicates as Q
from paperloom.operators import projections as P
from paperloom.plans import views as V
from paperloom.plans.registry import query


def rows_with_text(spark, sf):
    """Flat rows plus the two searched texts."""
    d = V.documents(spark, sf)
    return d.select(
        "id", "dataset", F.element_at(F.split("properties.blob_name", "/"), -1).alias("file_name"),
        P.status4(d).alias("status"), F.to_json("extracted_data.gpt_extraction_output").alias("extraction"),
        F.col("extracted_data.ocr_output").alias("ocr_output"),
    )


def rows(spark, sf):
    return P.document_rows(V.documents(spark, sf))


@query("F-01_filter_docs", views=("status_view",), sql="""
SELECT id, dataset, status, total_time_seconds FROM status_view WHERE dataset = 'src1' AND status = 'completed'""")
def filter_docs(spark, sf):
    return Q.filter_docs(rows(spark, sf), "src1", "completed").select("id", "dataset", "status", "total_time_seconds")


@query("F-02_filter_explore", views=("doc_view",), sql="""
SELECT id, dataset, processing_completed FROM doc_view WHERE dataset IN ('src0', 'src1', 'src2', 'src5') AND NOT processing_completed
  AND CAST(request_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def filter_explore(spark, sf):
    found = Q.filter_explore(
        rows(spark, sf), ["src0", "src1", "src2", "src5"], "Not Finished", ("2024-01-05", "2024-01-20")
    )
    return found.select("id", "dataset", "processing_completed")


@query("F-03_search_names", views=("doc_view",), sql="""
SELECT id, dataset, file_name FROM doc_view WHERE contains(lower(file_name), 'doc_7') OR contains(lower(dataset), 'doc_7')""")
def search_names(spark, sf):
    return Q.search_names(rows(spark, sf), "DOC_7").select("id", "dataset", "file_name")


@query("F-04_search_content", views=("status_view",), sql="""
WITH hit AS (SELECT id, file_name AS filename, dataset, status4 AS status, contains(lower(file_name), 'the') AS a,
  coalesce(contains(lower(extraction), 'the'), FALSE) AS b, contains(lower(ocr_output), 'the') AS c FROM status_view)
SELECT id, filename, dataset, status, concat_ws(',', CASE WHEN a THEN 'filename' END, CASE WHEN b THEN 'extraction' END, CASE WHEN c THEN 'ocr_text' END) AS match_in,
  count(*) OVER () AS total_matches FROM hit WHERE a OR b OR c ORDER BY id LIMIT 20""")
def search_content(spark, sf):
    return Q.search_content(rows_with_text(spark, sf), "The").withColumn("match_in", F.array_join("match_in", ","))


@query("F-05_filter_events", views=("blob_event_view",), sql="""
SELECT event_id, url, concat('p', event_id, '.pdf') AS filename, concat('ds', event_id % 6) AS dataset,
  concat('/datasets/ds', event_id % 6, '/p', event_id, '.pdf') AS blob_path, concat('ds', event_id % 6, '/p', event_id, '.pdf') AS blob_name
FROM blob_event_view WHERE event_type = 'Microsoft.Storage.BlobCreated' AND contains(url, '/datasets/')""")
def filter_events(spark, sf):
    return Q.filter_events(V.blob_event_view(spark, sf))


@query("F-05_subjects", views=("blob_event_view",), sql="""
SELECT event_id, concat('p', event_id, '.pdf') AS filename, concat('s', event_id % 4) AS dataset, concat('s', event_id % 4, '/sub/p', event_id, '.pdf') AS blob_name
FROM blob_event_view WHERE event_type = 'Microsoft.Storage.BlobCreated' AND event_id % 4 > 0""")
def filter_event_subjects(spark, sf):
    """Events without a URL: the place is read from the subject; one in four lies in another container."""
    container = F.when(F.col("event_id") % 4 > 0, F.lit("datasets")).otherwise(F.lit("other"))
    subject = F.concat(
        F.lit("/blobServices/default/containers/"), container, F.lit("/blobs/s"), F.col("event_id") % 4, F.lit("/sub/p"), "event_id", F.lit(".pdf"))
    events = V.blob_event_view(spark, sf).withColumns({"subject": subject, "url": F.lit(None).cast("string")})
    return Q.filter_events(events).select("event_id", "filename", "dataset", "blob_name")


@query("F-06_validate_requests", views=("doc_view",), sql="""
SELECT id, CASE doc_id % 4 WHEN 1 THEN 'missing: filename' WHEN 2 THEN 'missing: dataset, blob_path' WHEN 3 THEN 'invalid blob path' END AS reason FROM doc_view""")
def validate_requests(spark, sf):
    case = F.col("doc_id") % 4
    path = F.concat(F.lit("/datasets/"), F.col("blob_name"))
    requests = V.doc_view(spark, sf).select(
        "id",
        F.when(case != 1, F.col("file_name")).alias("filename"),
        F.when(case != 2, F.col("dataset")).otherwise(F.lit("")).alias("dataset"),
        F.when(case == 3, F.lit("/datasets/")).when(case != 2, path).alias("blob_path"),
    )
    return Q.validate_requests(requests).select("id", "reason")


def new_configs(spark, sf):
    """Configurations to create: one per document, each breaking at most one rule."""
    case = F.col("doc_id") % 8
    key = F.concat(F.lit("set-"), F.col("doc_id"))
    return V.doc_view(spark, sf).select(
        "doc_id",
        F.when(case == 1, F.lit("")).when(case == 2, F.concat(F.lit("a_"), key)).when(case == 3, F.lit("x"))
        .when(case == 4, F.col("dataset")).otherwise(key).alias("dataset"),
        F.when(case == 5, F.lit("  short   ")).otherwise(F.concat(F.lit("Extract all of "), key)).alias("model_prompt"),
        F.when(case == 6, F.lit("[1]")).otherwise(F.lit('{"total":""}')).alias("example_schema"),
        (F.col("doc_id") % 3 == 0).alias("include_ocr"),
        (F.col("doc_id") % 2 == 0).alias("include_images"),
    )


@query("F-07_validate_dataset_config", views=("doc_view", "config_view"), sql="""
SELECT d.doc_id, CASE d.doc_id % 8 WHEN 1 THEN 'dataset_name is required' WHEN 2 THEN 'invalid characters in dataset_name' WHEN 3 THEN 'dataset_name must have 2 to 50 characters'
  WHEN 4 THEN CASE WHEN c.dataset IS NOT NULL THEN 'dataset already exists' END WHEN 5 THEN 'system_prompt must have at least 10 characters'
  WHEN 6 THEN 'output_schema must be an object' END AS reason, (d.doc_id % 3 = 0) OR NOT (d.doc_id % 2 = 0) AS include_ocr
FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset""")
def validate_dataset_config(spark, sf):
    return Q.validate_dataset_config(new_configs(spark, sf), V.config_view(spark, sf)).select(
        "doc_id", "reason", "include_ocr"
    )


@query("F-08_chunk_size_guard", views=("doc_view",), sql="""
SELECT id, CASE WHEN num_pages - 3 < 1 THEN 10 ELSE num_pages - 3 END AS size, num_pages - 3 > 50 AS oversized FROM doc_view""")
def chunk_size_guard(spark, sf):
    return V.doc_view(spark, sf).select("id", Q.chunk_size_guard(F.col("num_pages") - 3).alias("g")).select("id", "g.*")


@query("F-09_suspicious_extractions", views=("doc_view",), sql="""
SELECT id, CASE WHEN doc_id % 7 = 0 THEN CAST(3 AS INT) ELSE CAST(2 AS INT) END AS n_fields, doc_id % 7 = 0 AS has_error_marker
FROM doc_view WHERE extraction IS NOT NULL AND doc_id % 7 <> 1""")
def suspicious_extractions(spark, sf):
    case = F.col("doc_id") % 7
    extra = F.when(case == 0, F.lit(',"error":"cut"}')).when(case == 1, F.lit(',"total":1}')).otherwise(F.lit("}"))
    text = F.concat(F.expr("substr(extraction, 1, length(extraction) - 1)"), extra)
    docs = V.doc_view(spark, sf).select("id", F.try_parse_json(text).alias("extraction"))
    return Q.suspicious_extractions(docs).select("id", "n_fields", "has_error_marker")
