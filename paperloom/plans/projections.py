"""Queries for projections and derived columns (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import columns as C
from paperloom.operators import joins as J
from paperloom.operators import ordering as O
from paperloom.operators import projections as P
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.schemas import STEP_FLAGS

DAY = "yyyy-MM-dd HH:mm:ss"


@query("P-01_parse_blob_url", views=("blob_event_view",), sql="""
SELECT event_id, split_part(split_part(replace(url, 'https://', ''), '/', 1), '.', 1) AS account,
  split_part(replace(url, 'https://', ''), '/', 2) AS container,
  array_to_string(string_split(replace(url, 'https://', ''), '/')[3:], '/') AS blob_name
FROM blob_event_view""")
def parse_blob_url(spark, sf):
    return V.blob_event_view(spark, sf).select("event_id", C.blob_url_parts(F.col("url")).alias("p")).select(
        "event_id", "p.*"
    )


@query("P-02_split_blob_path", views=("blob_event_view",), sql="""
WITH paths AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN concat('/only', event_id, '/') ELSE replace(url, 'https://acct.blob.core.windows.net', '') END AS path FROM blob_event_view),
cut AS (SELECT event_id, trim(path, '/') AS p FROM paths)
SELECT event_id, CASE WHEN strpos(p, '/') > 0 THEN split_part(p, '/', 1) END AS container,
  CASE WHEN strpos(p, '/') > 0 THEN substr(p, strpos(p, '/') + 1) END AS blob_name,
  CASE WHEN strpos(p, '/') = 0 THEN 'invalid blob path' END AS error FROM cut""")
def split_blob_path(spark, sf):
    path = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("/only"), F.col("event_id"), F.lit("/"))).otherwise(
        F.replace("url", F.lit("https://acct.blob.core.windows.net"), F.lit(""))
    )
    return V.blob_event_view(spark, sf).select("event_id", C.blob_path_parts(path).alias("p")).select("event_id", "p.*")


@query("P-03_document_id", views=("doc_view",), sql="SELECT blob_name, id FROM doc_view")
def document_id(spark, sf):
    return V.doc_view(spark, sf).select("blob_name", C.document_id(F.col("blob_name")).alias("id"))


@query("P-04_dataset_of", views=("doc_view",), sql="""
SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'default-dataset' ELSE dataset END AS dataset FROM doc_view""")
def dataset_of(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.col("file_name")).otherwise(F.col("blob_name"))
    return V.doc_view(spark, sf).select("id", C.dataset_of(name).alias("dataset"))


@query("P-05_dataset_and_file", views=("doc_view",), sql="""
SELECT id, CASE WHEN doc_id % 4 = 3 THEN 'unknown' ELSE dataset END AS dataset,
  CASE WHEN doc_id % 4 = 1 THEN concat('b__', file_name) WHEN doc_id % 4 = 2 THEN concat('a/', file_name) ELSE file_name END AS file_name
FROM doc_view""")
def dataset_and_file(spark, sf):
    case = F.col("doc_id") % 4
    d, f = F.col("dataset"), F.col("file_name")
    given = F.when(case == 0, d)
    key = (
        F.when(case == 1, F.concat(d, F.lit("__b__"), f))
        .when(case == 2, F.concat(d, F.lit("/a/"), f))
        .when(case == 3, f)
        .otherwise(F.col("id"))
    )
    named = C.dataset_and_file(key, F.when(case == 0, F.col("blob_name")), given, F.when(case == 0, f))
    return V.doc_view(spark, sf).select("id", named.alias("n")).select("id", "n.*")


@query("P-05_skip_container", views=("doc_view",), sql="""
SELECT id, dataset, CASE doc_id % 3 WHEN 0 THEN concat('sub/', file_name) ELSE file_name END AS file_name FROM doc_view""")
def skip_container(spark, sf):
    """Blob names of four segments lose the second one; of two they stay, and without any the id is read."""
    case = F.col("doc_id") % 3
    blob = F.when(case == 0, F.concat("dataset", F.lit("/datasets/sub/"), "file_name")).when(case == 1, F.concat("dataset", F.lit("/"), "file_name"))
    empty = F.lit(None).cast("string")
    pair = C.dataset_and_file(F.col("id"), blob, empty, empty, skip_container=True)
    return V.doc_view(spark, sf).select("id", pair["dataset"].alias("dataset"), pair["file_name"].alias("file_name"))


@query("P-06_flatten_structs", views=("doc_view",), sql="""
SELECT id, dataset, blob_name AS "properties.blob_name", blob_size AS "properties.blob_size", num_pages AS "properties.num_pages",
  total_time_seconds AS "properties.total_time_seconds", processing_completed AS "state.processing_completed",
  total_time_seconds / 4.0 AS "state.ocr_completed_time_seconds" FROM doc_view""")
def flatten_structs(spark, sf):
    flat = P.flatten_structs(V.documents(spark, sf))
    wanted = [
        "id", "dataset", "properties.blob_name", "properties.blob_size", "properties.num_pages",
        "properties.total_time_seconds", "state.processing_completed", "state.ocr_completed_time_seconds",
    ]
    return flat.select([F.col(f"`{c}`") for c in wanted])


@query("P-07_parse_ts", views=("doc_view",), sql="""
SELECT id, CASE doc_id % 5 WHEN 4 THEN NULL ELSE strftime(CASE doc_id % 5 WHEN 1 THEN request_timestamp + INTERVAL '1 hour 30 minutes'
  WHEN 2 THEN request_timestamp + INTERVAL '7 hours' ELSE request_timestamp END, '%Y-%m-%d %H:%M:%S') END AS ts FROM doc_view""")
def parse_ts(spark, sf):
    day = F.date_format("request_timestamp", "yyyy-MM-dd")
    case = F.col("doc_id") % 5
    text = (
        F.when(case == 0, day)
        .when(case == 1, F.concat(day, F.lit("T01:30:00Z")))
        .when(case == 2, F.concat(day, F.lit("T09:00:00+02:00")))
        .when(case == 3, F.concat(day, F.lit("T00:00:00.250000")))
        .otherwise(F.concat(F.lit("on "), day))
    )
    return V.doc_view(spark, sf).select("id", F.date_format(C.parse_ts(text), DAY).alias("ts"))


@query("P-08_normalize_document", views=("status_view",), sql="""
SELECT id, id AS filename, dataset, status4 AS status, strftime(request_timestamp, '%Y-%m-%d %H:%M:%S') AS created_at,
  nullif(total_time_seconds, 0) AS processing_time, nullif(ocr_output, '') AS ocr_text, extraction AS gpt_extraction,
  CASE WHEN gpt_evaluation_completed THEN extraction END AS evaluation, CASE WHEN gpt_summary_completed THEN lang END AS summary,
  error_text AS first_error, num_pages FROM status_view""")
def normalize_document(spark, sf):
    view = P.normalize_document(V.documents(spark, sf))
    return view.select(
        "id", "filename", "dataset", "status", "created_at", "processing_time", "ocr_text", "gpt_extraction",
        "evaluation", "summary", F.get("errors", F.lit(0)).alias("first_error"), "num_pages",
    )


@query("P-09_status4", views=("status_view",), sql="""
SELECT id, status4 AS status, CASE WHEN has_error THEN 'failed' WHEN file_landed OR ocr_completed THEN 'processing' ELSE 'pending' END AS strict_status
FROM status_view""")
def status4(spark, sf):
    d = V.documents(spark, sf)
    return d.select("id", P.status4(d).alias("status"), P.status4(d, strict=True).alias("strict_status"))


@query("P-10_status3", views=("status_view",), sql="SELECT id, status FROM status_view")
def status3(spark, sf):
    d = V.documents(spark, sf)
    return d.select("id", P.status3(d).alias("status"))


_ICON = "CASE WHEN {0} THEN 'done' WHEN has_error THEN 'failed' ELSE 'waiting' END AS {0}"


@query("P-11_step_icons", views=("doc_view",), sql=(
    "SELECT id, " + ", ".join(_ICON.format(s) for s in STEP_FLAGS) + " FROM doc_view"))
def step_icons(spark, sf):
    return P.step_icons(V.documents(spark, sf))


@query("P-12_init_document", views=("doc_view", "config_view"), sql="""
SELECT d.id, d.dataset, d.blob_name, d.blob_size, d.num_pages, TRUE AS file_landed, FALSE AS processing_completed,
  coalesce(c.model_prompt, f.model_prompt) AS model_prompt, coalesce(c.max_pages_per_chunk, f.max_pages_per_chunk) AS max_pages_per_chunk,
  TRUE AS include_ocr, CAST(0 AS INT) AS n_errors, '{}' AS extraction
FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset
LEFT JOIN (SELECT * FROM config_view ORDER BY dataset LIMIT 1) f ON TRUE""")
def init_document(spark, sf):
    blobs = V.doc_view(spark, sf).select("blob_name", "blob_size", "num_pages", "request_timestamp", "dataset")
    new = P.init_document(J.with_config(blobs, V.config_view(spark, sf)))
    return new.select(
        "id", "dataset", "properties.blob_name", "properties.blob_size", "properties.num_pages",
        "state.file_landed", "state.processing_completed", "model_input.model_prompt",
        "model_input.max_pages_per_chunk", "processing_options.include_ocr", F.size("errors").alias("n_errors"),
        F.to_json("extracted_data.gpt_extraction_output").alias("extraction"),
    )


@query("P-13_reset_for_reprocess", views=("doc_view",), sql="""
SELECT id, TRUE AS file_landed, FALSE AS ocr_completed, FALSE AS processing_completed, FALSE AS error, CAST(0 AS INT) AS n_errors
FROM doc_view WHERE has_error""")
def reset_for_reprocess(spark, sf):
    d = V.documents(spark, sf)
    failed = d.filter(P.status3(d) == "failed").select("id")
    return P.reset_for_reprocess(d, failed).select(
        "id", "state.file_landed", "state.ocr_completed", "state.processing_completed", "state.error",
        F.size("errors").alias("n_errors"),
    )


@query("P-14_presence_flags", views=("doc_view",), sql="""
SELECT id, extraction IS NOT NULL AS has_extraction, gpt_evaluation_completed AS has_evaluation FROM doc_view""")
def presence_flags(spark, sf):
    return P.presence_flags(V.documents(spark, sf))


@query("P-14_config_presence", views=("config_view",), sql="""
SELECT dataset, TRUE AS has_system_prompt, FALSE AS has_output_schema, FALSE AS has_ground_truth FROM config_view""")
def config_presence(spark, sf):
    return P.config_presence(V.config_view(spark, sf).withColumn("example_schema", F.lit("{}")))


@query("P-15_preview", views=("doc_view",), sql="""
SELECT id, CASE WHEN length(ocr_output) > 3000 THEN concat(left(ocr_output, 3000), '...') ELSE ocr_output END AS chat_text,
  left(ocr_output, 2000) AS tool_text, left(file_name, 20) AS label FROM doc_view""")
def preview(spark, sf):
    text = F.col("ocr_output")
    return V.doc_view(spark, sf).select(
        "id", C.preview(text, 3000, "...").alias("chat_text"), C.preview(text, 2000).alias("tool_text"),
        C.preview(F.col("file_name"), 20).alias("label"),
    )


@query("P-16_content_type", views=("doc_view",), sql="""
WITH named AS (SELECT id, CASE doc_id % 5 WHEN 0 THEN file_name WHEN 1 THEN replace(file_name, '.pdf', '.JPG') WHEN 2 THEN replace(file_name, '.pdf', '.tif')
  WHEN 3 THEN replace(file_name, '.pdf', '') ELSE replace(file_name, '.pdf', '.old.xlsx') END AS file_name, doc_id FROM doc_view)
SELECT id, file_name, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff'
  WHEN 3 THEN 'application/octet-stream' ELSE 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' END AS content_type,
  CASE WHEN doc_id % 5 = 1 THEN 'image_url' ELSE 'document_url' END AS route FROM named""")
def content_type(spark, sf):
    case, f = F.col("doc_id") % 5, F.col("file_name")
    name = F.when(case == 0, f)
    for i, ext in ((1, ".JPG"), (2, ".tif"), (3, ""), (4, ".old.xlsx")):
        name = name.when(case == i, F.replace(f, F.lit(".pdf"), F.lit(ext)))
    return (
        V.doc_view(spark, sf).select("id", name.alias("file_name"))
        .select("id", "file_name", C.content_type(F.col("file_name")).alias("content_type"),
                C.ocr_route(F.col("file_name")).alias("route"))
    )


@query("P-17_stage_durations", views=("doc_view",), sql="""
WITH t AS (SELECT id, blob_size, num_pages, coalesce(total_time_seconds, 0.0) AS t FROM doc_view)
SELECT id, 'blob_size' AS metric, CAST(blob_size AS DOUBLE) AS value FROM t
UNION ALL SELECT id, 'num_pages', CAST(num_pages AS DOUBLE) FROM t
UNION ALL SELECT id, 'total_time_seconds', t FROM t
UNION ALL SELECT id, 'file_landed_time_seconds', t / 16.0 FROM t
UNION ALL SELECT id, 'ocr_completed_time_seconds', t / 4.0 FROM t
UNION ALL SELECT id, 'gpt_extraction_completed_time_seconds', t / 2.0 FROM t
UNION ALL SELECT id, 'gpt_evaluation_completed_time_seconds', t / 8.0 FROM t
UNION ALL SELECT id, 'gpt_summary_completed_time_seconds', t / 16.0 FROM t""")
def stage_durations(spark, sf):
    return P.stage_durations(V.documents(spark, sf))


@query("P-18_format_report", views=("doc_view",), sql="""
SELECT id, CASE WHEN length(id) <= 20 THEN id ELSE concat(left(id, 17), '...') END AS name,
  CASE WHEN total_time_seconds IS NULL THEN 'N/A' WHEN total_time_seconds < 1 THEN concat(CAST(floor(total_time_seconds * 1000 + 0.5) AS BIGINT), 'ms')
    WHEN total_time_seconds < 60 THEN concat(printf('%.1f', total_time_seconds), 's')
    ELSE concat(CAST(floor(total_time_seconds / 60) AS BIGINT), 'm ', CAST(floor(total_time_seconds % 60 + 0.5) AS BIGINT), 's') END AS duration,
  CASE WHEN blob_size = 0 THEN '0 B' WHEN blob_size < 1024 THEN concat(blob_size, ' B')
    WHEN blob_size < 1048576 THEN concat(regexp_replace(printf('%.2f', floor(blob_size / 1024.0 * 100 + 0.5) / 100), '\\.?0+$', ''), ' KB')
    ELSE concat(regexp_replace(printf('%.2f', floor(blob_size / 1048576.0 * 100 + 0.5) / 100), '\\.?0+$', ''), ' MB') END AS size,
  strftime(request_timestamp, '%b %-d, %Y, %I:%M %p') AS requested FROM doc_view""")
def format_report(spark, sf):
    rows = P.document_rows(V.documents(spark, sf)).withColumn("file_name", F.col("id"))
    return P.format_report(rows)


@query("P-19_strip_system_fields", views=("config_view",), sql="SELECT dataset, model_prompt, max_pages_per_chunk FROM config_view")
def strip_system_fields(spark, sf):
    stored = V.config_view(spark, sf).withColumns({
        "_rid": F.lit("r"), "_etag": F.lit("e"), "_ts": F.lit(1), "partitionKey": F.lit("configuration"),
    })
    return P.strip_system_fields(stored)


@query("P-20_chat_context", views=("turn_view", "doc_view"), sql="""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turn_view),
hist AS (SELECT conv_id, string_agg(concat(upper(role), ': ', text), chr(10) ORDER BY turn) AS history FROM ranked WHERE back <= 5 GROUP BY conv_id)
SELECT d.doc_id AS conv_id, CASE WHEN d.extraction IS NOT NULL THEN concat('GPT EXTRACTED DATA:', chr(10), chr(10), '{', chr(10), '  "lang": "', d.lang, '",', chr(10), '  "pages": ', d.num_pages, chr(10), '}')
    WHEN d.ocr_output <> '' THEN concat('DOCUMENT TEXT (OCR):', chr(10), chr(10), CASE WHEN length(d.ocr_output) > 3000 THEN concat(left(d.ocr_output, 3000), '...') ELSE d.ocr_output END) END AS context,
  h.history, CASE WHEN d.extraction IS NULL AND coalesce(d.ocr_output, '') = '' THEN 'no extracted data' END AS reason
FROM doc_view d LEFT JOIN hist h ON h.conv_id = d.doc_id""")
def chat_context(spark, sf):
    docs = V.doc_view(spark, sf).select(F.col("doc_id").alias("conv_id"), "extraction", "ocr_output")
    return O.chat_context(docs, V.turn_view(spark, sf), key="conv_id", k=5)
