"""Queries for windows, lists, lookups and set operations (W, K, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import columns as C
from paperloom.operators import chunks as CH
from paperloom.operators import joins as J
from paperloom.operators import jsontree as JT
from paperloom.operators import ordering as O
from paperloom.operators import sets as S
from paperloom.plans import views as V
from paperloom.plans.filters import rows
from paperloom.plans.registry import query

_NUMBERED = "row_number() OVER (PARTITION BY document_id ORDER BY ts, correction_id)"


@query("W-01_number_corrections", views=("correction_view",), sql=f"""
SELECT document_id, correction_id, {_NUMBERED} AS correction_number FROM correction_view""")
def number_corrections(spark, sf):
    return O.number_corrections(V.correction_view(spark, sf)).select(
        "document_id", "correction_id", "correction_number"
    )


@query("W-02_latest_by", views=("feedback_view",), sql="""
SELECT document_id, event_id, rating, comments FROM feedback_view
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by(spark, sf):
    newest = O.latest_by(V.feedback_view(spark, sf), ["document_id"], ["ts", "event_id"])
    return newest.select("document_id", "event_id", "rating", "comments")


def originals(spark, sf):
    """The extraction each corrected document started from."""
    return V.doc_view(spark, sf).select(F.col("doc_id").alias("document_id"), F.col("extraction").alias("original"))


@query("W-03_correction_chain", views=("correction_view", "doc_view"), sql="""
SELECT c.document_id, c.correction_id, c.corrected_data,
  coalesce(lag(c.corrected_data) OVER (PARTITION BY c.document_id ORDER BY c.ts, c.correction_id), d.extraction) AS original_data
FROM correction_view c LEFT JOIN doc_view d ON d.doc_id = c.document_id""")
def correction_chain(spark, sf):
    return O.correction_chain(V.correction_view(spark, sf), originals(spark, sf)).select(
        "document_id", "correction_id", "corrected_data", "original_data"
    )


@query("W-04_correction_history", views=("correction_view",), sql=f"""
SELECT document_id, {_NUMBERED} AS correction_number, corrector_id, notes, corrected_data, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM correction_view ORDER BY document_id, correction_number DESC""")
def correction_history(spark, sf):
    return O.correction_history(V.correction_view(spark, sf)).select(
        "document_id", "correction_number", "corrector_id", "notes", "corrected_data",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )


@query("W-05_last_k_turns", views=("turn_view",), sql="""
SELECT conv_id, turn, role, text FROM turn_view QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""")
def last_k_turns(spark, sf):
    return O.last_k_turns(V.turn_view(spark, sf))


@query("W-06_attachment_budget", views=("image_view",), sql="""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num, image_id, l_suppkey, l_shipdate, n_bytes) AS rn FROM image_view),
sized AS (SELECT *, sum(4 * ceil(n_bytes / 3.0)) OVER (PARTITION BY document_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM ranked WHERE rn <= 10)
SELECT document_id, page_num, image_id, n_bytes, CAST(used AS BIGINT) AS used_bytes FROM sized WHERE used <= 20 * 1024 * 1024""")
def attachment_budget(spark, sf):
    order = ["page_num", "image_id", "l_suppkey", "l_shipdate", "n_bytes"]
    kept = CH.attachment_budget(V.image_view(spark, sf), ["document_id"], order)
    return kept.select("document_id", "page_num", "image_id", "n_bytes", "used_bytes")


@query("W-07_plan_chunks", views=("doc_view", "config_view"), sql="""
WITH sized AS (SELECT d.id, d.num_pages, coalesce(c.max_pages_per_chunk, (SELECT min_by(max_pages_per_chunk, dataset) FROM config_view)) AS m
  FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset),
cut AS (SELECT id, num_pages, m, unnest(range(0, CASE WHEN num_pages > m THEN num_pages ELSE 1 END, m)) AS start_page FROM sized)
SELECT id, CAST(start_page / m AS INT) AS chunk_idx, CAST(start_page AS INT) AS start_page,
  CAST(least(start_page + m, num_pages) - 1 AS INT) AS end_page FROM cut""")
def plan_chunks(spark, sf):
    docs = V.doc_view(spark, sf).select("id", "dataset", "num_pages")
    planned = CH.plan_chunks(J.with_config(docs, V.config_view(spark, sf)))
    return planned.select("id", "chunk_idx", "start_page", "end_page")


@query("W-08_run_number", views=("run_view",), sql="""
SELECT file, metric, value, dense_rank() OVER (ORDER BY file) AS run_number FROM run_view""")
def run_number(spark, sf):
    return O.run_numbers(V.run_view(spark, sf)).select("file", "metric", "value", "run_number")


@query("K-01_list_latest", views=("status_view",), sql="""
SELECT id, dataset, status, strftime(request_timestamp, '%Y-%m-%d %H:%M:%S') AS requested FROM status_view ORDER BY request_timestamp DESC, id LIMIT 50 OFFSET 10""")
def list_latest(spark, sf):
    page = O.list_latest(rows(spark, sf), 50, 10)
    return page.select("id", "dataset", "status", F.date_format("request_timestamp", "yyyy-MM-dd HH:mm:ss").alias("requested"))


@query("K-02_list_any", views=("status_view",), sql="""
SELECT id, file_name AS filename, dataset, status4 AS status, num_pages FROM status_view ORDER BY id LIMIT 50""")
def list_any(spark, sf):
    return O.list_any(rows(spark, sf)).select(
        "id", F.col("file_name").alias("filename"), "dataset", F.col("status4").alias("status"), "num_pages"
    )


@query("K-03_sort_docs", views=("status_view",), sql="""
SELECT id, file_name, total_time_seconds, num_pages FROM status_view ORDER BY coalesce(total_time_seconds, 0) DESC, id""")
def sort_docs(spark, sf):
    return O.sort_docs(rows(spark, sf), "totalTime", "desc").select("id", "file_name", "total_time_seconds", "num_pages")


@query("K-04_slowest", views=("status_view",), sql="""
SELECT id, left(file_name, 20) AS file_name, CAST(floor(total_time_seconds + 0.5) AS BIGINT) AS time, status
FROM status_view WHERE total_time_seconds > 0 ORDER BY time DESC, id LIMIT 20""")
def slowest(spark, sf):
    return O.slowest(rows(spark, sf))


_IDS = [f"src{i}__doc_{n}.pdf" for i in range(50) for n in (0, 1, 11)]
_ID_LIST = ", ".join(f"'{i}'" for i in _IDS)


@query("K-05_get_document", views=("status_view",), sql=f"""
SELECT id, dataset, status, num_pages FROM status_view WHERE id IN ({_ID_LIST})""")
def get_document(spark, sf):
    return O.get_documents(rows(spark, sf), _IDS).select("id", "dataset", "status", "num_pages")


@query("K-05_get_extraction", views=("doc_view",), sql=f"""
SELECT id, file_name, extraction, CASE WHEN extraction IS NULL THEN 'no extraction data' END AS reason FROM doc_view WHERE id IN ({_ID_LIST})""")
def get_extraction(spark, sf):
    found = O.get_documents(V.documents(spark, sf), _IDS)
    return found.select(
        "id", F.element_at(F.split("properties.blob_name", "/"), -1).alias("file_name"),
        F.to_json("extracted_data.gpt_extraction_output").alias("extraction"),
    ).withColumn("reason", F.when(F.col("extraction").isNull(), F.lit("no extraction data")))


@query("K-05_lookup_with_reason", views=("doc_view",), sql="""
WITH wanted AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN id ELSE concat(id, '.gone') END AS id FROM doc_view WHERE doc_id % 3 = 0)
SELECT w.id, d.num_pages, CASE WHEN d.id IS NULL THEN 'document not found' END AS reason FROM wanted w LEFT JOIN doc_view d ON d.id = w.id""")
def lookup_with_reason(spark, sf):
    d = V.doc_view(spark, sf)
    key = F.when(F.col("doc_id") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit(".gone")))
    wanted = d.filter(F.col("doc_id") % 3 == 0).select(key.alias("id"))
    return O.lookup_with_reason(wanted, d.select("id", "num_pages"))


@query("K-06_get_dataset_config", views=("config_view",), sql="""
SELECT w.name, c.dataset, CASE WHEN length(c.model_prompt) > 12 THEN concat(left(c.model_prompt, 12), '...') ELSE c.model_prompt END AS system_prompt,
  length(c.model_prompt) AS system_prompt_length, c.max_pages_per_chunk
FROM (SELECT DISTINCT source AS name FROM documents) w
LEFT JOIN config_view c ON c.dataset = CASE WHEN w.name IN (SELECT dataset FROM config_view) THEN w.name ELSE (SELECT min(dataset) FROM config_view) END""")
def get_dataset_config(spark, sf):
    configs = V.config_view(spark, sf).withColumn("config_name", F.col("dataset"))
    names = V.table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    return J.with_config(names, configs).select(
        F.col("dataset").alias("name"), F.col("config_name").alias("dataset"),
        C.preview(F.col("model_prompt"), 12, "...").alias("system_prompt"),
        F.length("model_prompt").alias("system_prompt_length"), "max_pages_per_chunk",
    )


@query("U-01_all_datasets", views=("config_view", "doc_view"), sql="""
SELECT dataset FROM config_view UNION SELECT dataset FROM doc_view""")
def all_datasets(spark, sf):
    return S.all_datasets(V.config_view(spark, sf), V.doc_view(spark, sf))


@query("U-02_field_diff", views=("correction_view", "doc_view"), sql="""
WITH chain AS (SELECT c.correction_id, c.corrected_data, coalesce(lag(c.corrected_data) OVER (PARTITION BY c.document_id ORDER BY c.ts, c.correction_id), d.extraction) AS original_data
  FROM correction_view c LEFT JOIN doc_view d ON d.doc_id = c.document_id),
before AS (SELECT correction_id, j.key AS path, json_extract_string(original_data, concat('$.', j.key)) AS value FROM chain, json_each(original_data) j),
after AS (SELECT correction_id, j.key AS path, json_extract_string(corrected_data, concat('$.', j.key)) AS value FROM chain, json_each(corrected_data) j)
SELECT *, 'removed' AS side FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after)
UNION ALL SELECT *, 'added' AS side FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before)""")
def field_diff(spark, sf):
    chain = O.correction_chain(V.correction_view(spark, sf), originals(spark, sf))

    def leaves(column):
        tree = chain.select("correction_id", F.try_parse_json(column).alias("data"))
        return JT.json_leaves(tree, "data", ["correction_id"])

    return S.field_diff(leaves("original_data"), leaves("corrected_data"), ["correction_id"])
