"""Named queries of the tool interface (X): each takes a documents frame and its arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.functions.sqlfunctions import register_sql_functions
from paperloom.operators import evaluate as E
from paperloom.operators import ordering as O
from paperloom.operators import predicates as Q
from paperloom.operators import projections as P
from paperloom.operators import repair as R
from paperloom.operators import sets as S
from paperloom.operators import stages as M
from paperloom.plans import views as V
from paperloom.plans.filters import rows_with_text
from paperloom.plans.registry import query
from paperloom.schemas import has_field


def tool_list_documents(docs: DataFrame, dataset: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest documents, by dataset and derived status."""
    flat = P.document_rows(docs, flags=True).withColumn("status", F.col("status4"))
    listed = O.list_latest(Q.filter_docs(flat, dataset, status), limit)
    return listed.select("id", "file_name", "dataset", "status", "num_pages", "has_extraction", "has_evaluation")


def tool_get_document(docs: DataFrame, document_id: str) -> DataFrame:
    return P.normalize_document(O.get_documents(docs, [document_id]))


def tool_search_names(docs: DataFrame, q: str, dataset: str | None = None, limit: int = 20) -> DataFrame:
    """Name search of the short tool list: file names only, first ``limit`` by id."""
    flat = P.document_rows(docs)
    found = flat.filter(F.contains(F.lower("file_name"), F.lower(F.lit(q))))
    return O.list_any(Q.filter_docs(found, dataset), limit).select("id", "file_name", "dataset", F.col("status4").alias("status"))


def tool_process_urls(urls: DataFrame, default_dataset: str = "default-dataset") -> DataFrame:
    """Queue entries for blob URLs with an optional dataset; a missing URL is refused."""
    dataset = F.coalesce(F.col("dataset"), F.lit(default_dataset)) if has_field(urls, "dataset") else F.lit(default_dataset)
    return urls.select(
        "blob_url", dataset.alias("dataset"),
        F.when(F.coalesce(F.col("blob_url"), F.lit("")) == "", F.lit("blob_url is required")).alias("reason"),
    ).withColumn("status", F.when(F.col("reason").isNull(), F.lit("queued")))


@query("X-04_tool_list_documents", views=("status_view",), sql="""
SELECT id, file_name, dataset, status4 AS status, num_pages, extraction IS NOT NULL AS has_extraction, gpt_evaluation_completed AS has_evaluation
FROM status_view WHERE status4 = 'completed' ORDER BY request_timestamp DESC, id LIMIT 50""")
def list_documents(spark, sf):
    return tool_list_documents(V.documents(spark, sf), status="completed")


@query("X-04_tool_get_document", views=("status_view",), sql="""
SELECT id, dataset, status4 AS status, num_pages, nullif(ocr_output, '') AS ocr_text FROM status_view WHERE id = 'src0__doc_0.pdf'""")
def get_document(spark, sf):
    return tool_get_document(V.documents(spark, sf), "src0__doc_0.pdf").select("id", "dataset", "status", "num_pages", "ocr_text")


@query("X-04_tool_search_names", views=("status_view",), sql="""
SELECT id, file_name, dataset, status4 AS status FROM status_view WHERE contains(lower(file_name), 'doc_1') ORDER BY id LIMIT 20""")
def search_names(spark, sf):
    return tool_search_names(V.documents(spark, sf), "DOC_1")


@query("X-04_tool_search_documents", views=("status_view",), sql="""
SELECT id, count(*) OVER () AS total_matches FROM status_view WHERE contains(lower(ocr_output), 'en') OR contains(lower(extraction), 'en') OR contains(lower(file_name), 'en') ORDER BY id LIMIT 20""")
def search_documents(spark, sf):
    return Q.search_content(rows_with_text(spark, sf), "en").select("id", "total_matches")


@query("X-04_tool_list_datasets", views=("config_view", "doc_view"), sql="""
SELECT d.dataset, c.dataset IS NOT NULL AS configured FROM (SELECT dataset FROM config_view UNION SELECT dataset FROM doc_view) d LEFT JOIN config_view c ON c.dataset = d.dataset""")
def list_datasets(spark, sf):
    configs = V.config_view(spark, sf)
    known = configs.select("dataset", F.lit(True).alias("configured"))
    names = S.all_datasets(configs, V.doc_view(spark, sf)).join(known, "dataset", "left")
    return names.withColumn("configured", F.coalesce("configured", F.lit(False)))


@query("X-04_tool_process_urls", views=("blob_event_view",), sql="""
SELECT CASE WHEN event_id % 10 > 0 THEN url END AS blob_url, 'default-dataset' AS dataset, CASE WHEN event_id % 10 = 0 THEN 'blob_url is required' END AS reason,
  CASE WHEN event_id % 10 > 0 THEN 'queued' END AS status FROM blob_event_view""")
def process_urls(spark, sf):
    urls = V.blob_event_view(spark, sf).select(F.when(F.col("event_id") % 10 > 0, F.col("url")).alias("blob_url"))
    return tool_process_urls(urls)


@query("X-01_named_evaluators", views=("gt_leaf",), sql="""
SELECT evaluator, count(*) AS n, CAST(sum(s) AS DOUBLE) AS score FROM (
  SELECT 'CustomStringEvaluator' AS evaluator, CASE WHEN gt = actual THEN 1 ELSE 0 END AS s FROM gt_leaf
  UNION ALL SELECT 'Prefix', CASE WHEN left(gt, 1) = left(actual, 1) THEN 1 ELSE 0 END FROM gt_leaf) GROUP BY evaluator""")
def named_evaluators(spark, sf):
    same = lambda gt, actual, options: F.coalesce(F.substring(gt, 1, 1) == F.substring(actual, 1, 1), F.lit(False)).cast("int")
    E.register_evaluator(E.Evaluator("Prefix", same))
    scores = E.apply_evaluators(V.gt_leaf(spark, sf), ["item"], E.evaluators("CustomStringEvaluator", "Prefix"))
    return scores.groupBy("evaluator").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("X-01_scores_in_sql", views=("gt_leaf",), sql="""
SELECT item, path, CASE WHEN actual IS NULL THEN 0 WHEN lower(replace(gt, ',', '')) = lower(replace(actual, ',', '')) THEN 1 ELSE 0 END AS exact FROM gt_leaf""")
def scores_in_sql(spark, sf):
    register_sql_functions(spark)
    V.gt_leaf(spark, sf).createOrReplaceTempView("leaf_pairs")
    return spark.sql("""SELECT item, path, match_score(gt, actual, '{"IGNORE_COMMAS":true}') AS exact FROM leaf_pairs""")


@query("X-02_provider_by_name", views=("doc_view",), sql="""
SELECT id, concat(lang, '!') AS output, CAST(NULL AS VARCHAR) AS error FROM doc_view""")
def provider_by_name(spark, sf):
    M.register_provider("echo", lambda text: text + "!")
    work = V.doc_view(spark, sf).select("id", F.col("lang").alias("payload"))
    return M.run_stage(work, M.provider("Echo"), 4).select("id", "output", "error")


@query("X-03_plugged_in_repair", sql="""
SELECT event_id AS response_id, CASE event_id % 8 WHEN 1 THEN 'fence' WHEN 3 THEN 'object' WHEN 4 THEN 'object_syntax' WHEN 5 THEN 'object_syntax' WHEN 7 THEN 'colon' END AS strategy FROM events""")
def plugged_in_repair(spark, sf):
    extra = [*R.REPAIRS, ("colon", lambda c: F.regexp_replace(c, '"k" ', '"k": '))]
    return R.repair_json(V.response_view(spark, sf), repairs=extra).select("response_id", "strategy")


@query("X-05_json_leaf_rows", sql="""
SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS json FROM events""")
def json_leaf_rows(spark, sf):
    register_sql_functions(spark)
    V.table(spark, sf, "events").select("event_id", "props").createOrReplaceTempView("leaf_source")
    return spark.sql("SELECT event_id, path, json FROM leaf_source, LATERAL json_leaf_rows(props)")
