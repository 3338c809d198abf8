"""Queries for aggregations (A) and document joins (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import aggregates as A
from paperloom.operators import chunks as CH
from paperloom.operators import joins as J
from paperloom.operators import jsontree as JT
from paperloom.operators import ordering as O
from paperloom.operators import sets as S
from paperloom.plans import views as V
from paperloom.plans.filters import rows
from paperloom.plans.ordering import originals
from paperloom.plans.registry import query

RUN_FILES = [f"run_{i}.json" for i in range(1, 8)]


@query("A-04_status_counts", views=("status_view",), sql="""
SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM status_view GROUP BY status""")
def status_counts(spark, sf):
    return A.status_counts(rows(spark, sf))


@query("A-05_dataset_status_pivot", views=("status_view",), sql="""
SELECT dataset, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'failed') AS failed FROM status_view GROUP BY dataset""")
def dataset_status_pivot(spark, sf):
    return A.dataset_status_pivot(rows(spark, sf))


@query("A-06_files_per_dataset", views=("doc_view",), sql="SELECT dataset, count(*) AS n FROM doc_view GROUP BY dataset")
def files_per_dataset(spark, sf):
    return A.files_per_dataset(rows(spark, sf))


@query("A-07_daily_timeline", views=("status_view",), sql="""
SELECT strftime(request_timestamp, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed FROM status_view GROUP BY 1""")
def daily_timeline(spark, sf):
    return A.daily_timeline(rows(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("A-08_summary_stats", views=("status_view",), sql="""
SELECT count(*) AS total_docs, round(coalesce(avg(total_time_seconds) FILTER (status = 'completed' AND total_time_seconds <> 0), 0.0), 1) AS avg_time,
  CAST(sum(coalesce(num_pages, 0)) AS BIGINT) AS total_pages, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 1) AS success_rate FROM status_view""")
def summary_stats(spark, sf):
    return A.summary_stats(rows(spark, sf))


@query("A-09_store_stats", views=("doc_view",), sql="""
SELECT count(*) AS total_documents, count(*) FILTER (processing_completed) AS completed_documents, count(*) FILTER (NOT processing_completed) AS pending_documents,
  count(*) FILTER (processing_completed) / count(*) AS success_rate FROM doc_view""")
def store_stats(spark, sf):
    return A.store_stats(rows(spark, sf))


@query("A-10_time_histogram", views=("doc_view",), sql="""
WITH b AS (SELECT min(total_time_seconds) AS lo, max(total_time_seconds) AS hi FROM doc_view)
SELECT CAST(least(floor((total_time_seconds - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n, min(total_time_seconds) AS lowest, max(total_time_seconds) AS highest
FROM doc_view, b WHERE total_time_seconds IS NOT NULL GROUP BY 1""")
def time_histogram(spark, sf):
    return A.histogram(rows(spark, sf), "total_time_seconds")


@query("A-10_page_histogram", views=("doc_view",), sql="SELECT num_pages, count(*) AS n FROM doc_view GROUP BY num_pages")
def page_histogram(spark, sf):
    return A.value_counts(rows(spark, sf), "num_pages")


@query("A-11_service_metrics", views=("status_view",), sql="""
WITH recent AS (SELECT * FROM status_view WHERE request_timestamp >= (SELECT max(request_timestamp) FROM doc_view) - INTERVAL '9 days'),
s AS (SELECT count(*) AS n, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failed, avg(total_time_seconds) AS mean,
  quantile_cont(total_time_seconds, 0.5) AS p50, quantile_cont(total_time_seconds, 0.95) AS p95, quantile_cont(total_time_seconds, 0.99) AS p99 FROM recent)
SELECT 'total_documents' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'successful_extractions', done FROM s
UNION ALL SELECT 'failed_extractions', failed FROM s UNION ALL SELECT 'success_rate', round(100.0 * done / n, 1) FROM s
UNION ALL SELECT 'avg_processing_time', round(mean, 4) FROM s UNION ALL SELECT 'p50_processing_time', round(p50, 4) FROM s
UNION ALL SELECT 'p95_processing_time', round(p95, 4) FROM s UNION ALL SELECT 'p99_processing_time', round(p99, 4) FROM s
UNION ALL SELECT concat('errors_', CASE doc_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'extraction' WHEN 2 THEN 'evaluation' WHEN 3 THEN 'summary' ELSE 'processing' END), count(*)
  FROM recent WHERE has_error GROUP BY 1""")
def service_metrics(spark, sf):
    r = rows(spark, sf)
    since = r.agg(F.max("request_timestamp") - F.expr("INTERVAL '9' DAY")).scalar()
    return A.service_metrics(r, since)


@query("A-12_error_classes", views=("doc_view",), sql="""
SELECT CASE doc_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'extraction' WHEN 2 THEN 'evaluation' WHEN 3 THEN 'summary' ELSE 'processing' END AS error_class, count(*) AS n
FROM doc_view WHERE has_error GROUP BY 1""")
def error_classes(spark, sf):
    return A.error_classes(rows(spark, sf))


def timed_chunks(spark, sf):
    t = F.col("ocr_seconds")
    return V.chunk_view(spark, sf).withColumns({"extraction_seconds": t * 2, "evaluation_seconds": t / 2})


@query("A-13_stage_time_totals", views=("chunk_view",), sql="""
SELECT id, sum(ocr_seconds) AS ocr_seconds, sum(ocr_seconds * 2) AS extraction_seconds, sum(ocr_seconds / 2) AS evaluation_seconds,
  sum(ocr_seconds) + sum(ocr_seconds * 2) + sum(ocr_seconds / 2) AS total_seconds FROM chunk_view GROUP BY id""")
def stage_time_totals(spark, sf):
    return CH.stage_time_totals(timed_chunks(spark, sf))


@query("A-14_concat_chunks", views=("chunk_view",), sql="""
SELECT id, string_agg(chunk_text, chr(10) ORDER BY chunk_idx) AS ocr_output FROM chunk_view GROUP BY id""")
def concat_chunks(spark, sf):
    return CH.concat_chunks(V.chunk_view(spark, sf))


@query("A-14_provider_text", views=("doc_view",), sql="""
SELECT id, CASE WHEN doc_id % 5 = 0 THEN concat(lang, chr(10), chr(10), dataset) WHEN doc_id % 5 = 4 THEN '' ELSE lang END AS text FROM doc_view""")
def provider_text(spark, sf):
    case, q = F.col("doc_id") % 5, F.col("lang")
    reply = (
        F.when(case == 0, F.concat(F.lit('{"pages":[{"markdown":"'), q, F.lit('"},{"index":1},{"markdown":"'), F.col("dataset"), F.lit('"}]}')))
        .when(case == 1, F.concat(F.lit('{"content":"'), q, F.lit('"}')))
        .when(case == 2, F.concat(F.lit('{"text":"'), q, F.lit('"}')))
        .when(case == 3, F.concat(F.lit('{"choices":[{"message":{"content":"'), q, F.lit('"}}]}')))
        .otherwise(F.lit('{"other":1}'))
    )
    return V.doc_view(spark, sf).select("id", CH.provider_text(F.try_parse_json(reply)).alias("text"))


def data_chunks(spark, sf):
    """Chunks with their page range and a small extraction: number, text, list, nested object."""
    c = V.chunk_view(spark, sf)
    n = F.col("chunk_idx")
    data = F.concat(
        F.lit('{"n":'), n, F.lit(',"tag":" t'), n, F.lit('  x","list":['), n, F.lit(',"a"],"sub":{"seconds":'),
        F.col("ocr_seconds"), F.lit(',"k'), n % 2, F.lit('":true}'),
        F.when(n % 3 == 1, F.lit(',"mix":"text"')).when(n % 3 == 2, F.lit(',"mix":7')).otherwise(F.lit(',"mix":null')),
        F.lit("}"),
    )
    return c.select(
        "id", "chunk_idx", (n * 5).alias("start_page"),
        (F.least((n + 1) * 5, F.col("num_pages")) - 1).alias("end_page"), data.alias("data"), "ocr_seconds",
    )


@query("A-15_page_range_map", views=("chunk_view",), sql="""
WITH c AS (SELECT id, chunk_idx, num_pages, count(*) OVER (PARTITION BY id) AS n FROM chunk_view)
SELECT id, CASE WHEN any_value(n) = 1 THEN '{"i":0}' ELSE concat('{', string_agg(concat('"pages_', chunk_idx * 5 + 1, '-', least(chunk_idx * 5 + 5, num_pages), '":{"i":', chunk_idx, '}'), ',' ORDER BY chunk_idx), '}') END AS extraction
FROM c GROUP BY id""")
def page_range_map(spark, sf):
    chunks = data_chunks(spark, sf).withColumn("data", F.concat(F.lit('{"i":'), F.col("chunk_idx"), F.lit("}")))
    return CH.page_range_map(chunks, 5)


@query("A-16_merge_chunks", views=("chunk_view",), sql="""
WITH c AS (SELECT id, chunk_idx AS i, CAST(ocr_seconds AS DOUBLE) AS s, count(*) OVER (PARTITION BY id) AS n, max(chunk_idx) OVER (PARTITION BY id) AS last FROM chunk_view)
SELECT id, CAST(sum(i) AS DOUBLE) AS n,
  CASE WHEN any_value(n) = 1 THEN ' t0  x' ELSE string_agg(concat('t', i, ' x'), ' ' ORDER BY i) END AS tag,
  concat('[', string_agg(concat(i, ',"a"'), ',' ORDER BY i), ']') AS list, sum(s) AS seconds,
  CAST(count(*) FILTER (i % 2 = 0) AS DOUBLE) AS k0, CAST(nullif(count(*) FILTER (i % 2 = 1), 0) AS DOUBLE) AS k1,
  CASE WHEN max(last) = 0 THEN NULL WHEN (max(last) % 3) = 1 THEN '"text"' ELSE '7' END AS mix
FROM c GROUP BY id""")
def merge_chunks(spark, sf):
    merged = CH.merge_chunks(data_chunks(spark, sf)).select("id", F.parse_json("json").alias("v"))

    def number(path):
        as_bool = F.try_variant_get("v", path, "boolean").cast("double")
        return F.coalesce(F.try_variant_get("v", path, "double"), as_bool)

    # Kinds differ along "mix": null, text, 7, null, ...; the last truthy one decides.
    mix = F.to_json(F.try_variant_get("v", "$.mix", "variant"))
    return merged.select(
        "id", number("$.n").alias("n"), F.try_variant_get("v", "$.tag", "string").alias("tag"),
        F.to_json(F.try_variant_get("v", "$.list", "variant")).alias("list"),
        number("$.sub.seconds").alias("seconds"), number("$.sub.k0").alias("k0"), number("$.sub.k1").alias("k1"),
        F.nullif(mix, F.lit("null")).alias("mix"),
    )


def enriched_fields(spark, sf):
    """Two fields per image, seen with a confidence taken from the quantity."""
    items = V.table(spark, sf, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("path"),
        (F.col("l_quantity") / F.lit(50.0)).alias("confidence"),
    )


@query("A-17_confidence_stats", sql="""
WITH f AS (SELECT l_orderkey AS id, l_quantity / 50.0 AS c FROM lineitem),
seen AS (SELECT id, count(*) AS fields_seen, round(100.0 * sum(c), 4) AS confidence_sum_percent, round(100.0 * avg(c), 4) AS confidence_mean_percent,
  count(*) FILTER (c >= 1) AS "band_1.0", count(*) FILTER (c >= 0.9 AND c < 1) AS "band_0.9-0.99", count(*) FILTER (c >= 0.7 AND c < 0.9) AS "band_0.7-0.89",
  count(*) FILTER (c >= 0.5 AND c < 0.7) AS "band_0.5-0.69", count(*) FILTER (c >= 0.3 AND c < 0.5) AS "band_0.3-0.49",
  count(*) FILTER (c >= 0.1 AND c < 0.3) AS "band_0.1-0.29", count(*) FILTER (c < 0.1) AS "band_0.0" FROM f GROUP BY id)
SELECT o.o_orderkey AS id, CAST(7 AS BIGINT) AS n_schema, s.* EXCLUDE (id), coalesce(fields_seen, 0) / 7.0 AS presence_ratio
FROM orders o LEFT JOIN seen s ON s.id = o.o_orderkey""")
def confidence_stats(spark, sf):
    schema = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(7).cast("bigint").alias("n_schema"))
    return A.confidence_stats(enriched_fields(spark, sf), schema)


@query("A-18_distinct_datasets", views=("doc_view",), sql="SELECT DISTINCT dataset FROM doc_view ORDER BY dataset")
def distinct_datasets(spark, sf):
    return S.distinct_datasets(rows(spark, sf))


@query("A-19_corrections_summary", views=("correction_view",), sql="""
SELECT document_id, count(*) AS corrections_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_correction_timestamp, TRUE AS human_corrected
FROM correction_view GROUP BY document_id""")
def corrections_summary(spark, sf):
    s = A.corrections_summary(V.correction_view(spark, sf))
    return s.withColumn("last_correction_timestamp", F.date_format("last_correction_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("A-20_token_usage", views=("response_view",), sql="""
SELECT model, strftime(ts, '%Y-%m-%d') AS date, CAST(sum(length(content) + 10) AS BIGINT) AS prompt_tokens, CAST(sum(length(content)) AS BIGINT) AS completion_tokens,
  count(*) AS responses, CAST(sum(2 * length(content) + 10) AS BIGINT) AS total_tokens FROM response_view GROUP BY 1, 2""")
def token_usage(spark, sf):
    r = V.response_view(spark, sf).withColumns({
        "prompt_tokens": F.length("content") + 10, "completion_tokens": F.length("content"),
        "date": F.date_format("ts", "yyyy-MM-dd"),
    })
    return A.token_usage(r, ("model", "date"))


@query("A-21_scatter_points", views=("doc_view",), sql="""
SELECT id, 'size' AS series, CAST(blob_size AS DOUBLE) AS x, total_time_seconds AS y, num_pages AS pages FROM doc_view WHERE total_time_seconds IS NOT NULL
UNION ALL SELECT id, 'pages', CAST(num_pages AS DOUBLE), total_time_seconds, num_pages FROM doc_view WHERE num_pages <> 0 AND total_time_seconds <> 0
UNION ALL SELECT id, 'time', CAST(epoch(request_timestamp) AS DOUBLE), total_time_seconds, num_pages FROM doc_view WHERE num_pages > 0 AND total_time_seconds IS NOT NULL""")
def scatter_points(spark, sf):
    return A.scatter_points(rows(spark, sf))


@query("A-21_scatter_density", views=("doc_view",), sql="""
WITH p AS (
  SELECT 'size' AS series, CAST(blob_size AS DOUBLE) AS x, total_time_seconds AS y FROM doc_view WHERE total_time_seconds IS NOT NULL
  UNION ALL SELECT 'pages', CAST(num_pages AS DOUBLE), total_time_seconds FROM doc_view WHERE num_pages <> 0 AND total_time_seconds <> 0
  UNION ALL SELECT 'time', CAST(epoch(request_timestamp) AS DOUBLE), total_time_seconds FROM doc_view WHERE num_pages > 0 AND total_time_seconds IS NOT NULL),
b AS (SELECT series, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM p GROUP BY series)
SELECT series, CAST(CASE WHEN xh > xl THEN least(floor((x - xl) / ((xh - xl) / 50)), 49) ELSE 0 END AS INT) AS x_bin,
  CAST(CASE WHEN yh > yl THEN least(floor((y - yl) / ((yh - yl) / 50)), 49) ELSE 0 END AS INT) AS y_bin, count(*) AS n
FROM p JOIN b USING (series) GROUP BY 1, 2, 3""")
def scatter_density(spark, sf):
    return A.scatter_density(A.scatter_points(rows(spark, sf)))


@query("D-01_with_config", views=("doc_view", "config_view"), sql="""
SELECT d.id, d.dataset, coalesce(c.model_prompt, f.model_prompt) AS model_prompt, coalesce(c.max_pages_per_chunk, f.max_pages_per_chunk) AS max_pages_per_chunk
FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset LEFT JOIN (SELECT * FROM config_view ORDER BY dataset LIMIT 1) f ON TRUE""")
def with_config(spark, sf):
    docs = V.doc_view(spark, sf).select("id", "dataset")
    return J.with_config(docs, V.config_view(spark, sf)).drop("config_error")


@query("D-02_align_chunks", views=("chunk_view",), sql="""
SELECT id, chunk_idx, CASE WHEN chunk_idx % 4 <> 3 THEN length(chunk_text) END AS ocr, CASE WHEN chunk_idx % 3 <> 2 THEN chunk_idx END AS extraction,
  CASE WHEN chunk_idx % 5 <> 4 THEN ocr_seconds END AS evaluation FROM chunk_view
WHERE chunk_idx % 4 <> 3 OR chunk_idx % 3 <> 2 OR chunk_idx % 5 <> 4""")
def align_chunks(spark, sf):
    c, i = V.chunk_view(spark, sf), F.col("chunk_idx")
    return J.align_chunks({
        "ocr": c.filter(i % 4 != 3).select("id", "chunk_idx", F.length("chunk_text").alias("value")),
        "extraction": c.filter(i % 3 != 2).select("id", "chunk_idx", i.alias("value")),
        "evaluation": c.filter(i % 5 != 4).select("id", "chunk_idx", F.col("ocr_seconds").alias("value")),
    })


@query("D-06_merge_runs", views=("run_view",), sql=(
    "SELECT metric, " + ", ".join(f"max(value) FILTER (file = '{f}') AS \"Run {i}\"" for i, f in enumerate(RUN_FILES, 1))
    + " FROM run_view GROUP BY metric"))
def merge_runs(spark, sf):
    return J.merge_runs(V.run_view(spark, sf), RUN_FILES)


@query("D-06_runs_by_metric", views=("run_view",), sql="""
SELECT metric, CAST(dense_rank() OVER (ORDER BY file) AS INT) AS run, value FROM run_view""")
def runs_by_metric(spark, sf):
    return J.runs_by_metric(V.run_view(spark, sf)).select("metric", F.explode("runs").alias("run", "value"))


@query("D-07_select_rows", views=("doc_view",), sql="""
SELECT id, dataset, num_pages FROM doc_view WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def select_rows(spark, sf):
    docs = V.doc_view(spark, sf).select("doc_id", "id", "dataset", "num_pages")
    good = V.table(spark, sf, "labels").filter(F.col("quality") == 1)
    return J.select_rows(docs, good, "doc_id").drop("doc_id")


@query("D-08_unconfigured_datasets", views=("doc_view", "config_view"), sql="""
SELECT DISTINCT dataset FROM doc_view WHERE dataset NOT IN (SELECT dataset FROM config_view)""")
def unconfigured_datasets(spark, sf):
    return J.unconfigured_datasets(V.doc_view(spark, sf), V.config_view(spark, sf))


@query("D-09_latest_correction_join", views=("correction_view", "doc_view"), sql="""
WITH newest AS (SELECT * FROM correction_view QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, correction_id DESC) = 1)
SELECT d.doc_id AS document_id, d.extraction, coalesce(n.corrected_data, d.extraction) AS current_extraction, n.document_id IS NOT NULL AS human_corrected,
  strftime(n.ts, '%Y-%m-%d %H:%M:%S') AS last_correction_timestamp FROM doc_view d LEFT JOIN newest n ON n.document_id = d.doc_id""")
def latest_correction_join(spark, sf):
    docs = originals(spark, sf).withColumnRenamed("original", "extraction")
    out = J.latest_correction_join(docs, V.correction_view(spark, sf))
    return out.withColumn("last_correction_timestamp", F.date_format("last_correction_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("D-10_schema_coverage", views=("doc_view",), sql="""
WITH t AS (SELECT id, unnest(['lang', 'total']) AS path FROM doc_view WHERE extraction IS NOT NULL),
e AS (SELECT id, unnest(['lang', 'pages']) AS path FROM doc_view WHERE extraction IS NOT NULL)
SELECT coalesce(t.id, e.id) AS id, coalesce(t.path, e.path) AS path, CASE WHEN e.id IS NULL THEN 'missing' WHEN t.id IS NULL THEN 'extra' ELSE 'present' END AS coverage
FROM t FULL JOIN e ON e.id = t.id AND e.path = t.path""")
def schema_coverage(spark, sf):
    d = V.doc_view(spark, sf).filter(F.col("extraction").isNotNull())
    template = d.select("id", F.parse_json(F.lit('{"lang":"","total":""}')).alias("v"))
    extracted = d.select("id", F.try_parse_json("extraction").alias("v"))
    return J.schema_coverage(JT.template_paths(template, "v", ["id"]), JT.json_leaves(extracted, "v", ["id"]))
