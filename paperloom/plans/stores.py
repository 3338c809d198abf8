"""Queries for sources and sinks (S), streams (T) and model stages (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import columns as C
from paperloom.operators import chunks as CH
from paperloom.operators import evaluate as E
from paperloom.operators import joins as J
from paperloom.operators import projections as P
from paperloom.operators import stages as M
from paperloom.plans import views as V
from paperloom.plans.aggregates import data_chunks
from paperloom.plans.filters import new_configs
from paperloom.plans.registry import query
from paperloom.schemas import OPTION_FLAGS, STEP_FLAGS
from paperloom.session import shared_dir
from paperloom.sources import configs as SC
from paperloom.sources import documents as SD
from paperloom.sources import evalio as SE
from paperloom.sources.journal import Journal
from paperloom.sources.snapshots import SnapshotTable
from paperloom.streaming import events as TE
from paperloom.streaming import sinks as TS
from paperloom.streaming import state as TT

SECOND = "yyyy-MM-dd HH:mm:ss"


@query("S-01_read_blobs", views=("doc_view",), sql="""
SELECT concat('src=', dataset) AS folder, count(*) AS n, 'txt' AS extension FROM doc_view GROUP BY dataset""")
def read_blobs(spark, sf):
    root = shared_dir(spark, "blobs")
    texts = V.doc_view(spark, sf).select(F.col("dataset").alias("src"), F.concat(F.lit("b"), "doc_id").alias("value"))
    texts.write.mode("overwrite").partitionBy("src").text(root)
    found = SD.read_blobs(spark, root).filter(F.col("extension") == "txt")
    lines = spark.read.text(root).select(F.concat(F.lit("src="), "src").alias("folder"), "value")
    per_folder = lines.groupBy("folder").agg(F.count("value").alias("n"))
    return found.select(C.dataset_of(F.col("blob_name")).alias("folder"), "extension").distinct().join(per_folder, "folder")


@query("S-02_read_documents", views=("doc_view",), sql="""
SELECT id, dataset, num_pages, extraction FROM doc_view WHERE dataset = 'src1'""")
def read_documents(spark, sf):
    path = shared_dir(spark, "documents")
    SD.write_documents(V.documents(spark, sf), path)
    return SD.read_documents(spark, path, "src1").select(
        "id", "dataset", "properties.num_pages", F.to_json("extracted_data.gpt_extraction_output").alias("extraction")
    )


@query("S-03_read_dataset_configs", views=("config_view",), sql="""
SELECT concat('set=', dataset) AS dataset, 'Default model prompt.' AS model_prompt, '{}' AS example_schema, CAST(10 AS INT) AS max_pages_per_chunk FROM config_view""")
def read_dataset_configs(spark, sf):
    """Folders without a prompt file of the expected name: all defaults."""
    root = shared_dir(spark, "configs")
    prompts = V.config_view(spark, sf).select(F.col("dataset").alias("set"), F.col("model_prompt").alias("value"))
    prompts.write.mode("overwrite").partitionBy("set").text(root)
    return SC.read_dataset_configs(spark, root)


@query("S-03_configs_from_item", views=("config_view",), sql="SELECT dataset, model_prompt, '{\"total\":\"\"}' AS example_schema, max_pages_per_chunk FROM config_view")
def configs_from_item(spark, sf):
    body = F.concat(
        F.lit('"'), "dataset", F.lit('":{"model_prompt":"'), "model_prompt",
        F.lit('","example_schema":{"total":""},"max_pages_per_chunk":'), "max_pages_per_chunk", F.lit("}"),
    )
    nested = F.concat(F.lit('{"id":"configuration","partitionKey":"configuration","datasets":{'), body, F.lit("}}"))
    old = F.concat(F.lit('{"id":"configuration","_ts":1,'), body, F.lit("}"))
    item = F.when(F.col("max_pages_per_chunk") % 2 == 0, nested).otherwise(old)
    return SC.configs_from_item(V.config_view(spark, sf).select(item.alias("item")))


@query("S-04_eval_jsonl", views=("gt_leaf",), sql="SELECT item, path, gt, actual FROM gt_leaf")
def eval_jsonl(spark, sf):
    path = shared_dir(spark, "evaldata")
    items = V.eval_items(spark, sf)
    sides = [items.select("item", F.col(c).alias("data")) for c in ("ground_truth", "actual", "eval_schema")]
    SE.write_eval_jsonl(SE.eval_lines(*sides), path)
    back = SE.read_eval_jsonl(spark, path).withColumn("item", F.try_variant_get("record", "$.item", "bigint"))
    return E.aligned_leaves(back, ["item"]).select("item", "path", "gt", "actual")


@query("S-04_unreadable_lines", views=("doc_view",), sql="""
SELECT CASE doc_id % 4 WHEN 1 THEN concat('{"item":', doc_id) ELSE concat('[', doc_id, ']') END AS line,
  CASE doc_id % 4 WHEN 1 THEN 'not JSON' ELSE 'not an object' END AS error FROM doc_view WHERE doc_id % 4 IN (1, 2)""")
def unreadable_lines(spark, sf):
    """Files in which one line of four is cut short and one is a list."""
    path = shared_dir(spark, "evaldata")
    case = F.col("doc_id") % 4
    line = F.when(case == 1, F.concat(F.lit('{"item":'), "doc_id")).when(case == 2, F.concat(F.lit("["), "doc_id", F.lit("]"))).otherwise(
        F.concat(F.lit('{"item":'), "doc_id", F.lit("}")))
    SE.write_eval_jsonl(V.doc_view(spark, sf).select(line.alias("value")), path)
    return SE.unreadable_lines(spark, path).select("line", "error")


@query("S-05_read_eval_runs", views=("run_view",), sql="""
SELECT metric, value, dense_rank() OVER (ORDER BY file) AS run_number FROM run_view""")
def read_eval_runs(spark, sf):
    path = shared_dir(spark, "runs")
    metrics = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
    files = V.run_view(spark, sf).groupBy("file").agg(metrics.alias("metrics"))
    # One file per run, in run order.
    files.orderBy("file").select("metrics").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    return SE.read_eval_runs(spark, path).select("metric", "value", "run_number")


@query("S-06_stream_blob_events", views=("blob_event_view",), sql="""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, url, concat('2024-01-0', 1 + event_id % 5, ' 00:00:00') AS event_time FROM blob_event_view""")
def stream_blob_events(spark, sf):
    path = shared_dir(spark, "pushes")
    pushed_events(spark, sf).write.mode("overwrite").text(path)
    stream = TE.stream_blob_events(spark, path)
    out = TS.run_to_files(stream, shared_dir(spark, "out"), shared_dir(spark, "cp"))
    return out.select("event_id", "event_type", "url", F.date_format("event_time", SECOND).alias("event_time"))


def pushed_events(spark, sf):
    """Event pushes as JSON lists of up to 64 events, with a handshake after every tenth event."""
    e = V.blob_event_view(spark, sf)
    event = F.concat(
        F.lit('{"id":"'), "event_id", F.lit('","eventType":"'), "event_type",
        F.lit('","eventTime":"2024-01-0'), 1 + F.col("event_id") % 5, F.lit('T00:00:00Z","data":{"contentLength":'),
        F.col("event_id") * 10, F.lit(',"url":"'), "url", F.lit('"}}'),
    )
    handshake = F.lit(',{"id":"h","eventType":"Microsoft.EventGrid.SubscriptionValidationEvent","data":{"validationCode":"x"}}')
    extra = F.when(F.col("event_id") % 10 == 0, handshake).otherwise(F.lit(""))
    pushes = e.select(F.floor(F.col("event_id") / 64).alias("push"), F.concat(event, extra).alias("v"))
    return pushes.groupBy("push").agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ","), F.lit("]")).alias("value")).select("value")


def updates_of(spark, sf):
    """Two new versions of every third document, the later one with more pages; and one new document each."""
    d = V.doc_view(spark, sf).filter(F.col("doc_id") % 3 == 0)
    version = F.explode(F.array(F.lit(1), F.lit(2)))
    name = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("new__"), "file_name")).otherwise(F.col("id"))
    return d.select(name.alias("id"), "dataset", F.col("num_pages").alias("p"), version.alias("version")).select(
        "id", "dataset", (F.col("p") + F.col("version")).alias("num_pages"), "version"
    )


_UPSERTED = """
WITH u AS (SELECT CASE WHEN doc_id % 6 = 0 THEN concat('new__', file_name) ELSE id END AS id, dataset, num_pages + 2 AS num_pages FROM doc_view WHERE doc_id % 3 = 0)
SELECT id, dataset, num_pages FROM doc_view WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT id, dataset, num_pages FROM u"""


@query("S-07_upsert", views=("doc_view",), sql=_UPSERTED)
def upsert(spark, sf):
    target = V.doc_view(spark, sf).select("id", "dataset", "num_pages")
    return SD.upsert(target, updates_of(spark, sf))


@query("S-07_stored_upsert", views=("doc_view",), sql=_UPSERTED)
def stored_upsert(spark, sf):
    table = SnapshotTable(spark, shared_dir(spark, "documents"))
    table.create(V.doc_view(spark, sf).select("id", "dataset", "num_pages"))
    table.upsert(updates_of(spark, sf), ["version"])
    return table.read()


@query("S-08_stored_delete", views=("doc_view",), sql="SELECT id, dataset FROM doc_view WHERE NOT has_error")
def stored_delete(spark, sf):
    d = V.doc_view(spark, sf)
    table = SnapshotTable(spark, shared_dir(spark, "documents"))
    table.create(d.select("id", "dataset"))
    table.delete(d.filter("has_error").select("id"))
    return table.read()


@query("S-08_delete_by_ids", views=("doc_view",), sql="SELECT id, dataset FROM doc_view WHERE NOT has_error")
def delete_by_ids(spark, sf):
    d = V.doc_view(spark, sf)
    return SD.delete_by_ids(d.select("id", "dataset"), d.filter("has_error").select("id"))


@query("S-08_missing_ids", views=("doc_view",), sql="SELECT DISTINCT concat(id, '.gone') AS id FROM doc_view WHERE doc_id % 2 = 0")
def missing_ids(spark, sf):
    d = V.doc_view(spark, sf)
    wanted = F.when(F.col("doc_id") % 2 == 0, F.concat("id", F.lit(".gone"))).otherwise(F.col("id"))
    return SD.missing_ids(d.select("id"), d.select(wanted.alias("id")))


@query("S-09_replace_blob", views=("doc_view",), sql="""
WITH u AS (SELECT concat(dataset, '/', CASE WHEN doc_id % 4 = 0 THEN 'new_' ELSE '' END, file_name) AS blob_name, blob_size + 1 AS blob_size, doc_id % 8 = 0 AS queued FROM doc_view WHERE doc_id % 2 = 0)
SELECT blob_name, id, blob_size, FALSE AS queued FROM doc_view WHERE blob_name NOT IN (SELECT blob_name FROM u)
UNION ALL SELECT blob_name, replace(blob_name, '/', '__'), blob_size, queued FROM u""")
def replace_blob(spark, sf):
    d = V.doc_view(spark, sf)
    listing = d.select("blob_name", "id", "blob_size", F.lit(False).alias("queued"))
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new_"), "file_name")).otherwise(F.col("file_name"))
    uploads = d.filter(F.col("doc_id") % 2 == 0).select(
        "dataset", name.alias("file_name"), (F.col("blob_size") + 1).alias("blob_size"), F.lit(1).alias("version"),
        (F.col("doc_id") % 8 == 0).alias("run_ocr"),
        *[F.lit(False).alias(c) for c in ("run_gpt_vision", "run_summary", "run_evaluation")],
    )
    return SD.replace_blob(listing, uploads)


@query("S-10_export_result", views=("doc_view",), sql="""
SELECT id, dataset, extraction FROM doc_view WHERE extraction IS NOT NULL""")
def export_result(spark, sf):
    path = shared_dir(spark, "export")
    SD.export_result(V.documents(spark, sf), path, "extraction")
    back = spark.read.schema("id string, extraction variant, dataset string").json(path)
    return back.select("id", "dataset", F.to_json("extraction").alias("extraction"))


@query("S-10_export_evaluation", views=("doc_view",), sql="""
SELECT id, dataset, extraction AS evaluation FROM doc_view WHERE extraction IS NOT NULL AND gpt_evaluation_completed""")
def export_evaluation(spark, sf):
    path = shared_dir(spark, "export")
    SD.export_result(V.documents(spark, sf), path, "evaluation")
    back = spark.read.schema("id string, evaluation variant, dataset string").json(path)
    return back.select("id", "dataset", F.to_json("evaluation").alias("evaluation"))


@query("S-10_export_summary", views=("doc_view",), sql="""
SELECT dataset, CASE n WHEN 0 THEN concat('# ', id) WHEN 1 THEN '' WHEN 2 THEN lang ELSE '' END AS line
FROM doc_view, range(4) t(n) WHERE gpt_summary_completed""")
def export_summary(spark, sf):
    """Each summary is a heading, an empty line, the text and an empty line."""
    path = shared_dir(spark, "export")
    SD.export_result(V.documents(spark, sf), path, "summary")
    return spark.read.text(path).select("dataset", F.col("value").alias("line"))


@query("S-11_refresh_dataset_configs", views=("config_view",), sql="""
SELECT concat('set=', dataset) AS dataset, 'Default model prompt.' AS model_prompt, CAST(10 AS INT) AS max_pages_per_chunk FROM config_view""")
def refresh_dataset_configs(spark, sf):
    """A stored table of other configurations is replaced by those of the folders."""
    root, table = shared_dir(spark, "configs"), shared_dir(spark, "config-table")
    V.config_view(spark, sf).write.mode("overwrite").parquet(table)
    prompts = V.config_view(spark, sf).select(F.col("dataset").alias("set"), F.col("model_prompt").alias("value"))
    prompts.write.mode("overwrite").partitionBy("set").text(root)
    return SC.refresh_dataset_configs(spark, root, table).select("dataset", "model_prompt", "max_pages_per_chunk")


@query("S-11_upsert_dataset_configs", views=("config_view",), sql="""
SELECT dataset, CASE WHEN max_pages_per_chunk % 2 = 0 THEN concat('Updated for ', dataset) ELSE model_prompt END AS model_prompt, max_pages_per_chunk FROM config_view
UNION ALL SELECT concat(dataset, '-copy'), concat('Updated for ', dataset), max_pages_per_chunk FROM config_view WHERE max_pages_per_chunk % 2 = 1""")
def upsert_dataset_configs(spark, sf):
    c = V.config_view(spark, sf)
    even = F.col("max_pages_per_chunk") % 2 == 0
    updates = c.select(
        F.when(even, F.col("dataset")).otherwise(F.concat("dataset", F.lit("-copy"))).alias("dataset"),
        F.concat(F.lit("Updated for "), "dataset").alias("model_prompt"), "max_pages_per_chunk", F.lit(1).alias("version"),
    )
    return SC.upsert_dataset_configs(c, updates)


@query("S-11_create_dataset_configs", views=("doc_view", "config_view"), sql="""
SELECT d.doc_id, CASE WHEN d.doc_id % 8 IN (0, 7) THEN length(concat('Extract all of set-', d.doc_id)) WHEN d.doc_id % 8 = 4 AND c.dataset IS NULL THEN length(concat('Extract all of set-', d.doc_id)) END AS prompt_length,
  CASE WHEN d.doc_id % 8 IN (0, 7) OR (d.doc_id % 8 = 4 AND c.dataset IS NULL) THEN 'total' END AS schema_fields
FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset""")
def create_dataset_configs(spark, sf):
    configs = V.config_view(spark, sf).withColumn("example_schema", F.lit("{}"))
    _, report = SC.create_dataset_configs(configs, new_configs(spark, sf))
    return report.select("doc_id", "prompt_length", "schema_fields")


@query("S-12_append_corrections", views=("correction_view",), sql="""
SELECT document_id, correction_id, CASE WHEN correction_id % 3 = 0 THEN 'anonymous' ELSE corrector_id END AS corrector_id, corrected_data FROM correction_view WHERE correction_id % 10 <> 0""")
def append_corrections(spark, sf):
    path = shared_dir(spark, "corrections")
    c = V.correction_view(spark, sf).withColumns({
        "corrector_id": F.when(F.col("correction_id") % 3 != 0, F.col("corrector_id")),
        "corrected_data": F.when(F.col("correction_id") % 10 != 0, F.col("corrected_data")),
    })
    half = F.col("correction_id") % 2 == 0
    SD.append_corrections(c.filter(half), path)
    SD.append_corrections(c.filter(~half), path)
    return spark.read.parquet(path).select("document_id", "correction_id", "corrector_id", "corrected_data")


@query("S-12_append_feedback", views=("feedback_view",), sql="""
SELECT document_id, event_id, rating - 1 AS rating FROM feedback_view WHERE rating - 1 BETWEEN 1 AND 10""")
def append_feedback(spark, sf):
    shifted = V.feedback_view(spark, sf).withColumn("rating", F.col("rating") - 1)
    return SD.append_feedback(shifted).select("document_id", "event_id", "rating")


_CREATED = "event_type = 'Microsoft.Storage.BlobCreated' AND contains(url, '/datasets/')"


@query("T-01_ingest_stream", views=("blob_event_view",), sql=f"""
SELECT concat('ds', event_id % 6, '__p', event_id, '.pdf') AS id, concat('ds', event_id % 6) AS dataset, event_id * 10 AS blob_size,
  TRUE AS file_landed, FALSE AS processing_completed FROM blob_event_view WHERE {_CREATED}""")
def ingest_stream(spark, sf):
    path = shared_dir(spark, "pushes")
    pushed_events(spark, sf).write.mode("overwrite").text(path)
    records = TE.ingest_stream(TE.stream_blob_events(spark, path), V.config_view(spark, sf))
    flat = records.select("id", "dataset", "properties.blob_size", "state.file_landed", "state.processing_completed")
    return TS.run_to_files(flat, shared_dir(spark, "out"), shared_dir(spark, "cp"))


@query("T-02_dedupe_events", views=("blob_event_view",), sql="""
SELECT CAST(event_id AS VARCHAR) AS event_id, url FROM blob_event_view""")
def dedupe_events(spark, sf):
    path = shared_dir(spark, "pushes")
    once = pushed_events(spark, sf)
    once.union(once).write.mode("overwrite").text(path)
    events = TE.dedupe_events(TE.stream_blob_events(spark, path), "7 days")
    return TS.run_to_files(events.select("event_id", "url"), shared_dir(spark, "out"), shared_dir(spark, "cp"))


def step_updates(events):
    """Step updates from the event log: one per event, with a reset now and then."""
    step = F.col("event_id") % 7
    name = F.lit("reset")
    for i, flag in enumerate(STEP_FLAGS):
        name = F.when(step == i, F.lit(flag)).otherwise(name)
    return events.select(
        F.col("user_id").cast("string").alias("id"), name.alias("step"), F.col("ts").alias("event_time"),
        (F.col("event_id") % 5 != 0).alias("value"), F.col("value").alias("seconds"),
    )


_STATE = """
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id % 7 AS step, ts, event_id % 5 <> 0 AS value, value AS seconds FROM events),
r AS (SELECT id, max(ts) FILTER (step = 6) AS reset_at, max(ts) AS updated_at FROM u GROUP BY id),
s AS (SELECT u.id, step, arg_max(value, u.ts) AS value, arg_max(seconds, u.ts) AS seconds FROM u JOIN r ON r.id = u.id WHERE step < 6 AND (reset_at IS NULL OR u.ts >= reset_at) GROUP BY u.id, step)
SELECT r.id, coalesce(bool_or(value) FILTER (step = 0), FALSE) OR reset_at IS NOT NULL AS file_landed, coalesce(bool_or(value) FILTER (step = 1), FALSE) AS ocr_completed,
  coalesce(bool_or(value) FILTER (step = 2), FALSE) AS gpt_extraction_completed, coalesce(bool_or(value) FILTER (step = 5), FALSE) AS processing_completed,
  max(seconds) FILTER (step = 1) AS ocr_completed_time_seconds
FROM r LEFT JOIN s ON s.id = r.id GROUP BY r.id, reset_at"""
_STATE_COLUMNS = [
    "id", "file_landed", "ocr_completed", "gpt_extraction_completed", "processing_completed", "ocr_completed_time_seconds",
]


@query("T-03_document_state", sql=_STATE)
def document_state(spark, sf):
    return TT.document_state(step_updates(V.table(spark, sf, "events"))).select(_STATE_COLUMNS)


@query("T-03_document_state_stream", sql=_STATE)
def document_state_stream(spark, sf):
    table = shared_dir(spark, "states")
    TT.state_stream(step_updates(V.table_stream(spark, sf, "events")), table, shared_dir(spark, "cp")).awaitTermination()
    return TT.read_states(spark, table).select(_STATE_COLUMNS)


_STUCK = f"""
WITH states AS ({_STATE}), last AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS updated_at FROM events GROUP BY 1)
SELECT s.id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM states s JOIN last l ON l.id = s.id
WHERE file_landed AND NOT processing_completed AND updated_at < (SELECT max(ts) FROM events) - INTERVAL '6 hours'"""


@query("T-04_stuck_documents", sql=_STUCK)
def stuck_documents(spark, sf):
    events = V.table(spark, sf, "events")
    now = events.agg(F.max("ts")).scalar()
    stuck = TT.stuck_documents(TT.document_state(step_updates(events)), now, "6 HOURS")
    return stuck.withColumn("updated_at", F.date_format("updated_at", SECOND))


@query("T-04_stuck_stream", sql=_STUCK)
def stuck_stream(spark, sf):
    """All updates are one batch here; what is stuck then is what the batch form finds at the newest time."""
    updates = step_updates(V.table_stream(spark, sf, "events")).withColumn("event_time", F.col("event_time").cast("timestamp"))
    stuck = TT.stuck_stream(updates, "6 hours", "0 seconds")
    out = TS.run_to_files(stuck, shared_dir(spark, "out"), shared_dir(spark, "cp"))
    return out.withColumn("updated_at", F.date_format("updated_at", SECOND))


@query("T-05_timeline_stream", views=("status_view",), sql="""
SELECT strftime(request_timestamp, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
FROM status_view WHERE request_timestamp + INTERVAL '3 days' <= (SELECT max(request_timestamp) FROM doc_view) GROUP BY 1""")
def timeline_stream(spark, sf):
    docs = V.documents_of(V.doc_view_of(V.table_stream(spark, sf, "documents")))
    flat = P.document_rows(docs).withColumn("request_timestamp", F.col("request_timestamp").cast("timestamp"))
    out = TS.run_to_files(TS.timeline_stream(flat), shared_dir(spark, "out"), shared_dir(spark, "cp"))
    return out.withColumn("date", F.col("date").cast("string"))


@query("T-06_upsert_stream", views=("correction_view",), sql="""
SELECT CAST(document_id AS VARCHAR) AS id, corrected_data, correction_id AS version FROM correction_view QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY correction_id DESC) = 1""")
def upsert_stream(spark, sf):
    log = shared_dir(spark, "upserts")
    events = V.table_stream(spark, sf, "events").filter(F.col("event_type").isin("purchase", "signup"))
    updates = events.select(F.col("user_id").cast("string").alias("id"), F.col("props").alias("corrected_data"), F.col("event_id").alias("version"))
    TS.upsert_stream(updates, log, shared_dir(spark, "cp")).awaitTermination()
    return TS.read_upserts(spark, log)


def planned_chunks(spark, sf):
    """Planned chunks of all documents with options that differ by document."""
    d = V.doc_view(spark, sf).select("doc_id", "id", "dataset", "num_pages")
    flags = {o: F.col("doc_id") % (i + 3) != 0 for i, o in enumerate(OPTION_FLAGS)}
    return CH.plan_chunks(J.with_config(d, V.config_view(spark, sf))).withColumns(flags)


@query("M-01_plan_work", views=("doc_view", "config_view"), sql="""
WITH sized AS (SELECT d.doc_id, d.id, d.num_pages, coalesce(c.max_pages_per_chunk, (SELECT min_by(max_pages_per_chunk, dataset) FROM config_view)) AS m FROM doc_view d LEFT JOIN config_view c ON c.dataset = d.dataset),
c AS (SELECT *, unnest(range(0, CASE WHEN num_pages > m THEN CAST(ceil(num_pages / m) AS BIGINT) ELSE 1 END)) AS chunk_idx FROM sized)
SELECT id, CAST(chunk_idx AS INT) AS chunk_idx, stage, CAST(NULL AS VARCHAR) AS reason FROM c, (VALUES ('ocr'), ('extraction'), ('evaluation'), ('summary')) s(stage)
WHERE NOT (doc_id % 3 = 0 AND doc_id % 4 = 0) AND (stage = 'extraction' OR (stage = 'ocr' AND doc_id % 3 <> 0) OR (stage = 'summary' AND doc_id % 5 <> 0 AND chunk_idx = 0) OR (stage = 'evaluation' AND doc_id % 6 <> 0))
UNION ALL SELECT id, 0, NULL, 'neither text nor images included' FROM c WHERE doc_id % 3 = 0 AND doc_id % 4 = 0 AND chunk_idx = 0""")
def plan_work(spark, sf):
    return M.plan_work(planned_chunks(spark, sf)).select("id", "chunk_idx", "stage", "reason")


@query("M-01_skipped_flags", views=("doc_view",), sql="""
SELECT id, doc_id % 3 = 0 AS ocr_skipped, doc_id % 6 = 0 AS gpt_evaluation_skipped, doc_id % 5 = 0 AS gpt_summary_skipped FROM doc_view""")
def skipped_flags(spark, sf):
    d = V.doc_view(spark, sf).select("doc_id", "id")
    return M.skipped_flags(d.withColumns({o: F.col("doc_id") % (i + 3) != 0 for i, o in enumerate(OPTION_FLAGS)}))


def stage_work(spark, sf):
    """Extraction, text and evaluation work for every chunk."""
    stages = F.explode(F.array(*[F.lit(s) for s in ("ocr", "extraction", "evaluation")]))
    return data_chunks(spark, sf).withColumn("stage", stages)


def _fake_model(text: str) -> str:
    if text.startswith("bad"):
        raise ValueError("no answer")
    return text.upper()


@query("M-02_run_stage", views=("chunk_view",), sql="""
SELECT id, chunk_idx, CASE WHEN chunk_idx % 7 <> 3 THEN upper(concat(id, ' ', chunk_idx)) END AS output,
  CASE WHEN chunk_idx % 7 = 3 THEN 'ValueError: no answer' END AS error FROM chunk_view""")
def run_stage(spark, sf):
    payload = F.concat(F.when(F.col("chunk_idx") % 7 == 3, F.lit("bad ")).otherwise(F.lit("")), "id", F.lit(" "), "chunk_idx")
    work = V.chunk_view(spark, sf).select("id", "chunk_idx", payload.alias("payload"))
    M.register_provider("upper", _fake_model)
    return M.run_stage(work, M.provider("UPPER"), 4).select("id", "chunk_idx", "output", "error")


@query("M-02_resumed_stage", views=("doc_view",), sql="""
SELECT id, CASE WHEN doc_id % 7 <> 3 THEN upper(id) END AS output, CASE WHEN doc_id % 7 = 3 THEN 'ValueError: no answer' END AS error FROM doc_view""")
def resumed_stage(spark, sf):
    """Half the documents are answered by a first run; the second finds those in the journal and asks for the rest."""
    bad = F.when(F.col("doc_id") % 7 == 3, F.lit("bad ")).otherwise(F.lit(""))
    work = V.doc_view(spark, sf).select("doc_id", "id", F.concat(bad, "id").alias("payload"))
    journal = Journal(spark, shared_dir(spark, "journal"))
    M.run_stage(work.filter(F.col("doc_id") % 2 == 0), _fake_model, 4, journal=journal, key=["id"]).write.format("noop").mode("overwrite").save()
    journal.fold(spark)
    return M.run_stage(work, _fake_model, 4, journal=journal, key=["id"]).select("id", "output", "error")


@query("M-03_build_prompts", views=("chunk_view",), sql="""
WITH w AS (SELECT id, chunk_idx, chunk_idx % 4 IN (0, 1) AND trim(chunk_text) <> '' AS t, chunk_idx % 4 IN (0, 2) AS i, chunk_text, s.stage FROM chunk_view, (VALUES ('extraction'), ('evaluation'), ('summary')) s(stage))
SELECT id, chunk_idx, stage, CASE WHEN t AND i THEN 'text+images' WHEN t THEN 'text' WHEN i THEN 'images' END AS modality,
  CASE WHEN stage = 'extraction' AND NOT t AND NOT i THEN 'no input provided' END AS reason,
  CASE WHEN stage <> 'evaluation' AND t THEN concat('Document:', chr(10), chunk_text) END AS user_text FROM w""")
def build_prompts(spark, sf):
    i = F.col("chunk_idx") % 4
    stages = F.explode(F.array(*[F.lit(s) for s in ("extraction", "evaluation", "summary")]))
    work = V.chunk_view(spark, sf).withColumns({
        "chunk_text": F.when(i.isin(0, 1), F.col("chunk_text")), "n_images": F.when(i.isin(0, 2), 3),
        "model_prompt": F.lit("Extract all."), "example_schema": F.lit("{}"), "extraction": F.lit("{}"),
    }).withColumn("stage", stages)
    return M.build_prompts(work).select("id", "chunk_idx", "stage", "modality", "reason", "user_text")


@query("M-04_assemble_documents", views=("chunk_view",), sql="""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM chunk_view)
SELECT id, CAST(any_value(n) AS INT) AS n_chunks, coalesce(string_agg(concat('t', chunk_idx), chr(10) ORDER BY chunk_idx), '') AS ocr_output,
  CASE WHEN count(*) FILTER (chunk_idx % 11 <> 10) = 0 THEN '{}' WHEN any_value(n) = 1 THEN '{"i":0}'
    ELSE concat('{', string_agg(CASE WHEN chunk_idx % 11 <> 10 THEN concat('"pages_', chunk_idx * 5 + 1, '-', least(chunk_idx * 5 + 5, num_pages), '":{"i":', chunk_idx, '}') END, ',' ORDER BY chunk_idx), '}') END AS extraction,
  sum(ocr_seconds) AS ocr_seconds, TRUE AS ocr_completed, count(*) FILTER (chunk_idx % 11 = 10) = 0 AS processing_completed,
  coalesce(string_agg(CASE WHEN chunk_idx % 11 = 10 THEN 'extraction error: cut' END, ';'), '') AS errors FROM c GROUP BY id""")
def assemble_documents(spark, sf):
    chunks = data_chunks(spark, sf)
    counts = chunks.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    stages = F.explode(F.array(*[F.lit(s) for s in ("ocr", "extraction")]))
    failed = (F.col("stage") == "extraction") & (F.col("chunk_idx") % 11 == 10)
    text = F.when(F.col("stage") == "ocr", F.concat(F.lit("t"), "chunk_idx")).otherwise(
        F.concat(F.lit('{"i":'), "chunk_idx", F.lit("}"))
    )
    results = chunks.join(counts, "id").withColumn("stage", stages).select(
        "id", "chunk_idx", "start_page", "end_page", "n_chunks", "stage",
        F.when(~failed, text).alias("output"), F.when(failed, F.lit("cut")).alias("error"),
        F.col("ocr_seconds").alias("seconds"),
    )
    return M.assemble_documents(results, 5).select(
        "id", "n_chunks", "ocr_output", "extraction", "ocr_seconds", "ocr_completed", "processing_completed",
        F.array_join("errors", ";").alias("errors"),
    )
