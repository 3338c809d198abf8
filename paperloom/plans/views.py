"""Document-store views over the given tables.

Each view exists twice: as a DataFrame for the Spark queries and as SQL text, inlined as a
CTE, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.schemas import OPTION_FLAGS, SKIP_FLAGS
from paperloom.session import spread

ERROR_PREFIXES = [
    "OCR processing error",
    "GPT extraction error",
    "GPT evaluation error",
    "Summary processing error",
    "Processing error",
]

VIEW_SQL = {
    "doc_view": """
SELECT concat(source, '__doc_', doc_id, '.pdf') AS id, source AS dataset, concat('doc_', doc_id, '.pdf') AS file_name,
       concat(source, '/doc_', doc_id, '.pdf') AS blob_name, n_chars AS blob_size,
       CAST(ceil(n_chars / 300.0) AS INT) AS num_pages, text AS ocr_output, lang, doc_id,
       doc_id % 12 > 0 AS file_landed, doc_id % 12 > 1 AS ocr_completed, doc_id % 12 > 2 AS gpt_extraction_completed,
       doc_id % 12 > 3 AS gpt_evaluation_completed, doc_id % 12 > 4 AS gpt_summary_completed,
       doc_id % 12 > 5 AS processing_completed, doc_id % 17 = 0 AS has_error,
       CASE WHEN doc_id % 12 > 5 THEN CAST((n_chars % 970) / 10.0 AS DOUBLE) END AS total_time_seconds,
       CAST(date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS TIMESTAMP) AS request_timestamp,
       CASE WHEN doc_id % 17 = 0 THEN concat(CASE doc_id % 5 WHEN 0 THEN 'OCR processing error' WHEN 1 THEN 'GPT extraction error'
         WHEN 2 THEN 'GPT evaluation error' WHEN 3 THEN 'Summary processing error' ELSE 'Processing error' END, ': doc_', doc_id) END AS error_text,
       CASE WHEN doc_id % 12 > 2 THEN concat('{"lang":"', lang, '","pages":', CAST(CAST(ceil(n_chars / 300.0) AS INT) AS VARCHAR(20)), '}') END AS extraction
FROM documents""",
    "chunk_view": """
SELECT id, CAST(c AS INT) AS chunk_idx, substr(ocr_output, CAST(c * 1500 + 1 AS INT), 1500) AS chunk_text,
       CAST((c + blob_size) % 40 / 8.0 AS DOUBLE) AS ocr_seconds, blob_size, num_pages
FROM (SELECT *, unnest(range(CAST(ceil(num_pages / 5.0) AS BIGINT))) AS c FROM doc_view)""",
    "gt_leaf": """
SELECT p_partkey AS item, 'Item.Description' AS path, p_name AS gt, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN replace(p_name, ' ', ', ') ELSE p_name END AS actual FROM part
UNION ALL
SELECT p_partkey, 'Item.Price', CAST(p_retailprice AS VARCHAR(40)), CASE WHEN p_partkey % 3 = 0 THEN concat('$', CAST(p_retailprice AS VARCHAR(40))) ELSE CAST(p_retailprice AS VARCHAR(40)) END FROM part""",
    "response_view": """
SELECT event_id AS response_id, event_type AS model, ts,
  CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
    WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN concat('Result: ', props)
    WHEN 4 THEN replace(props, '"', '''') WHEN 5 THEN replace(props, '}', ',}') WHEN 6 THEN concat('[', props, ']') ELSE replace(props, ':', '') END AS content,
  CASE WHEN event_id % 16 = 2 THEN 'length' ELSE 'stop' END AS finish_reason
FROM events""",
    "correction_view": """
SELECT user_id AS document_id, event_id AS correction_id, ts, concat('u', user_id % 7) AS corrector_id, event_type AS notes, props AS corrected_data
FROM events WHERE event_type IN ('purchase', 'signup')""",
    "feedback_view": """
SELECT user_id AS document_id, event_id, ts, CAST(1 + event_id % 10 AS INT) AS rating, event_type AS comments FROM events WHERE event_type = 'view'""",
    "image_view": """
SELECT l_orderkey AS document_id, l_linenumber AS page_num, CAST(floor(l_extendedprice * 60) AS BIGINT) AS n_bytes, l_partkey AS image_id, l_suppkey, l_shipdate FROM lineitem""",
    "run_view": """
SELECT concat('run_', l_linenumber, '.json') AS file, concat('json_evaluator.CustomStringEvaluator.f', l_partkey % 44) AS metric, round(avg(l_discount), 9) AS value
FROM lineitem GROUP BY 1, 2""",
    "config_view": """
SELECT source AS dataset, concat('Extract everything from ', source) AS model_prompt, CAST(5 + min(doc_id) % 10 AS INT) AS max_pages_per_chunk FROM documents WHERE source <> 'src3' GROUP BY source""",
    "turn_view": "SELECT conv_id, turn, role, text FROM conversations",
    "blob_event_view": """
SELECT page_id AS event_id, CASE WHEN page_id % 9 = 0 THEN 'Microsoft.Storage.BlobDeleted' ELSE 'Microsoft.Storage.BlobCreated' END AS event_type,
  concat('https://acct.blob.core.windows.net/', CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'datasets' END, '/ds', page_id % 6, '/p', page_id, '.pdf') AS url FROM pages""",
    "status_view": """
SELECT *, CASE WHEN has_error THEN 'failed' WHEN processing_completed OR gpt_summary_completed OR gpt_evaluation_completed THEN 'completed'
  ELSE 'processing' END AS status,
  CASE WHEN has_error THEN 'failed' WHEN gpt_summary_completed OR gpt_evaluation_completed OR processing_completed THEN 'completed'
  WHEN file_landed OR ocr_completed OR gpt_extraction_completed THEN 'processing' ELSE 'pending' END AS status4
FROM doc_view""",
}
_NEEDS = {"chunk_view": ("doc_view",), "status_view": ("doc_view",)}


def with_views(names: tuple[str, ...], sql: str) -> str:
    """Prefix a statement with the named views, and the views they need, as CTEs."""
    order: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of them; a plain path would have to be a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def doc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_view_of(table(spark, sf_dir, "documents"))


def doc_view_of(d: DataFrame) -> DataFrame:
    step = F.col("doc_id") % 12
    prefix = F.lit(ERROR_PREFIXES[-1])
    for i, text in enumerate(ERROR_PREFIXES[:-1]):
        prefix = F.when(F.col("doc_id") % 5 == i, F.lit(text)).otherwise(prefix)
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf"))
    pages = F.ceil(F.col("n_chars") / 300.0).cast("int")
    return d.select(
        F.concat(F.col("source"), F.lit("__"), name).alias("id"),
        F.col("source").alias("dataset"),
        name.alias("file_name"),
        F.concat(F.col("source"), F.lit("/"), name).alias("blob_name"),
        F.col("n_chars").alias("blob_size"),
        pages.alias("num_pages"),
        F.col("text").alias("ocr_output"),
        "lang",
        "doc_id",
        (step > 0).alias("file_landed"),
        (step > 1).alias("ocr_completed"),
        (step > 2).alias("gpt_extraction_completed"),
        (step > 3).alias("gpt_evaluation_completed"),
        (step > 4).alias("gpt_summary_completed"),
        (step > 5).alias("processing_completed"),
        (F.col("doc_id") % 17 == 0).alias("has_error"),
        F.when(step > 5, (F.col("n_chars") % 970) / F.lit(10.0)).alias("total_time_seconds"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
        .cast("timestamp_ntz").alias("request_timestamp"),
        F.when(F.col("doc_id") % 17 == 0, F.concat(prefix, F.lit(": doc_"), F.col("doc_id"))).alias("error_text"),
        F.when(
            step > 2,
            F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","pages":'), pages, F.lit("}")),
        ).alias("extraction"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's nested records, shaped from ``doc_view``."""
    return documents_of(doc_view(spark, sf_dir))


def documents_of(d: DataFrame) -> DataFrame:
    total = F.col("total_time_seconds")
    # Shares of the total time by step; powers of two keep the doubles exact.
    shares = {
        "file_landed": 16.0, "ocr_completed": 4.0, "gpt_extraction_completed": 2.0,
        "gpt_evaluation_completed": 8.0, "gpt_summary_completed": 16.0,
    }
    state = F.struct(
        *[F.col(c) for c in (
            "file_landed", "ocr_completed", "gpt_extraction_completed", "gpt_evaluation_completed",
            "gpt_summary_completed", "processing_completed",
        )],
        *[F.lit(None).cast("boolean").alias(c) for c in SKIP_FLAGS],
        *[(total / F.lit(by)).alias(f"{c}_time_seconds") for c, by in shares.items()],
        F.lit(None).cast("boolean").alias("finished"),
        F.col("has_error").alias("error"),
    )
    variant = F.try_parse_json(F.col("extraction"))
    empty = F.try_parse_json(F.lit("{}"))
    return d.select(
        "id",
        "dataset",
        F.struct(
            "blob_name", "blob_size", "request_timestamp", "num_pages", "dataset", "total_time_seconds",
            F.lit(None).cast("string").alias("ocr_provider_used"),
        ).alias("properties"),
        state.alias("state"),
        F.struct(
            "ocr_output",
            variant.alias("gpt_extraction_output"),
            F.when(F.col("gpt_evaluation_completed"), variant).alias("gpt_extraction_output_with_evaluation"),
            F.when(F.col("gpt_summary_completed"), F.col("lang")).alias("gpt_summary_output"),
            F.lit("N/A").alias("classification"),
        ).alias("extracted_data"),
        F.struct(
            F.lit(None).cast("string").alias("model_deployment"),
            F.concat(F.lit("Extract everything from "), F.col("dataset")).alias("model_prompt"),
            empty.alias("example_schema"),
            F.lit(10).alias("max_pages_per_chunk"),
        ).alias("model_input"),
        F.struct(*[F.lit(True).alias(o) for o in OPTION_FLAGS]).alias("processing_options"),
        F.when(F.col("error_text").isNotNull(), F.array("error_text"))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
        F.lit(False).alias("human_corrected"),
        F.lit(None).cast("timestamp_ntz").alias("last_correction_timestamp"),
    )


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1500 characters, 5 pages each, over the whole text."""
    d = doc_view(spark, sf_dir).select("id", "ocr_output", "blob_size", "num_pages")
    chunks = F.ceil(F.col("num_pages") / 5.0).cast("int")
    return (
        d.filter(F.col("num_pages") > 0)
        .withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "id",
            "chunk_idx",
            F.substring(F.col("ocr_output"), F.col("chunk_idx") * 1500 + 1, F.lit(1500)).alias("chunk_text"),
            ((F.col("chunk_idx") + F.col("blob_size")) % 40 / F.lit(8.0)).alias("ocr_seconds"),
            "blob_size",
            "num_pages",
        )
    )


def gt_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"))
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    described = (
        F.when(key % 5 == 0, F.lit(None))
        .when(key % 5 == 1, F.replace("p_name", F.lit(" "), F.lit(", ")))
        .otherwise(F.col("p_name"))
    )
    return p.select(
        key.alias("item"),
        F.explode(F.array(
            F.struct(F.lit("Item.Description").alias("path"), F.col("p_name").alias("gt"), described.alias("actual")),
            F.struct(
                F.lit("Item.Price").alias("path"), price.alias("gt"),
                F.when(key % 3 == 0, F.concat(F.lit("$"), price)).otherwise(price).alias("actual"),
            ),
        )).alias("leaf"),
    ).select("item", "leaf.*")


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ground-truth tree and one extracted tree per part, as JSON text.

    The trees hold the same leaves as ``gt_leaf``; the price is a number in the ground
    truth and the schema tells the scorer to ignore commas in the description.
    """
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"))
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    described = F.when(key % 5 == 1, F.replace("p_name", F.lit(" "), F.lit(", "))).otherwise(F.col("p_name"))
    shown = F.when(key % 3 == 0, F.concat(F.lit("$"), price)).otherwise(price)
    return p.select(
        key.alias("item"),
        F.concat(F.lit('{"Item":{"Description":"'), F.col("p_name"), F.lit('","Price":'), price, F.lit("}}"))
        .alias("ground_truth"),
        F.concat(
            F.lit('{"Item":{'),
            F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"Description":"'), described, F.lit('",'))),
            F.lit('"Price":"'), shown, F.lit('"},"Extra":1}'),
        ).alias("actual"),
        F.lit('{"Item":{"Description":{"CustomStringEvaluator":{"IGNORE_COMMAS":"True"}},"Price":{}}}')
        .alias("eval_schema"),
    )


def response_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, rest = F.col("props"), F.col("event_id") % 8
    fence = "```"
    content = (
        F.when(rest == 0, props)
        .when(rest == 1, F.concat(F.lit(fence + "json\n"), props, F.lit("\n" + fence)))
        .when(rest == 2, F.expr("substr(props, 1, length(props) - 1)"))
        .when(rest == 3, F.concat(F.lit("Result: "), props))
        .when(rest == 4, F.replace(props, F.lit('"'), F.lit("'")))
        .when(rest == 5, F.replace(props, F.lit("}"), F.lit(",}")))
        .when(rest == 6, F.concat(F.lit("["), props, F.lit("]")))
        .otherwise(F.replace(props, F.lit(":"), F.lit("")))
    )
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "props")).select(
        F.col("event_id").alias("response_id"),
        F.col("event_type").alias("model"),
        "ts",
        content.alias("content"),
        F.when(F.col("event_id") % 16 == 2, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
    )


def correction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup")).select(
        F.col("user_id").alias("document_id"),
        F.col("event_id").alias("correction_id"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id") % 7).alias("corrector_id"),
        F.col("event_type").alias("notes"),
        F.col("props").alias("corrected_data"),
    )


def feedback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("document_id"),
        "event_id",
        "ts",
        (1 + F.col("event_id") % 10).cast("int").alias("rating"),
        F.col("event_type").alias("comments"),
    )


def image_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("page_num"),
        F.floor(F.col("l_extendedprice") * 60).cast("bigint").alias("n_bytes"),
        F.col("l_partkey").alias("image_id"),
        "l_suppkey",
        "l_shipdate",
    )


def run_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("run_"), F.col("l_linenumber"), F.lit(".json")).alias("file"),
            F.concat(F.lit("json_evaluator.CustomStringEvaluator.f"), F.col("l_partkey") % 44).alias("metric"),
        )
        .agg(F.round(F.avg("l_discount"), 9).alias("value"))
    )


def config_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter(F.col("source") != "src3")
        .groupBy(F.col("source").alias("dataset"))
        .agg((5 + F.min("doc_id") % 10).cast("int").alias("max_pages_per_chunk"))
        .select(
            "dataset",
            F.concat(F.lit("Extract everything from "), F.col("dataset")).alias("model_prompt"),
            "max_pages_per_chunk",
        )
    )


def turn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def blob_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_event_view_of(table(spark, sf_dir, "pages"))


def blob_event_view_of(pages: DataFrame) -> DataFrame:
    key = F.col("page_id")
    return pages.select(
        key.alias("event_id"),
        F.when(key % 9 == 0, F.lit("Microsoft.Storage.BlobDeleted"))
        .otherwise(F.lit("Microsoft.Storage.BlobCreated")).alias("event_type"),
        F.concat(
            F.lit("https://acct.blob.core.windows.net/"),
            F.when(key % 4 == 0, F.lit("other")).otherwise(F.lit("datasets")),
            F.lit("/ds"), key % 6, F.lit("/p"), key, F.lit(".pdf"),
        ).alias("url"),
    )
