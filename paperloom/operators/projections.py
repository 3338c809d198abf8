"""Document projections: normalised views, statuses, reports, new and reset records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.functions import columns as C
from paperloom.schemas import OPTION_FLAGS, SKIP_FLAGS, STEP_FLAGS, TIMED_STEPS, has_field, optional

# Fields the document store adds to every item, and the item's own keys.
STORE_FIELDS = ["id", "partitionKey", "_rid", "_self", "_etag", "_attachments", "_ts"]


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested record to dotted columns; lists stay as they are."""

    def walk(node: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in node.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(walk(df.schema, []))


def has_errors(df: DataFrame) -> Column:
    """Errors may be text or a list; an empty one counts as none."""
    if not has_field(df, "errors"):
        return F.lit(False)
    c = F.col("errors")
    if isinstance(df.schema["errors"].dataType, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce((c != "") & (c != "[]"), F.lit(False))


def _flag(df: DataFrame, name: str) -> Column:
    return C.is_true(optional(df, f"state.{name}", "boolean"))


def _any(df: DataFrame, *names: str) -> Column:
    out = _flag(df, names[0])
    for n in names[1:]:
        out = out | _flag(df, n)
    return out


def status4(df: DataFrame, strict: bool = False) -> Column:
    """failed, completed, processing or pending.

    The literal rule reads keys the pipeline never writes; unless ``strict``, the
    ``*_completed`` flags it does write count as well.
    """
    done, started = ["finished", "gpt_summary", "gpt_evaluation"], ["file_landed", "ocr_completed", "gpt_extraction"]
    if not strict:
        done += ["gpt_summary_completed", "gpt_evaluation_completed", "processing_completed"]
        started += ["gpt_extraction_completed"]
    return (
        F.when(_flag(df, "error") | has_errors(df), F.lit("failed"))
        .when(_any(df, *done), F.lit("completed"))
        .when(_any(df, *started), F.lit("processing"))
        .otherwise(F.lit("pending"))
    )


def status3(df: DataFrame) -> Column:
    """failed, completed or processing, as the explore screen shows it."""
    done = _any(df, "processing_completed", "gpt_summary_completed", "gpt_evaluation_completed")
    return (
        F.when(_flag(df, "error") | has_errors(df), F.lit("failed"))
        .when(done, F.lit("completed"))
        .otherwise(F.lit("processing"))
    )


def step_icons(df: DataFrame) -> DataFrame:
    """One column per step: done, failed (the record has errors) or waiting."""
    failed = has_errors(df)
    steps = [
        F.when(_flag(df, s), F.lit("done")).when(failed, F.lit("failed")).otherwise(F.lit("waiting")).alias(s)
        for s in STEP_FLAGS
    ]
    return df.select("id", *steps)


def document_rows(df: DataFrame, flags: bool = False) -> DataFrame:
    """Flat rows for lists and reports. The text columns stay behind, so scans never read them.

    ``flags`` adds which results a document has, from the same scan.
    """
    named = C.dataset_and_file(
        F.col("id"), optional(df, "properties.blob_name"), optional(df, "dataset"), optional(df, "file_name")
    )
    split_id = C.dataset_and_file(F.col("id"), optional(df, "properties.blob_name"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return df.select(
        "id",
        named["dataset"].alias("dataset"),
        F.coalesce(C.non_empty(optional(df, "file_name")), split_id["file_name"]).alias("file_name"),
        status3(df).alias("status"),
        status4(df).alias("status4"),
        *[_flag(df, s).alias(s) for s in STEP_FLAGS],
        has_errors(df).alias("has_error"),
        optional(df, "errors", "array<string>").alias("errors"),
        F.coalesce(optional(df, "properties.request_timestamp", "timestamp_ntz")).alias("request_timestamp"),
        optional(df, "properties.total_time_seconds", "double").alias("total_time_seconds"),
        optional(df, "properties.num_pages", "int").alias("num_pages"),
        F.coalesce(optional(df, "properties.blob_size", "bigint"), F.lit(0).cast("bigint")).alias("blob_size"),
        *(_flags(df) if flags else ()),
    )


def normalize_document(df: DataFrame) -> DataFrame:
    """The public 17-field view; '' and 0 fall through to the next source of a field.

    Where the legacy top-level keys are absent the nested fields are used.
    """
    s = lambda path: optional(df, path)
    ts = lambda path: optional(df, path).cast("string")
    created = C.first_truthy(ts("request_timestamp"), ts("created_at"), ts("properties.request_timestamp"))
    updated = C.first_truthy(ts("updated_at"), ts("request_timestamp"), ts("properties.request_timestamp"))
    duration = F.coalesce(
        *[C.non_zero(optional(df, p, "double")) for p in ("processing_time", "processing_times.total", "properties.total_time_seconds")]
    )
    base = F.element_at(F.split(F.coalesce(F.col("id"), F.lit("")), "/"), -1)
    evaluation = [optional(df, p, "variant") for p in (
        "evaluation_results", "evaluation", "extracted_data.gpt_extraction_output_with_evaluation")]
    return df.select(
        "id",
        C.first_truthy(s("file_name"), s("filename"), base).alias("filename"),
        F.coalesce(s("dataset"), F.lit(C.DEFAULT_DATASET)).alias("dataset"),
        status4(df).alias("status"),
        created.alias("created_at"),
        updated.alias("updated_at"),
        duration.alias("processing_time"),
        C.first_truthy(s("model"), s("model_input.model_deployment")).alias("model"),
        C.first_truthy(s("ocr_response"), s("ocr_text"), s("extracted_data.ocr_output")).alias("ocr_text"),
        F.to_json(optional(df, "extracted_data.gpt_extraction_output", "variant")).alias("gpt_extraction"),
        F.to_json(F.coalesce(*evaluation)).alias("evaluation"),
        C.first_truthy(s("summary"), s("extracted_data.gpt_summary_output")).alias("summary"),
        optional(df, "errors", "array<string>").alias("errors"),
        F.coalesce(
            C.non_zero(optional(df, "num_pages", "int")), optional(df, "properties.num_pages", "int")
        ).alias("num_pages"),
        *[optional(df, c).alias(c) for c in ("properties", "state", "extracted_data")],
    )


def init_document(blobs: DataFrame) -> DataFrame:
    """New records for blobs already joined with their dataset's configuration.

    Needs ``blob_name, blob_size, num_pages, request_timestamp`` and the configuration
    columns of ``with_config``; the file counts as landed.
    """
    f = F.lit(False)
    state = F.struct(
        F.lit(True).alias("file_landed"),
        *[f.alias(s) for s in STEP_FLAGS[1:]],
        *[F.lit(None).cast("boolean").alias(s) for s in SKIP_FLAGS],
        *[F.lit(None).cast("double").alias(f"{s}_time_seconds") for s in TIMED_STEPS],
        *[F.lit(None).cast("boolean").alias(s) for s in ("finished", "error")],
    )
    empty = F.try_parse_json(F.lit("{}"))
    dataset = C.dataset_of(F.col("blob_name"))
    return blobs.select(
        C.document_id(F.col("blob_name")).alias("id"),
        dataset.alias("dataset"),
        F.struct(
            "blob_name", "blob_size", "request_timestamp", "num_pages", dataset.alias("dataset"),
            F.lit(None).cast("double").alias("total_time_seconds"),
            F.lit(None).cast("string").alias("ocr_provider_used"),
        ).alias("properties"),
        state.alias("state"),
        F.struct(
            F.lit("").alias("ocr_output"), empty.alias("gpt_extraction_output"),
            empty.alias("gpt_extraction_output_with_evaluation"), F.lit("").alias("gpt_summary_output"),
            F.lit("").alias("classification"),
        ).alias("extracted_data"),
        F.struct(
            optional(blobs, "model_deployment").alias("model_deployment"), "model_prompt",
            F.coalesce(F.try_parse_json(optional(blobs, "example_schema")), empty).alias("example_schema"),
            "max_pages_per_chunk",
        ).alias("model_input"),
        F.struct(*[
            F.coalesce(optional(blobs, f"processing_options.{o}", "boolean"), F.lit(True)).alias(o)
            for o in OPTION_FLAGS
        ]).alias("processing_options"),
        F.array().cast("array<string>").alias("errors"),
        f.alias("human_corrected"),
        F.lit(None).cast("timestamp_ntz").alias("last_correction_timestamp"),
    )


def reset_for_reprocess(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The selected records, reset to landed only and without errors, ready to upsert."""
    chosen = df.join(ids.select("id"), "id", "left_semi")
    cleared = {s: F.lit(s == "file_landed") for s in STEP_FLAGS} | {s: F.lit(False) for s in ("finished", "error")}
    fields = [
        cleared.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema["state"].dataType.fields
    ]
    return chosen.withColumn("state", F.struct(*fields)).withColumn("errors", F.array().cast("array<string>"))


def _present(c: Column) -> Column:
    """Neither null, '' nor an empty container."""
    return F.coalesce(~c.isin("", "{}", "[]", "null"), F.lit(False))


def _flags(df: DataFrame) -> list[Column]:
    out = optional(df, "extracted_data.gpt_extraction_output", "variant")
    enriched = optional(df, "extracted_data.gpt_extraction_output_with_evaluation", "variant")
    return [_present(F.to_json(out)).alias("has_extraction"), _present(F.to_json(enriched)).alias("has_evaluation")]


def presence_flags(df: DataFrame) -> DataFrame:
    return df.select("id", *_flags(df))


def config_presence(configs: DataFrame) -> DataFrame:
    """Which parts a dataset configuration has, under either of their two names."""
    either = lambda *names: _present(C.first_truthy(*[optional(configs, n) for n in names]))
    return configs.select(
        "dataset",
        either("system_prompt", "model_prompt").alias("has_system_prompt"),
        either("output_schema", "example_schema").alias("has_output_schema"),
        either("ground_truth").alias("has_ground_truth"),
    )


def stage_durations(df: DataFrame) -> DataFrame:
    """Rows (id, metric, value) of the detail report; missing values read as 0."""
    p, s = "properties.", "state."
    metrics = {
        "blob_size": p + "blob_size", "num_pages": p + "num_pages", "total_time_seconds": p + "total_time_seconds",
        **{f"{x}_time_seconds": f"{s}{x}_time_seconds" for x in TIMED_STEPS},
    }
    wide = df.select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(m) for m, c in metrics.items()])
    return wide.unpivot("id", list(metrics), "metric", "value")


def format_report(rows: DataFrame, name_length: int = 20) -> DataFrame:
    return rows.select(
        "id",
        C.truncate(F.col("file_name"), name_length).alias("name"),
        C.format_duration(F.col("total_time_seconds")).alias("duration"),
        C.format_bytes(F.col("blob_size")).alias("size"),
        C.format_date(F.col("request_timestamp")).alias("requested"),
    )


def strip_system_fields(df: DataFrame) -> DataFrame:
    """Drop fields starting with '_' and those the store adds."""
    return df.drop(*[c for c in df.columns if c.startswith("_") or c in STORE_FIELDS[1:]])
