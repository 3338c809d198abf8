"""Model stages as work rows: planning, prompts, batch inference, and assembling records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom.functions.columns import is_true, non_empty
from paperloom.operators.chunks import range_key
from paperloom.sources.journal import Journal

STAGES = ["ocr", "extraction", "evaluation", "summary"]


def option(df: DataFrame, name: str) -> Column:
    """A processing option; one that is not set is on."""
    return F.coalesce(F.col(name), F.lit(True)) if name in df.columns else F.lit(True)


def plan_work(chunks: DataFrame) -> DataFrame:
    """Work rows (id, chunk_idx, stage) from planned chunks and their options.

    Text is read only if included; evaluation and summary are optional, the latter once per
    document. A document with neither text nor images gets one row with ``reason`` set.
    """
    ocr, images = option(chunks, "include_ocr"), option(chunks, "include_images")
    usable = ocr | images
    stages = F.array_compact(F.array(
        F.when(ocr, F.lit("ocr")),
        F.lit("extraction"),
        F.when(option(chunks, "enable_evaluation"), F.lit("evaluation")),
        F.when(option(chunks, "enable_summary") & (F.col("chunk_idx") == 0), F.lit("summary")),
    ))
    refused = F.when(F.col("chunk_idx") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return chunks.select(
        *chunks.columns,
        F.explode(F.when(usable, stages).otherwise(refused)).alias("stage"),
        F.when(~usable, F.lit("neither text nor images included")).alias("reason"),
    )


def skipped_flags(docs: DataFrame) -> DataFrame:
    return docs.select(
        "id",
        (~option(docs, "include_ocr")).alias("ocr_skipped"),
        (~option(docs, "enable_evaluation")).alias("gpt_evaluation_skipped"),
        (~option(docs, "enable_summary")).alias("gpt_summary_skipped"),
    )


def build_prompts(work: DataFrame) -> DataFrame:
    """Message texts per work row: instruction by modality, template, and the document's text.

    Needs ``stage, chunk_text, n_images, model_prompt, example_schema`` and, for evaluation,
    ``extraction``. A row without any input gets ``reason`` instead.
    """
    text = non_empty(F.regexp_replace("chunk_text", r"^\s+|\s+$", "")).isNotNull()
    images = F.coalesce(F.col("n_images") > 0, F.lit(False))
    modality = (
        F.when(text & images, F.lit("text+images")).when(text, F.lit("text")).when(images, F.lit("images"))
    )
    guide = (
        F.when(modality == "text+images", F.lit("Use the text for exact wording and the images for layout."))
        .when(modality == "text", F.lit("Use the text."))
        .otherwise(F.lit("Read everything from the images."))
    )
    extraction = F.concat_ws(
        "\n\n", F.lit("Extract the document's data as one JSON object."), guide, F.col("model_prompt"),
        F.concat(F.lit("Template:\n"), F.col("example_schema")),
    )
    evaluation = F.concat_ws(
        "\n\n", F.lit("Give each extracted field a confidence from 0 to 1."),
        F.concat(F.lit("Template:\n"), F.col("example_schema")), F.concat(F.lit("Data:\n"), F.col("extraction")),
    )
    stage = F.col("stage")
    system = (
        F.when(stage == "extraction", F.when(modality.isNotNull(), extraction))
        .when(stage == "evaluation", evaluation)
        .when(stage == "summary", F.lit("Summarise the document."))
    )
    content = F.when(stage.isin("extraction", "summary") & text, F.concat(F.lit("Document:\n"), F.col("chunk_text")))
    reason = F.when((stage == "extraction") & modality.isNull(), F.lit("no input provided"))
    return work.withColumns({"modality": modality, "system_text": system, "user_text": content, "reason": reason})


_PROVIDERS: dict[str, Callable[[str], str]] = {}


def register_provider(name: str, fn: Callable[[str], str]) -> None:
    """Name a stage function, so jobs can choose it by setting."""
    _PROVIDERS[name.lower()] = fn


def provider(name: str) -> Callable[[str], str]:
    try:
        return _PROVIDERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(_PROVIDERS)}") from None


_ANSWER = T.StructType([
    T.StructField("output", T.StringType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType()),
])


def answer(fn: Callable[[str], str], value: str) -> tuple[str | None, str | None, float]:
    """``(output, error, seconds)`` of one call."""
    began = time.perf_counter()
    try:
        return fn(value), None, time.perf_counter() - began
    except Exception as e:  # noqa: BLE001 - any failure of the user's function is data
        return None, f"{type(e).__name__}: {e}", time.perf_counter() - began


def run_stage(
    work: DataFrame, fn: Callable[[str], str], parallel: int, payload: str = "payload", journal: Journal | None = None,
    key: Sequence[str] = ("id", "chunk_idx", "stage"),
) -> DataFrame:
    """Call ``fn`` on each row's payload; add ``output, error, seconds``.

    ``parallel`` tasks make one call at a time each. A failing call becomes a row with its
    error, never a failed task, since retrying a task would repeat calls already paid for. With a ``journal`` no call is
    paid for twice: an answer is stored as it comes, under its ``key`` columns and payload, and whatever is stored is
    taken from there, by a second action, a retried task or a later run.
    """
    schema = T.StructType([*work.schema.fields, *_ANSWER.fields])
    if journal is None:
        rows, calls = work.repartition(parallel), None
    else:
        calls = "__call"
        named = work.withColumn(calls, journal.call([c for c in key if c in work.columns], payload))
        known = journal.answers()
        stored = named.join(known, calls).select(*work.columns, *_ANSWER.fieldNames())
        asked = named.join(known.select(calls), calls, "left_anti")
        rows = asked.repartitionById(parallel, journal.task(calls, parallel)).sortWithinPartitions(calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger = journal.opened() if journal is not None else None
        try:
            for batch in batches:
                if ledger is None:
                    results = [answer(fn, value) for value in batch[payload]]
                else:
                    results = [ledger.once(call, lambda: answer(fn, value)) for call, value in zip(batch[calls], batch[payload])]
                columns = dict(zip(_ANSWER.fieldNames(), map(list, zip(*results)))) if results else {c: [] for c in _ANSWER.fieldNames()}
                yield batch.drop(columns=calls or []).assign(**columns)
        finally:
            if ledger is not None:
                ledger.close()

    done = rows.mapInPandas(run, schema)
    return done if journal is None else stored.unionByName(done)


def assemble_documents(results: DataFrame, chunk_size: Column | int = 10) -> DataFrame:
    """Final record of each document from its stage results, in one grouping.

    ``results`` has ``id, chunk_idx, start_page, end_page, n_chunks, stage, output, error,
    seconds``. Steps that were not reached, or failed in a chunk, read false.
    """
    stage, ok = F.col("stage"), F.col("error").isNull() & F.col("output").isNotNull()

    def outputs(name):
        return F.when((stage == name) & ok, F.col("output"))

    def done(name):
        planned = F.count_if(stage == name)
        return ((planned > 0) & (F.count_if((stage == name) & ok) == planned)).alias(f"{name}_done")

    key = range_key(chunk_size)

    def ranges(name, out):
        parts = F.collect_list(F.when((stage == name) & ok, F.struct("chunk_idx", key.alias("k"), F.col("output").alias("v"))))
        return F.array_sort(parts).alias(out)

    def as_object(parts):
        fields = F.transform(parts, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["v"]))
        several = F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))
        return F.when(F.size(parts) == 0, F.lit("{}")).when(F.col("n_chunks") == 1, F.get(parts, F.lit(0))["v"]).otherwise(several)

    failures = F.when(F.col("error").isNotNull(), F.concat(stage, F.lit(" error: "), F.col("error")))
    work = results.withColumn("__ocr", outputs("ocr")).withColumn("__sum", outputs("summary"))
    grouped = work.groupBy("id").agg(
        F.max("n_chunks").alias("n_chunks"),
        F.expr("listagg(__ocr, '\n') WITHIN GROUP (ORDER BY chunk_idx)").alias("ocr_output"),
        F.max("__sum").alias("summary"),
        ranges("extraction", "__x"), ranges("evaluation", "__e"),
        *[F.coalesce(F.sum(F.when(stage == s, F.col("seconds"))), F.lit(0.0)).alias(f"{s}_seconds") for s in STAGES],
        *[done(s) for s in STAGES],
        F.array_sort(F.collect_list(failures)).alias("errors"),
        F.count_if(F.col("error").isNotNull()).alias("__failed"),
        F.count_if(stage == "extraction").alias("__planned_x"),
    )
    complete = (F.col("__failed") == 0) & F.col("extraction_done") & (F.col("__planned_x") == F.col("n_chunks"))
    return grouped.select(
        "id", "n_chunks", F.coalesce("ocr_output", F.lit("")).alias("ocr_output"),
        as_object(F.col("__x")).alias("extraction"), as_object(F.col("__e")).alias("evaluation"),
        F.coalesce("summary", F.lit("")).alias("summary"), *[f"{s}_seconds" for s in STAGES],
        F.col("ocr_done").alias("ocr_completed"), F.col("extraction_done").alias("gpt_extraction_completed"),
        F.col("evaluation_done").alias("gpt_evaluation_completed"), F.col("summary_done").alias("gpt_summary_completed"),
        is_true(complete).alias("processing_completed"), "errors",
    )
