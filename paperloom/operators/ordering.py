"""Order-dependent operators: histories, newest records, last turns, lists and lookups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from paperloom.functions import columns as C
from paperloom.functions import skew
from paperloom.functions.json_text import indented_json

SORT_FIELDS = {
    "fileName": "file_name", "dataset": "dataset", "status": "status",
    "totalTime": "total_time_seconds", "timestamp": "request_timestamp", "pages": "num_pages",
}
_NUMERIC = {"totalTime", "pages"}


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest record per key, by a map-side combined ``max_by``: no sort of a key's rows."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return newest.select("__r.*")


def number_corrections(corrections: DataFrame, bucket: Column | None = None) -> DataFrame:
    """1-based ``correction_number`` per document in time order.

    A document's rows are cut by hour, so one with a very long history spreads over tasks.
    """
    bucket = F.date_trunc("hour", F.col("ts")) if bucket is None else bucket
    return skew.row_numbers(corrections, ["document_id"], ["ts", "correction_id"], bucket, "correction_number")


def correction_chain(corrections: DataFrame, originals: DataFrame) -> DataFrame:
    """Add ``original_data``: the data each correction replaced.

    That is the previous correction's data, or for a document's first one the extraction
    held in ``originals(document_id, original)``.
    """
    bucket = F.date_trunc("hour", F.col("ts"))
    order = ["ts", "correction_id"]
    chained = skew.previous_value(corrections, ["document_id"], order, bucket, "corrected_data", "__prev")
    return (
        chained.join(originals.select("document_id", "original"), "document_id", "left")
        .withColumn("original_data", F.coalesce("__prev", "original"))
        .drop("__prev", "original")
    )


def correction_history(corrections: DataFrame) -> DataFrame:
    """All corrections, newest first within a document, with their number."""
    return number_corrections(corrections).orderBy("document_id", F.desc("correction_number"))


def last_k_turns(turns: DataFrame, k: int = 5, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Last k turns per conversation; the rank filter is applied before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("__back", rank).filter(F.col("__back") <= k).drop("__back")


def chat_context(docs: DataFrame, turns: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Prompt context per document: extracted data, or its text when there is none, and the last turns."""
    history = (
        last_k_turns(turns, k, key)
        .withColumn("__line", F.concat(F.upper("role"), F.lit(": "), F.col("text")))
        .groupBy(key)
        .agg(F.expr("listagg(__line, '\n') WITHIN GROUP (ORDER BY turn)").alias("history"))
    )
    data, text = C.non_empty(F.nullif(F.col("extraction"), F.lit("{}"))), C.non_empty(F.col("ocr_output"))
    context = F.when(
        data.isNotNull(), F.concat(F.lit("GPT EXTRACTED DATA:\n\n"), indented_json(data))
    ).when(text.isNotNull(), F.concat(F.lit("DOCUMENT TEXT (OCR):\n\n"), C.preview(text, 3000, "...")))
    reason = F.when(data.isNull() & text.isNull(), F.lit("no extracted data"))
    return docs.select(key, context.alias("context"), reason.alias("reason")).join(history, key, "left")


def list_latest(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, with a stable order among equal times."""
    return rows.orderBy(F.desc("request_timestamp"), "id").offset(offset).limit(limit)


def list_any(rows: DataFrame, limit: int = 50) -> DataFrame:
    return rows.orderBy("id").limit(limit)


def sort_docs(rows: DataFrame, field: str = "timestamp", direction: str = "desc", collation: str | None = None) -> DataFrame:
    """Sort by one of six fields; missing times and pages count as 0."""
    c = F.col(SORT_FIELDS[field])
    if field in _NUMERIC:
        c = F.coalesce(c, F.lit(0))
    elif field != "timestamp" and collation:
        c = F.collate(c, collation)
    return rows.orderBy(c.asc() if direction == "asc" else c.desc(), "id")


def slowest(rows: DataFrame, n: int = 20) -> DataFrame:
    """Longest processing times in whole seconds, names cut to 20 characters."""
    return (
        rows.filter(F.col("total_time_seconds") > 0)
        .select(
            "id",
            C.preview(F.col("file_name"), 20).alias("file_name"),
            F.floor(F.col("total_time_seconds") + 0.5).cast("bigint").alias("time"),
            "status",
        )
        .orderBy(F.desc("time"), "id")
        .limit(n)
    )


def get_documents(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Point lookup; the id test reaches the scan."""
    return df.filter(F.col("id").isin(*ids)) if len(ids) != 1 else df.filter(F.col("id") == ids[0])


def lookup_with_reason(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Bulk lookup of ``wanted(id)``: every id once, with ``reason`` set where nothing is stored."""
    found = docs.join(wanted.select("id"), "id", "left_semi").withColumn("__hit", F.lit(True))
    joined = wanted.select("id").distinct().join(found, "id", "left")
    return joined.withColumn("reason", F.when(F.col("__hit").isNull(), F.lit("document not found"))).drop("__hit")


def run_numbers(runs: DataFrame, file: str = "file") -> DataFrame:
    """Number runs by sorted file name.

    Distinct names are cut into buckets by the two characters after what the least and the greatest of them begin with alike,
    and numbered by running counts, so a long list of names is spread over tasks.
    """
    names = runs.select(file).filter(F.col(file).isNotNull()).distinct()
    ends = names.agg(F.min(file).alias("__a"), F.max(file).alias("__z"))
    parted = F.array_position(F.zip_with(F.split("__a", ""), F.split("__z", ""), lambda a, z: a.eqNullSafe(z)), False)
    placed = names.join(F.broadcast(ends)).select(file, F.left(F.col(file), (parted + 1).cast("int")).alias("__start"))  # one row
    numbered = skew.row_numbers(placed, [], [file], F.col("__start"), "run_number").drop("__start")
    return runs.join(numbered, file)


def first_with_total(df: DataFrame, order: str, k: int, total: str, fan: int = 64) -> DataFrame:
    """The first ``k`` rows by ``order``, nulls first, each with the number of all rows as ``total``; one pass over ``df``.

    A mergeable aggregate: a task keeps its first ``k`` rows and a count, ``fan`` tasks merge those, one task the rest. It sees
    rows that have been projected to what is returned, so nothing else leaves the JVM.
    """
    count = T.StructField("__count", T.LongType())
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), count])  # all may be null

    def merge(raw: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, best = 0, None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                if raw:
                    n += len(rows)
                else:
                    n += pc.sum(rows["__count"]).as_py() or 0
                    rows = rows.filter(pc.is_null(rows["__count"]))
                best = rows if best is None else pa.concat_tables([best, rows])
                best = best.take(pc.sort_indices(best, [(order, "ascending")], null_placement="at_start")[:k])
            if best is None:
                return
            best = best.drop_columns("__count") if "__count" in best.column_names else best
            fields = pa.schema([*(f.with_nullable(True) for f in best.schema), pa.field("__count", pa.int64())])
            counts = pa.array([n if last else None] * len(best), pa.int64())
            yield from pa.table([*best.columns, counts], schema=fields).combine_chunks().to_batches()
            if not last:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in best.schema), pa.array([n])], schema=fields)
        return run

    merged = df.mapInArrow(merge(True, False), schema).repartition(fan).mapInArrow(merge(False, False), schema)
    return merged.coalesce(1).mapInArrow(merge(False, True), schema).withColumnRenamed("__count", total)
