"""Page chunks: planning, budgets, and putting per-chunk results back together."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from paperloom.functions.columns import python_float_sql
from paperloom.functions.json_text import fragment_sql, kind_sql
from paperloom.operators.jsontree import LIST, OBJECT, assemble_json, is_container, opened_sql, pointer_key, quoted
from paperloom.operators.predicates import chunk_size_guard

MAX_IMAGES = 10
MAX_IMAGE_BYTES = 20 * 1024 * 1024


def base64_length(n_bytes: Column) -> Column:
    return F.lit(4) * F.ceil(n_bytes / F.lit(3.0))


def attachment_budget(
    images: DataFrame, keys: Sequence[str], order: Sequence[str],
    max_n: int = MAX_IMAGES, max_bytes: int = MAX_IMAGE_BYTES,
) -> DataFrame:
    """The longest prefix of a chunk's first ``max_n`` images that fits the encoded size.

    The rank filter runs before the shuffle, so a chunk of any size moves at most
    ``max_n`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    first = images.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_n)
    used = F.sum(base64_length(F.col("n_bytes"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used_bytes", used).filter(F.col("used_bytes") <= max_bytes).drop("__rn")


def plan_chunks(docs: DataFrame) -> DataFrame:
    """Page ranges per document, 0-based and inclusive; one chunk when it fits or pages are unknown."""
    size, pages = F.col("__size"), F.col("num_pages")
    split = F.coalesce(pages > size, F.lit(False))
    starts = F.when(split, F.sequence(F.lit(0), pages - 1, size)).otherwise(F.array(F.lit(0)))
    end = F.when(split, F.least(F.col("start_page") + size, pages) - 1).otherwise(pages - 1)
    return (
        docs.withColumn("__size", chunk_size_guard(F.col("max_pages_per_chunk"))["size"])
        .select("*", F.posexplode(starts).alias("chunk_idx", "start_page"))
        .withColumn("end_page", end)
        .withColumn("n_chunks", F.when(split, F.ceil(pages / size)).otherwise(F.lit(1)).cast("int"))
        .drop("__size")
    )


def stage_time_totals(chunks: DataFrame, stages: Sequence[str] = ("ocr", "extraction", "evaluation")) -> DataFrame:
    """Seconds per stage and in all for each document; a stage that did not run counts 0."""
    sums = [F.coalesce(F.sum(f"{s}_seconds"), F.lit(0.0)).alias(f"{s}_seconds") for s in stages]
    total = F.lit(0.0)
    for s in stages:
        total = total + F.col(f"{s}_seconds")
    return chunks.groupBy("id").agg(*sums).withColumn("total_seconds", total)


def concat_chunks(chunks: DataFrame, text: str = "chunk_text", sep: str = "\\n", out: str = "ocr_output") -> DataFrame:
    """Chunk texts joined in chunk order."""
    return chunks.groupBy("id").agg(
        F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY chunk_idx)").alias(out)
    )


def provider_text(response: Column) -> Column:
    """Text of a provider's reply: page texts joined by blank lines, else content, text or first choice."""
    pages = F.try_variant_get(response, "$.pages", "array<variant>")
    marked = F.array_compact(F.transform(pages, lambda p: F.try_variant_get(p, "$.markdown", "string")))
    return F.coalesce(
        F.array_join(marked, "\n\n"),
        F.try_variant_get(response, "$.content", "string"),
        F.try_variant_get(response, "$.text", "string"),
        F.try_variant_get(response, "$.choices[0].message.content", "string"),
        F.lit(""),
    )


def range_key(chunk_size: Column | int) -> Column:
    """``pages_a-b``, 1-based, from the chunk's own range, else from its index and the chunk size."""
    size = F.lit(chunk_size) if isinstance(chunk_size, int) else chunk_size
    first = F.coalesce(F.col("start_page") + 1, F.col("chunk_idx") * size + 1)
    last = F.coalesce(F.col("end_page") + 1, (F.col("chunk_idx") + 1) * size)
    return F.concat(F.lit("pages_"), first.cast("bigint"), F.lit("-"), last.cast("bigint"))


def range_map(data: Column, key: Column, single_key: bool = False) -> Column:
    """Aggregate: JSON object of page range to chunk data; one chunk alone is its bare data.

    With ``single_key`` a lone chunk goes under ``pages_1-all``.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", key.alias("k"), data.alias("v"))))
    fields = F.transform(parts, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["v"]))
    alone = F.get(parts, F.lit(0))["v"]
    if single_key:
        alone = F.concat(F.lit('{"pages_1-all":'), alone, F.lit("}"))
    return F.when(F.size(parts) > 1, F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))).otherwise(alone)


def page_range_map(chunks: DataFrame, chunk_size: Column | int = 10, single_key: bool = False) -> DataFrame:
    """One JSON text per document from ``id, chunk_idx, start_page, end_page, data``."""
    return chunks.groupBy("id").agg(range_map(F.col("data"), range_key(chunk_size), single_key).alias("extraction"))


def _last_run(parts: Column) -> Column:
    """Where the fold over a field's occurrences last started afresh: struct(kind, at).

    An occurrence of the same mergeable kind joins the running value; another kind replaces
    it if it is truthy and is skipped if not.
    """
    first = F.get(parts, F.lit(0))
    start = F.struct(first["kind"].alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(acc, p):
        joins = (p["kind"] == acc["kind"]) & (p["kind"] != "null")
        fresh = ~joins & p["truthy"]
        return F.struct(
            F.when(fresh, p["kind"]).otherwise(acc["kind"]).alias("kind"),
            F.when(fresh, acc["i"]).otherwise(acc["at"]).alias("at"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(parts, start, step)


# One occurrence of a field. Booleans count as numbers.
_PART = f"""named_struct(
  'chunk_idx', chunk_idx,
  'kind', replace({kind_sql('__t')}, 'boolean', 'number'),
  'truthy', coalesce(CASE
    WHEN __t = 'STRING' THEN try_variant_get(node, '$', 'string') <> ''
    WHEN __t = 'BOOLEAN' THEN try_variant_get(node, '$', 'boolean')
    WHEN {is_container('__t')} THEN to_json(node) NOT IN ('{{}}', '[]')
    ELSE try_variant_get(node, '$', 'double') <> 0 END, FALSE),
  'json', coalesce(json, {fragment_sql('node', '__t')}),
  'fields', {opened_sql('node', OBJECT)},
  'num', coalesce(try_variant_get(node, '$', 'double'), CAST(try_variant_get(node, '$', 'boolean') AS DOUBLE)),
  'exact', coalesce(try_variant_get(node, '$', 'decimal(38,0)'), CAST(CAST(try_variant_get(node, '$', 'boolean') AS INT) AS DECIMAL(38, 0))),
  'whole', __t IN ('BIGINT', 'BOOLEAN'),
  'text', CASE WHEN __t = 'STRING' THEN try_variant_get(node, '$', 'string') END,
  'items', transform({opened_sql('node', LIST)}, x -> {fragment_sql('x', 'schema_of_variant(x)')}))"""

_SUM = f"""CASE WHEN forall(parts, p -> p.whole)
  THEN CAST(aggregate(parts, CAST(0 AS DECIMAL(38, 0)), (s, p) -> CAST(s + p.exact AS DECIMAL(38, 0))) AS STRING)
  ELSE {python_float_sql('aggregate(parts, CAST(0 AS DOUBLE), (s, p) -> s + p.num)')} END"""


# Levels of a merged record that are merged by built-in expressions, each grouping a field's occurrences.
MERGE_LEVELS = 5


def merged_value(values: list) -> object:
    """Fold of a field's values in chunk order, for whatever lies below the levels of the plan; the rule of ``merge_chunks``."""
    whole, *rest = values
    for new in rest:
        numbers = isinstance(whole, (int, float)) and isinstance(new, (int, float))
        if numbers or isinstance(whole, list) and isinstance(new, list):
            whole = whole + new
        elif isinstance(whole, str) and isinstance(new, str):
            whole = " ".join(f"{whole} {new}".split())
        elif isinstance(whole, dict) and isinstance(new, dict):
            both = [k for k in new if k in whole]
            whole = whole | new | {k: merged_value([whole[k], new[k]]) for k in both}
        else:
            whole = new or whole
    return whole


@F.pandas_udf(T.StringType())
def merged_json(parts: pd.Series) -> pd.Series:
    """JSON text of the merged values of each list of JSON texts; null for null."""
    def merge(texts):
        if texts is None:
            return None
        return json.dumps(merged_value([json.loads(t) for t in texts]), ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    return parts.map(merge)


def merge_chunks(chunks: DataFrame, keys: Sequence[str] = ("id",), levels: int = MERGE_LEVELS) -> DataFrame:
    """Deep merge of each document's chunk results in chunk order: (keys, json).

    ``chunks`` has ``chunk_idx`` and ``data`` (JSON text or VARIANT). Lists concatenate,
    texts join with single blanks, numbers add, objects merge field by field; otherwise a
    newer truthy value wins. Each of ``levels`` levels groups a field's occurrences by (document, path); objects that still
    occur several times below them are merged in one pass each, whatever their depth.
    The merged record is one row, so rows are placed by document once and no level shuffles again.
    """
    keys = list(keys)
    kept = quoted(keys)
    data = F.col("data")
    if dict(chunks.dtypes)["data"] != "variant":
        data = F.try_parse_json(data)
    rows = chunks.repartition(*keys).select(
        *keys, F.lit("").alias("pointer"), F.lit(False).alias("done"), F.col("chunk_idx").cast("int").alias("chunk_idx"),
        data.alias("node"), F.lit(None).cast("string").alias("json"),
    ).filter(F.col("node").isNotNull())
    for depth in range(levels + 1):
        rows = rows.selectExpr(*kept, "pointer", "done", "chunk_idx", "node", "json", "schema_of_variant(node) AS __t")
        part = F.expr(_PART).alias("part")
        in_order = F.array_sort(F.collect_list(part), lambda p, q: p["chunk_idx"] - q["chunk_idx"])
        grouped = rows.groupBy(*keys, "pointer", "done").agg(in_order.alias("parts"))
        run = grouped.withColumn("run", _last_run(F.col("parts")))
        tail = F.slice(F.col("parts"), F.col("run.at") + 1, F.size("parts"))
        used = F.when(F.col("done"), F.col("parts")).otherwise(F.filter(tail, lambda p: p["kind"] == F.col("run.kind")))
        run = run.select(*keys, "pointer", "done", used.alias("parts"), F.col("run.kind").alias("kind"))
        alone = F.col("done") | (F.size("parts") == 1) | (F.col("kind") == "null")
        blank = F.forall("parts", lambda p: p["json"] == "{}")
        joined = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), r"(?U)\s+", " "))
        lists = F.array_join(F.flatten(F.transform("parts", lambda p: p["items"])), ",")
        value = (
            F.when(alone | ((F.col("kind") == "object") & blank), F.get("parts", F.lit(0))["json"])
            .when(F.col("kind") == "list", F.concat(F.lit("["), lists, F.lit("]")))
            .when(F.col("kind") == "string", F.to_json(joined.cast("variant")))
            .when(F.col("kind") == "number", F.expr(_SUM))
        )
        resolved = run.select(*keys, "pointer", "parts", value.alias("value"))
        if depth == levels:
            texts = F.when(F.col("value").isNull(), F.transform("parts", lambda p: p["json"]))
            nodes = resolved.select(*keys, "pointer", F.coalesce("value", merged_json(texts)).alias("json"))
            break

        def child(p, e):
            return F.struct(
                F.concat("pointer", F.lit("/"), pointer_key(e["key"])).alias("pointer"), F.lit(False).alias("done"),
                p["chunk_idx"].alias("chunk_idx"), e["value"].alias("node"), F.lit(None).cast("string").alias("json"),
            )

        fields = F.flatten(F.transform("parts", lambda p: F.transform(
            F.map_entries(p["fields"]), lambda e: child(p, e)
        )))
        itself = F.array(F.struct(
            "pointer", F.lit(True).alias("done"), F.lit(0).alias("chunk_idx"),
            F.lit(None).cast("variant").alias("node"), F.col("value").alias("json"),
        ))
        opened = F.when(F.col("value").isNotNull(), itself).otherwise(fields)
        rows = resolved.select(*keys, F.explode(opened).alias("n")).select(*keys, "n.*")
    return assemble_json(nodes, keys)
