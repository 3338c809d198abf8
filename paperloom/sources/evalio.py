"""Evaluation inputs and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paperloom.functions.json_text import is_strict_json
from paperloom.operators.ordering import run_numbers

_RUN = T.StructType([T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])


def eval_lines(gt: DataFrame, actual: DataFrame, schema: DataFrame, key: str = "item") -> DataFrame:
    """One JSON line per item from (key, data) tables of ground truth, actual and eval schema.

    The texts are joined as they are, so numbers keep their spelling (5.0 stays 5.0); line
    breaks, which can only stand between JSON tokens, become blanks. A side that is missing
    or not JSON is null.
    """
    def side(df, name):
        text = F.when(is_strict_json(F.col("data")), F.regexp_replace("data", r"[\r\n]+", " "))
        return df.select(key, F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null"))).alias(name))

    names = ("ground_truth", "actual", "eval_schema")
    a, b, c = (side(df, name) for df, name in zip((gt, actual, schema), names))
    parts = [F.coalesce(name, F.lit(f'"{name}":null')) for name in names]
    named_key = F.regexp_replace(F.to_json(F.struct(key)), r"\}$", "")
    line = F.concat(named_key, F.lit(","), F.concat_ws(",", *parts), F.lit("}"))
    return a.join(b, key, "left").join(c, key, "left").select(line.alias("value"))


def write_eval_jsonl(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows with VARIANT columns ``ground_truth``, ``actual``, ``eval_schema`` and the whole ``record``."""
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("record"))
    part = lambda name: F.try_variant_get("record", f"$.{name}", "variant").alias(name)
    return parsed.select("record", part("ground_truth"), part("actual"), part("eval_schema"))


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, error) for every line that ``read_eval_jsonl`` finds no record in: not JSON, or not an object."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    record = F.try_parse_json("line")
    error = F.when(record.isNull(), F.lit("not JSON")).when(~F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), F.lit("not an object"))
    return lines.withColumn("error", error).filter(F.col("error").isNotNull())


def read_eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of every run file: (file, metric, value, run_number), runs numbered by file name.

    A file must be exactly one JSON value; anything else fails the job with the file's name.
    """
    name = F.col("_metadata.file_name")
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(name.alias("file"), "value")
    broken = F.raise_error(F.concat(F.lit("not one JSON value: "), F.col("file"))).cast("string")
    record = F.from_json(F.when(is_strict_json(F.col("value")), F.col("value")).otherwise(broken), _RUN)
    return run_numbers(texts.select("file", F.explode(record["metrics"]).alias("metric", "value")))
