"""Dataset configurations: from folders, from a stored item, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.functions.json_text import object_entries
from paperloom.operators.predicates import validate_dataset_config
from paperloom.operators.projections import STORE_FIELDS
from paperloom.sources.documents import upsert

DEFAULT_PROMPT = "Default model prompt."
PROMPT_FILE, SCHEMA_FILE = "system_prompt.txt", "output_schema.json"


def read_dataset_configs(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset folder: prompt, template and 10 pages per chunk."""
    files = (
        spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
        .withColumn("__path", F.split(F.col("_metadata.file_path"), "/"))
        .select(F.element_at("__path", -2).alias("dataset"), F.element_at("__path", -1).alias("__file"), "value")
    )

    def content(name):
        return F.max(F.when(F.col("__file") == name, F.regexp_replace("value", r"^\s+|\s+$", "")))

    return files.groupBy("dataset").agg(
        F.coalesce(content(PROMPT_FILE), F.lit(DEFAULT_PROMPT)).alias("model_prompt"),
        F.coalesce(content(SCHEMA_FILE), F.lit("{}")).alias("example_schema"),
        F.lit(10).alias("max_pages_per_chunk"),
    )


def configs_from_item(items: DataFrame, column: str = "item") -> DataFrame:
    """Rows from stored configuration items, with datasets under ``datasets`` or, in old items, at the top."""
    top = object_entries(F.try_parse_json(F.col(column)))
    nested = object_entries(F.try_element_at(top, F.lit("datasets")))
    plain = F.map_filter(top, lambda k, _: ~k.isin(*STORE_FIELDS))
    field = lambda path, kind="string": F.try_variant_get("cfg", path, kind)
    return (
        items.select(F.explode(F.coalesce(nested, plain)).alias("dataset", "cfg"))
        .select(
            "dataset",
            F.coalesce(field("$.model_prompt"), field("$.system_prompt")).alias("model_prompt"),
            F.coalesce(F.to_json(field("$.example_schema", "variant")), F.to_json(field("$.output_schema", "variant"))).alias("example_schema"),
            F.coalesce(field("$.max_pages_per_chunk", "int"), F.lit(10)).alias("max_pages_per_chunk"),
        )
    )


def upsert_dataset_configs(configs: DataFrame, updates: DataFrame) -> DataFrame:
    """Configurations after saving ``updates``, which carry a ``version``; a whole row is replaced."""
    return upsert(configs, updates, "dataset")


def create_dataset_configs(configs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configurations with the valid new ones added, and a report row per request.

    The report has the reason of a refusal, or the prompt's length and the template's fields.
    """
    checked = validate_dataset_config(new, configs)
    valid = checked.filter(F.col("reason").isNull())
    trimmed = valid.withColumn("model_prompt", F.regexp_replace("model_prompt", r"^\s+|\s+$", ""))
    for name in configs.columns:
        if name not in trimmed.columns:
            default = F.lit(10) if name == "max_pages_per_chunk" else F.lit(None)
            trimmed = trimmed.withColumn(name, default.cast(configs.schema[name].dataType))
    fields = F.array_join(F.array_sort(F.map_keys(object_entries(F.try_parse_json("example_schema")))), ",")
    extra = [c for c in new.columns if c not in ("dataset", "model_prompt", "example_schema")]
    report = checked.select(
        "dataset", *extra, "reason", F.when(F.col("reason").isNull(), F.length("model_prompt")).alias("prompt_length"),
        F.when(F.col("reason").isNull(), fields).alias("schema_fields"),
    )
    return configs.unionByName(trimmed.select(configs.columns)), report


def refresh_dataset_configs(spark: SparkSession, root: str, table_path: str) -> DataFrame:
    """Replace the stored configurations by those of the folders."""
    read_dataset_configs(spark, root).write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path)
