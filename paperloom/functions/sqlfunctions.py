"""The scorers and the leaf walk as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperloom.functions import scoring
from paperloom.functions.json_text import fragment_sql
from paperloom.operators.jsontree import leaf_walk_sql


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``match_score(gt, actual, options)``, ``fuzzy_score(gt, actual)``, ``window_percent(a, b)``, ``json_leaf_rows(text)`` and
    ``json_leaf_list(text)`` callable from SQL. ``options`` is a JSON object; the scores are those of ``scoring``.

    ``json_leaf_rows`` is a table function over built-in expressions: rows (path, json) of one JSON text, none
    for a text that is not JSON. ``json_leaf_list`` gives the same as one array: for large texts, explode it, since a lateral
    join carries the text along with each row. For DataFrames ``json_leaves`` and ``fuzzy_score`` do the same.
    """
    leaf = fragment_sql("n.node", "schema_of_variant(n.node)")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION json_leaf_rows(doc STRING) RETURNS TABLE(path STRING, json STRING)
        RETURN SELECT coalesce(n.path, ''), {leaf} FROM (SELECT explode({leaf_walk_sql("doc")}) AS n)
        WHERE NOT (schema_of_variant(n.node) LIKE 'OBJECT%' OR schema_of_variant(n.node) LIKE 'ARRAY%')""")
    is_leaf = "NOT (schema_of_variant(n.node) LIKE 'OBJECT%' OR schema_of_variant(n.node) LIKE 'ARRAY%')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION json_leaf_list(doc STRING) RETURNS ARRAY<STRUCT<path: STRING, json: STRING>>
        RETURN transform(filter({leaf_walk_sql("doc")}, n -> {is_leaf}), n -> named_struct('path', coalesce(n.path, ''), 'json', {leaf}))""")
    spark.udf.register("window_percent", scoring.window_percent)
    options = "try_variant_get(try_parse_json(options), '$', 'map<string,variant>')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION match_score(gt STRING, actual STRING, options STRING DEFAULT '{{}}') RETURNS INT
        RETURN {scoring.match_score_sql("gt", "actual", options)}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION fuzzy_score(gt STRING, actual STRING) RETURNS DOUBLE
        RETURN {scoring.fuzzy_score_sql("gt", "actual")}""")
