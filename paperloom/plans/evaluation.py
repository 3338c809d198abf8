"""Queries for JSON operators (J), scoring and evaluation (E, D-03..05, A-01..03)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperloom.functions import scoring as S
from paperloom.operators import evaluate as E
from paperloom.operators import jsontree as JT
from paperloom.operators import repair as R
from paperloom.plans import views as V
from paperloom.plans.aggregates import data_chunks
from paperloom.plans.registry import query
from paperloom.session import spread

NO_COMMAS = '{"IGNORE_COMMAS":true}'
NO_DOLLAR = '{"IGNORE_DOLLAR_SIGN":"x","IGNORE_NUMBER_SIGN":true}'


@query("J-01_json_leaves", views=("chunk_view",), sql="""
WITH c AS (SELECT id, chunk_idx AS i, ocr_seconds AS s FROM chunk_view)
SELECT id, i AS chunk_idx, 'n' AS path, 'number' AS type, CAST(i AS VARCHAR) AS value FROM c
UNION ALL SELECT id, i, 'tag', 'string', concat(' t', i, '  x') FROM c
UNION ALL SELECT id, i, 'list[0]', 'number', CAST(i AS VARCHAR) FROM c
UNION ALL SELECT id, i, 'list[1]', 'string', 'a' FROM c
UNION ALL SELECT id, i, 'sub.seconds', 'number', CAST(CAST(s AS DOUBLE) AS VARCHAR) FROM c
UNION ALL SELECT id, i, concat('sub.k', i % 2), 'boolean', 'true' FROM c
UNION ALL SELECT id, i, 'mix', CASE i % 3 WHEN 1 THEN 'string' WHEN 2 THEN 'number' ELSE 'null' END, CASE i % 3 WHEN 1 THEN 'text' WHEN 2 THEN '7' END FROM c""")
def json_leaves(spark, sf):
    texts = spread(data_chunks(spark, sf).select("id", "chunk_idx", "data"))
    tree = texts.select("id", "chunk_idx", F.try_parse_json("data").alias("v"))
    return JT.json_leaves(tree, "v", ["id", "chunk_idx"]).select("id", "chunk_idx", "path", "type", "value")


@query("J-02_leaves_to_json", views=("chunk_view",), sql="""
SELECT id, chunk_idx, concat('{"list":[', chunk_idx, ',"a"],"mix":', CASE chunk_idx % 3 WHEN 1 THEN '"text"' WHEN 2 THEN '7' ELSE 'null' END,
  ',"n":', chunk_idx, ',"sub":{"k', chunk_idx % 2, '":true,"seconds":', CAST(CAST(ocr_seconds AS DOUBLE) AS VARCHAR),
  '},"tag":" t', chunk_idx, '  x"}') AS json FROM chunk_view""")
def leaves_to_json(spark, sf):
    keys = ["id", "chunk_idx"]
    tree = data_chunks(spark, sf).select(*keys, F.try_parse_json("data").alias("v"))
    return JT.leaves_to_json(JT.json_leaves(tree, "v", keys), keys)


# What each way of damaging a response comes to; see response_view.
_FIXED_CLASS = """CASE event_id % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' WHEN 2 THEN 'likely_truncation' WHEN 3 THEN 'repaired'
  WHEN 4 THEN 'repaired' WHEN 5 THEN 'repaired' WHEN 6 THEN 'ok' ELSE 'json_parse_error' END"""


@query("J-03_repair_json", sql=f"""
SELECT event_id AS response_id, {_FIXED_CLASS} AS status, CASE event_id % 8 WHEN 1 THEN 'fence' WHEN 3 THEN 'object' WHEN 4 THEN 'object_syntax' WHEN 5 THEN 'object_syntax' END AS strategy,
  CASE WHEN event_id % 8 IN (2, 7) THEN NULL WHEN event_id % 8 = 6 THEN concat('[', replace(props, ' ', ''), ']') ELSE replace(props, ' ', '') END AS data,
  CASE WHEN event_id % 8 = 2 THEN 'unbalanced braces,ends abruptly' END AS indicators FROM events""")
def repair_json(spark, sf):
    out = R.repair_json(V.response_view(spark, sf))
    return out.select(
        "response_id", "status", "strategy", F.to_json("data").alias("data"),
        F.array_join("indicators", ",").alias("indicators"),
    )


@query("J-03_repair_json_strict", sql=f"""
SELECT event_id AS response_id, CASE WHEN event_id % 8 = 1 THEN 'likely_truncation' ELSE {_FIXED_CLASS} END AS status,
  event_id % 8 IN (1, 2, 7) AS extraction_failed FROM events""")
def repair_json_strict(spark, sf):
    return R.repair_json(V.response_view(spark, sf), mode="strict").select("response_id", "status", "extraction_failed")


@query("J-04_clean_response", sql="""
SELECT event_id AS response_id, CASE event_id % 8 WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 6 THEN props
  WHEN 7 THEN replace(props, ':', '') ELSE props END AS cleaned FROM events""")
def clean_response(spark, sf):
    return V.response_view(spark, sf).select("response_id", R.clean_response(F.col("content")).alias("cleaned"))


@query("J-05_classify_response", sql=f"""
SELECT event_id AS response_id, CASE WHEN event_id % 50 = 0 THEN 'api_error' WHEN event_id % 16 = 2 THEN 'token_limit_exceeded' ELSE {_FIXED_CLASS} END AS status,
  CASE WHEN event_id % 50 <> 0 AND event_id % 8 IN (1, 3, 4, 5) THEN 'cleaned' END AS strategy,
  CASE WHEN event_id % 50 = 0 OR event_id % 8 IN (2, 7) THEN NULL WHEN event_id % 8 = 6 THEN concat('[', replace(props, ' ', ''), ']') ELSE replace(props, ' ', '') END AS data
FROM events""")
def classify_response(spark, sf):
    failed = F.when(F.col("response_id") % 50 == 0, F.lit("timeout"))
    responses = V.response_view(spark, sf).withColumn("api_error", failed)
    return R.classify_response(responses).select("response_id", "status", "strategy", F.to_json("data").alias("data"))


@query("J-06_response_quality", sql=f"""
WITH c AS (SELECT event_type AS model, CASE WHEN event_id % 16 = 2 THEN 'token_limit_exceeded' ELSE {_FIXED_CLASS} END AS status,
  CASE WHEN event_id % 8 IN (1, 3, 4, 5) THEN 'cleaned' ELSE '' END AS strategy FROM events)
SELECT model, status, strategy, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS share FROM c GROUP BY 1, 2, 3""")
def response_quality(spark, sf):
    return R.response_quality(R.classify_response(V.response_view(spark, sf)))


@query("J-07_template_paths", sql="""
WITH t AS (SELECT p_partkey, p_partkey % 2 = 0 AS as_schema FROM part)
SELECT p_partkey, unnest(['title', 'items[*].name', 'items[*].qty', concat('size.s', p_partkey % 3)]) AS path FROM t""")
def template_paths(spark, sf):
    size = F.concat(F.lit("s"), F.col("p_partkey") % 3)
    example = F.concat(F.lit('{"title":"","items":[{"name":"","qty":0},{"name":"","qty":1}],"size":{"'), size, F.lit('":""}}'))
    schema = F.concat(
        F.lit('{"type":"object","properties":{"title":{"type":"string"},"items":{"type":"array","items":{"type":"object",'
              '"properties":{"name":{"type":"string"},"qty":{"type":"number"}}}},"size":{"type":"object","properties":{"'),
        size, F.lit('":{"type":"string","format":"date"}}}}}'),
    )
    text = F.when(F.col("p_partkey") % 2 == 0, schema).otherwise(example)
    templates = spread(V.table(spark, sf, "part").select("p_partkey")).select("p_partkey", F.try_parse_json(text).alias("v"))
    return JT.template_paths(templates, "v", ["p_partkey"])


@query("E-01_match_score", views=("gt_leaf",), sql="""
SELECT item, path, CASE WHEN actual IS NULL THEN 0 WHEN lower(replace(gt, ',', '')) = lower(replace(actual, ',', '')) THEN 1 ELSE 0 END AS commas,
  CASE WHEN actual IS NULL THEN 0 WHEN ltrim(lower(gt), '$') = ltrim(lower(actual), '$') THEN 1 ELSE 0 END AS dollar,
  CASE WHEN actual IS NULL THEN 0 WHEN lower(gt) = lower(actual) THEN 1 ELSE 0 END AS plain FROM gt_leaf""")
def match_score(spark, sf):
    def score(config):
        return S.match_score(F.col("gt"), F.col("actual"), json.loads(config))

    return V.gt_leaf(spark, sf).select(
        "item", "path", score(NO_COMMAS).alias("commas"), score(NO_DOLLAR).alias("dollar"), score("{}").alias("plain")
    )


@query("E-02_additional_matches", views=("gt_leaf",), sql="""
SELECT item, path, CASE WHEN actual IS NULL THEN 0 WHEN lower(gt) = lower(actual) OR lower(actual) IN ('$900.0', 'red, widget', 'small, ring') THEN 1 ELSE 0 END AS score FROM gt_leaf""")
def additional_matches(spark, sf):
    options = S.options_of(F.parse_json(F.lit('{"ADDITIONAL_MATCHES":["$900.0","red, widget","small, ring",7]}')))
    return V.gt_leaf(spark, sf).select("item", "path", S.match_score(F.col("gt"), F.col("actual"), options).alias("score"))


@query("E-03_option_truthiness", sql="""
SELECT p_partkey, p_partkey % 9 NOT IN (1, 3, 5, 6, 8) AS is_on FROM part""")
def option_truthiness(spark, sf):
    values = ['"False"', '""', "true", "false", "1", "0", "null", "[0]", "{}"]
    table = F.array(*[F.lit(v) for v in values])
    value = F.try_parse_json(F.get(table, (F.col("p_partkey") % len(values)).cast("int")))
    return V.table(spark, sf, "part").select("p_partkey", S.truthy(value).alias("is_on"))


@query("E-04_fuzzy_score", views=("gt_leaf",), sql="""
WITH n AS (SELECT item, path, actual, list_distinct(string_split_regex(trim(lower(regexp_replace(gt, '[^A-Za-z0-9_]', ' ', 'g'))), '\\s+')) AS a,
  list_distinct(string_split_regex(trim(lower(regexp_replace(coalesce(actual, ''), '[^A-Za-z0-9_]', ' ', 'g'))), '\\s+')) AS b FROM gt_leaf)
SELECT item, path, CASE WHEN actual IS NULL THEN 0e0 WHEN len(list_intersect(a, b)) > 0 THEN 1e0 END AS score FROM n""")
def fuzzy_score(spark, sf):
    return V.gt_leaf(spark, sf).select("item", "path", S.fuzzy_score(F.col("gt"), F.col("actual")).alias("score"))


@query("E-04_fuzzy_score_disjoint", sql="""
WITH pairs AS (SELECT DISTINCT p_name, p_type FROM part),
words AS (SELECT p_name, p_type, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS wa, lower(p_type) AS b FROM pairs),
texts AS (SELECT p_name, p_type, len(list_intersect(wa, [b])) > 0 AS shared, array_to_string(wa, ' ') AS a, b FROM words),
sides AS (SELECT p_name, p_type, shared, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM texts
  UNION ALL SELECT p_name, p_type, shared, b, a FROM texts WHERE length(a) = length(b)),
spans AS (SELECT *, unnest(list_concat(list_transform(range(0, length(l) - length(s) + 1), lambda i: substr(l, i + 1, length(s))),
  list_concat(list_transform(range(1, length(s)), lambda k: substr(l, 1, k)), list_transform(range(1, length(s)), lambda k: right(l, k))))) AS w FROM sides),
dp AS (SELECT p_name, p_type, shared, s, w, list_reduce(list_concat([list_transform(range(0, length(w) + 1), lambda j: 0)], list_transform(string_split(s, ''), lambda ch: [ascii(ch)])),
  lambda r, c: list_transform(range(0, length(w) + 1), lambda j: list_max(list_concat([r[j + 1]], list_transform(range(1, j + 1), lambda k: CASE WHEN ascii(substr(w, k, 1)) = c[1] THEN r[k] + 1 ELSE 0 END))))) AS row FROM spans),
best AS (SELECT p_name, p_type, bool_or(shared) AS shared, max(2.0 * list_max(row) / (length(s) + length(w))) AS r FROM dp GROUP BY 1, 2)
SELECT p.p_partkey, CASE WHEN b.shared THEN 1.0 ELSE round_even(CAST(100 * b.r AS DOUBLE), 0) / 100 END AS score
FROM part p JOIN best b ON b.p_name = p.p_name AND b.p_type = p.p_type""")
def fuzzy_score_disjoint(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", S.fuzzy_score(F.col("p_name"), F.col("p_type")).alias("score"))


@query("E-05_cosine_score", sql="""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_score(spark, sf):
    e = V.table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(
        "vec_id", F.round(S.cosine_score(F.col("embedding"), F.col("other")), 6).alias("score")
    )


@query("E-05_text_cosine", sql="""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
a AS (SELECT p_partkey, w, count(*) AS n FROM w GROUP BY 1, 2),
b AS (SELECT p_partkey - 1 AS p_partkey, w, n FROM a),
na AS (SELECT p_partkey, sqrt(sum(n * n)) AS v FROM a GROUP BY 1), nb AS (SELECT p_partkey, sqrt(sum(n * n)) AS v FROM b GROUP BY 1),
dot AS (SELECT a.p_partkey, sum(a.n * b.n) AS d FROM a JOIN b USING (p_partkey, w) GROUP BY 1)
SELECT na.p_partkey, round(coalesce(d, 0) / (na.v * nb.v), 6) AS score FROM na JOIN nb USING (p_partkey) LEFT JOIN dot USING (p_partkey)""")
def text_cosine(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(after, "p_partkey").select(
        "p_partkey", F.round(S.text_cosine(F.col("p_name"), F.col("other")), 6).alias("score")
    )


_SCORED = """scored AS (
  SELECT item, path, 'CustomStringEvaluator' AS evaluator, CASE WHEN actual IS NULL THEN 0e0
    WHEN path = 'Item.Description' AND replace(gt, ',', '') = replace(actual, ',', '') THEN 1e0 WHEN gt = actual THEN 1e0 ELSE 0e0 END AS score FROM gt_leaf
  UNION ALL SELECT item, path, 'FuzzStringEvaluator', CASE WHEN actual IS NULL THEN 0e0 ELSE 1e0 END FROM gt_leaf)"""


@query("E-06_evaluate_json", views=("gt_leaf",), sql=f"WITH {_SCORED} SELECT item, evaluator, path, score FROM scored")
def evaluate_json(spark, sf):
    return E.evaluate_json(V.eval_items(spark, sf), ["item"])


@query("E-06_wide_results", views=("gt_leaf",), sql=f"""
WITH {_SCORED}
SELECT item, max(score) FILTER (evaluator = 'CustomStringEvaluator' AND path = 'Item.Description') AS description,
  max(score) FILTER (evaluator = 'CustomStringEvaluator' AND path = 'Item.Price') AS price,
  avg(score) FILTER (evaluator = 'FuzzStringEvaluator') AS fuzzy_ratio FROM scored GROUP BY item""")
def wide_results(spark, sf):
    wide = E.wide_results(E.evaluate_json(V.eval_items(spark, sf), ["item"]), ["item"])
    value = lambda name: F.try_element_at("results", F.lit(name))
    return wide.select(
        "item", value("CustomStringEvaluator.Item.Description").alias("description"),
        value("CustomStringEvaluator.Item.Price").alias("price"), value("FuzzStringEvaluator.ratio").alias("fuzzy_ratio"),
    )


def stored_leaves(spark, sf):
    """Ground-truth and actual leaves walked apart, as two tables."""
    items = V.eval_items(spark, sf)
    gt = JT.json_leaves(items.select("item", F.try_parse_json("ground_truth").alias("v")), "v", ["item"])
    actual = JT.json_leaves(items.select("item", F.try_parse_json("actual").alias("v")), "v", ["item"])
    return gt, actual


@query("D-03_compare_leaves", views=("gt_leaf",), sql="SELECT item, path, gt, actual FROM gt_leaf")
def compare_leaves(spark, sf):
    gt, actual = stored_leaves(spark, sf)
    return E.compare_leaves(gt, actual, ["item"])


@query("D-04_leaf_config", views=("gt_leaf",), sql="""
SELECT item, path, gt, CASE WHEN path = 'Item.Description' AND item % 2 = 0 THEN '{"CustomStringEvaluator":{"IGNORE_COMMAS":true}}' END AS config FROM gt_leaf""")
def leaf_config(spark, sf):
    schema = V.table(spark, sf, "part").filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_partkey").alias("item"), F.lit("Item.Description").alias("path"),
        F.parse_json(F.lit('{"CustomStringEvaluator":{"IGNORE_COMMAS":true}}')).alias("config"),
    )
    leaves = V.gt_leaf(spark, sf).select("item", "path", "gt")
    return E.leaf_config(leaves, schema, ["item"]).withColumn("config", F.to_json("config"))


@query("D-05_apply_evaluators", views=("gt_leaf",), sql="""
SELECT item, path, 'CustomStringEvaluator' AS evaluator, CASE WHEN actual IS NULL THEN 0e0 WHEN ltrim(gt, '$') = ltrim(actual, '$') THEN 1e0 ELSE 0e0 END AS score FROM gt_leaf
UNION ALL SELECT item, path, 'FuzzStringEvaluator', CASE WHEN actual IS NULL THEN 0e0 ELSE 1e0 END FROM gt_leaf
UNION ALL SELECT item, path, 'SameLength', CASE WHEN length(gt) = length(actual) THEN 1e0 ELSE 0e0 END FROM gt_leaf""")
def apply_evaluators(spark, sf):
    exact = E.Evaluator("CustomStringEvaluator", S.match_score, {"IGNORE_DOLLAR_SIGN": True})
    same = E.Evaluator("SameLength", lambda gt, actual, options: F.coalesce(F.length(gt) == F.length(actual), F.lit(False)).cast("int"))
    return E.apply_evaluators(V.gt_leaf(spark, sf), ["item"], [exact, E.FUZZY, same])


@query("A-01_evaluator_ratio", views=("gt_leaf",), sql=f"""
WITH {_SCORED} SELECT item, evaluator, count(*) AS compared, sum(score) AS total_score, avg(score) AS ratio FROM scored GROUP BY item, evaluator""")
def evaluator_ratio(spark, sf):
    return E.evaluator_ratio(E.evaluate_json(V.eval_items(spark, sf), ["item"]), ["item"])


@query("A-02_field_average", views=("run_view",), sql="""
SELECT replace(metric, 'json_evaluator.CustomStringEvaluator.', '') AS field, round_even(avg(value), 1) AS average FROM run_view GROUP BY 1""")
def field_average(spark, sf):
    return E.field_average(V.run_view(spark, sf))


@query("A-03_run_metrics", views=("gt_leaf",), sql=f"""
WITH {_SCORED} SELECT evaluator, path, round(avg(score), 9) AS value FROM scored GROUP BY evaluator, path""")
def run_metrics(spark, sf):
    scores = E.evaluate_json(V.eval_items(spark, sf), ["item"])
    return E.run_metrics(scores).withColumn("value", F.round("value", 9))
