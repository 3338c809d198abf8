"""Walks, round trips, templates, number spelling."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.functions.columns import python_float_text
from paperloom.functions.json_text import is_strict_json
from paperloom.operators import evaluate as E
from paperloom.operators import jsontree as JT


def variant_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, j string").select("id", F.parse_json("j").alias("v"))


def test_paths_types_and_values(spark):
    tree = '{"a":[{"b":5.00},{"c d":null}],"x.y":true,"n":12,"e":{},"f":[],"t":"q"}'
    rows = JT.json_leaves(variant_frame(spark, [tree, '[["z"]]', '"alone"']), "v", ["id"]).collect()
    got = {(r.id, r.path): (r.type, r.value) for r in rows}
    assert got == {
        (0, "a[0].b"): ("number", "5.0"), (0, "a[1].c d"): ("null", None), (0, "x.y"): ("boolean", "true"),
        (0, "n"): ("number", "12"), (0, "t"): ("string", "q"), (1, "[0][0]"): ("string", "z"), (2, ""): ("string", "alone"),
    }


def test_equal_paths_have_different_pointers(spark):
    rows = JT.json_leaves(variant_frame(spark, ['{"a.b":1,"a":{"b":2},"c/#0":3,"c":{"#0":4}}']), "v", ["id"]).collect()
    assert len({r.pointer for r in rows}) == 4


def test_levels_below_the_unrolled_ones_are_opened_too(spark):
    frame = variant_frame(spark, ['{"a":{"b":{"c":1,"d":[{}, 2]}}}'])
    rows = JT.json_leaves(frame, "v", ["id"], max_depth=2).collect()
    assert sorted((r.path, r.value) for r in rows) == [("a.b.c", "1"), ("a.b.d[1]", "2")]


def test_recursive_query_gives_the_same_paths(spark):
    frame = variant_frame(spark, ['{"a":[1,{"b":"x"}],"c":null}', "[true]"])
    frame.createOrReplaceTempView("trees")
    walked = {(r.id, r.path) for r in JT.json_leaves(frame, "v", ["id"]).collect()}
    assert {(r.id, r.path) for r in JT.json_leaves_recursive(spark, "trees", "v", "id").collect()} == walked


SCALARS = st.one_of(st.booleans(), st.none(), st.integers(-10**9, 10**9), st.text("ab./#~[] ", max_size=5))
KEYS = st.text("ab./#~[]1", min_size=1, max_size=3)
TREES = st.recursive(
    SCALARS,
    lambda kids: st.one_of(st.lists(kids, min_size=1, max_size=3), st.dictionaries(KEYS, kids, min_size=1, max_size=3)),
    max_leaves=8,
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=20, max_size=20))
def test_round_trip(spark, trees):
    texts = [json.dumps(t) for t in trees]
    leaves = JT.json_leaves(variant_frame(spark, texts), "v", ["id"], 8)
    got = {r.id: json.loads(r.json) for r in JT.leaves_to_json(leaves, ["id"]).collect()}
    assert got == dict(enumerate(trees))


def test_float_spelling(spark):
    values = [1.0, 0.1, 5e-4, 1e-5, 1.5e-7, 1e7, 12345678.9, 1e15, 1.25e16, 1e22, -3e8, 1e-4, 286.9, 0.0, 1e100, -2.5e-10]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(python_float_text("v").alias("s")).collect()] == [str(v) for v in values]


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1}] x', '{"a":1}} x', '1, "b":2', "1,2", "", " ", '"s"', "[1]", "[1]]", '{"a":1,"a":2}', "{a:1}", '{"k":"]"}', '{"k":[1]}, 2']

    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.ok for r in df.select("i", is_strict_json(F.col("t")).alias("ok")).collect()}
    assert [got[i] for i in range(len(texts))] == [parses(t) for t in texts]


INVOICE = {
    "seller": "Northgate", "total": 12.5, "lines": [{"sku": "A-1", "qty": 2}, {"sku": "B-2", "qty": 1}], "paid": True,
}
READ = {"seller": "northgate", "total": "12.50", "lines": [{"sku": "A1", "qty": "2"}], "paid": "True", "page": 3}


def ratios(spark, gt, actual, schema=None, chosen=E.DEFAULT_EVALUATORS):
    items = spark.createDataFrame([(1, json.dumps(gt), json.dumps(actual), json.dumps(schema or {}))], "item int, ground_truth string, actual string, eval_schema string")
    scores = E.evaluate_json(items, ["item"], chosen).cache()
    by_path = {(r.evaluator, r.path): r.score for r in scores.collect()}
    return {r.evaluator: r.ratio for r in E.evaluator_ratio(scores, ["item"]).collect()}, by_path


def test_evaluation_without_schema(spark):
    ratio, by_path = ratios(spark, INVOICE, READ)
    exact = {"seller": 1, "total": 0, "lines[0].sku": 0, "lines[0].qty": 1, "lines[1].sku": 0, "lines[1].qty": 0, "paid": 1}
    fuzzy = {"seller": 1, "total": 1, "lines[0].sku": 0.67, "lines[0].qty": 1, "lines[1].sku": 0, "lines[1].qty": 0, "paid": 1}
    assert by_path == {
        **{("CustomStringEvaluator", k): v for k, v in exact.items()}, **{("FuzzStringEvaluator", k): v for k, v in fuzzy.items()}
    }
    assert ratio == {"CustomStringEvaluator": pytest.approx(3 / 7), "FuzzStringEvaluator": pytest.approx(4.67 / 7)}


def test_evaluation_with_schema_and_with_defaults(spark):
    no_dashes = {"CustomStringEvaluator": {"IGNORE_DASHES": "True"}}
    ratio, _ = ratios(spark, INVOICE, READ, {"seller": {}, "lines": [{"sku": no_dashes, "qty": {}}]})
    assert ratio == {"CustomStringEvaluator": pytest.approx(4 / 7), "FuzzStringEvaluator": pytest.approx(4.67 / 7)}
    lenient = E.Evaluator("CustomStringEvaluator", E.EXACT.score, {"IGNORE_DASHES": True})
    assert ratios(spark, INVOICE, READ, None, [lenient])[0]["CustomStringEvaluator"] == pytest.approx(4 / 7)
    # A field's own configuration replaces the default one.
    own = {"lines": [{"sku": {"CustomStringEvaluator": {"IGNORE_DOTS": True}}}]}
    assert ratios(spark, INVOICE, READ, own, [lenient])[0]["CustomStringEvaluator"] == pytest.approx(3 / 7)


def test_lists_and_mismatches(spark):
    rooted = [["p", "q"], {"pages": [4, 5, 6]}]
    ratio, by_path = ratios(spark, rooted, [["p"], {"pages": [4, 7, 6, 8]}], None, [E.EXACT])
    assert ratio["CustomStringEvaluator"] == pytest.approx(3 / 5)
    assert {p: v for (_, p), v in by_path.items()} == {"[0][0]": 1, "[0][1]": 0, "[1].pages[0]": 1, "[1].pages[1]": 0, "[1].pages[2]": 1}
    ratio, by_path = ratios(spark, rooted, {"pages": [4, 5, 6]}, None, [E.EXACT])
    assert ratio["CustomStringEvaluator"] == 0 and len(by_path) == 5
    ratio, _ = ratios(spark, {"a": None, "b": "x", "c": 5.0}, {"a": None, "b": {"y": 1}, "c": "5.00"}, None)
    assert ratio == {"CustomStringEvaluator": 0, "FuzzStringEvaluator": pytest.approx(1 / 3)}


def test_options_do_not_leak_between_fields(spark):
    schema = {"a": {"CustomStringEvaluator": {"ADDITIONAL_MATCHES": ["yes"]}}}
    _, by_path = ratios(spark, {"a": "no", "b": "x"}, {"a": "yes", "b": "no"}, schema, [E.EXACT])
    assert by_path["CustomStringEvaluator", "a"] == 1 and by_path["CustomStringEvaluator", "b"] == 0


def test_leaf_join_agrees_with_aligned_walk(spark):
    gt, actual = {"a": [1, {"b": "x"}], "c": "y"}, {"a": [1, {"b": "z"}, 3], "d": 1}
    items = spark.createDataFrame([(1, json.dumps(gt), json.dumps(actual))], "item int, ground_truth string, actual string")
    walked = {(r.path, r.gt, r.actual) for r in E.aligned_leaves(items, ["item"]).collect()}
    sides = [JT.json_leaves(items.select("item", F.parse_json(c).alias("v")), "v", ["item"]) for c in ("ground_truth", "actual")]
    assert {(r.path, r.gt, r.actual) for r in E.compare_leaves(*sides, ["item"]).collect()} == walked


def test_templates_of_a_small_file_are_walked_by_all_cores(spark, sf):
    from paperloom.plans import QUERIES

    plan = QUERIES["J-07_template_paths"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("RoundRobinPartitioning") > plan.rindex("Generate")  # the scan's rows are dealt out before the walk
