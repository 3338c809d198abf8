"""Trees of any depth, texts that do not parse, and exact sums."""

import json

from pyspark.sql import functions as F

from paperloom.operators import chunks as CH, evaluate as E, jsontree as JT


def nested(n, leaf=1):
    v = leaf
    for i in range(n):
        v = {"k": v} if i % 2 else [v, i]
    return v


def model(v, path=""):
    if isinstance(v, dict):
        return [x for k in sorted(v) for x in model(v[k], f"{path}.{k}" if path else k)]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in model(y, f"{path}[{i}]")]
    return [(path, str(v))]


def test_leaves_below_the_unrolled_levels(spark):
    deep = {"a": nested(40), "b": {"c": [[]]}, "d": 1}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "3")], "id long, t string").select("id", F.parse_json("t").alias("v"))
    got = JT.json_leaves(df, "v", ["id"])
    assert sorted((r["path"], r["value"]) for r in got.where("id = 1").collect()) == sorted(model(deep))
    assert all(len(r["ords"]) == r["pointer"].count("/") for r in got.collect())
    back = JT.leaves_to_json(got.where("id = 1"), ["id"]).first()["json"]
    assert json.loads(back) == {"a": deep["a"], "d": 1}


def test_deep_items_are_scored_and_bad_ones_listed(spark):
    deep = json.dumps({"a": nested(25, "x"), "b": "y"})
    rows = [(1, deep, deep), (2, "{bad", deep), (3, '{"a": 1, "a": 2}', '{"a": 2}'), (4, deep, None)]
    items = spark.createDataFrame(rows, "item long, ground_truth string, actual string")
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    try:
        scores = E.evaluate_json(items, ["item"], [E.EXACT]).groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("n")).collect()
        bad = E.unreadable_items(items, ["item"]).collect()
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert {r["item"]: (r["s"], r["n"]) for r in scores} == {1: (1.0, 15), 3: (1.0, 1), 4: (0.0, 15)}
    assert [(r["item"], r["column"]) for r in bad] == [(2, "ground_truth")]


def test_whole_numbers_add_exactly_and_merge_at_depth(spark):
    rows = [("a", i, json.dumps({"n": n, "d": {"d": {"d": {"d": {"d": {"d": {"d": {"d": [i]}}}}}}}})) for i, n in enumerate([9007199254740993, 1, True])]
    got = json.loads(CH.merge_chunks(spark.createDataFrame(rows, "id string, chunk_idx int, data string")).first()["json"])
    assert got["n"] == 9007199254740995
    assert got["d"]["d"]["d"]["d"]["d"]["d"]["d"]["d"] == [0, 1, 2]


def test_nesting_counts_brackets_outside_strings(spark):
    texts = ['1', '{}', '[[]]', '{"a": "[[[[{{", "b": [1]}', r'["\"[[[", {"k\\": [{"x": 1}]}]', '"' + "[" * 50 + '"', json.dumps(nested(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.selectExpr("i", f"{JT.nesting_sql('t')} AS n").orderBy("i").collect()]
    assert got == [0, 1, 2, 2, 4, 0, 60]


def test_wide_lists_take_linear_time(spark):
    """Ten times the objects may not take a hundred times as long; passes follow the nesting, not the number of brackets."""
    import time

    from paperloom.functions.sqlfunctions import register_sql_functions
    register_sql_functions(spark)
    seconds = {}
    for n in (1000, 1000, 10_000):
        text = json.dumps([{"a": i, "b": ["[", {"c": i}]} for i in range(n)])
        spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("wide")
        began = time.perf_counter()
        assert spark.sql("SELECT size(json_leaf_list(t)) FROM wide").first()[0] == 3 * n
        seconds[n] = time.perf_counter() - began
    assert seconds[10_000] < 40 * max(seconds[1000], 0.3)


def test_assembly_plans_the_same_at_any_depth(spark):
    def planned(depth):
        text = json.dumps({"a": nested(depth), "z": [{"q": 1}, 2, []], "k/#~": {"x": "y"}})
        df = spark.createDataFrame([(1, text)], "id int, t string").select("id", F.parse_json("t").alias("v"))
        leaves = spark.createDataFrame(JT.json_leaves(df, "v", ["id"], 2).select("id", "pointer", "json").collect(), "id int, pointer string, json string")
        out = JT.leaves_to_json(leaves, ["id"])
        want = {"a": nested(depth), "z": [{"q": 1}, 2], "k/#~": {"x": "y"}}
        assert json.loads(out.first()["json"]) == want
        return out._jdf.queryExecution().executedPlan().toString().count("\n")

    assert planned(200) == planned(5)
