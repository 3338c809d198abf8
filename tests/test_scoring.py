"""Scorers: option vectors, fuzzy percentages, and the window search against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import scoring as S

EXACT_VECTORS = [
    # ground truth, actual, options, score
    ("net 30 days", "net 30 days", {}, 1),
    ("net 30 days", "net 60 days", {}, 0),
    ("Net 30 Days", "nET 30 dAYS", {}, 1),
    ("1200", "1,200", {"IGNORE_COMMAS": True}, 1),
    ("1200", "1,200", {"IGNORE_COMMAS": False}, 0),
    ("No 7", "No. 7", {"IGNORE_DOTS": True}, 1),
    ("No 7", "No. 7", {"IGNORE_DOTS": False}, 0),
    ("$45", "45", {"IGNORE_DOLLAR_SIGN": True}, 1),
    ("$45", "45", {"IGNORE_DOLLAR_SIGN": False}, 0),
    ("$$45", "45", {"IGNORE_DOLLAR_SIGN": True}, 1),
    ("4$5", "45", {"IGNORE_DOLLAR_SIGN": True}, 0),
    ("(02) 11", "02 11", {"IGNORE_PARENTHETHES": True}, 1),
    ("(02) 11", "02 11", {"IGNORE_PARENTHETHES": False}, 0),
    ("A-17-b", "a17B", {"IGNORE_DASHES": True}, 1),
    ("A-17-b", "a17B", {"IGNORE_DASHES": False}, 0),
    ("(02)-1.1,0", "02110", {"IGNORE_DASHES": 1, "IGNORE_DOTS": 1, "IGNORE_COMMAS": 1, "IGNORE_PARENTHETHES": 1}, 1),
    ("paid", "settled", {"ADDITIONAL_MATCHES": ["settled", "closed"]}, 1),
    ("paid", "open", {"ADDITIONAL_MATCHES": ["settled", "closed"]}, 0),
    ("paid", "paid", {"ADDITIONAL_MATCHES": ["settled"]}, 1),
    ("paid", "SETTLED", {"ADDITIONAL_MATCHES": ["settled"]}, 1),
    ("paid", "settled", {"ADDITIONAL_MATCHES": ["SETTLED"]}, 0),
    ("a.b", "ab", {"IGNORE_DOTS": "False"}, 1),
    ("#5", "5", {"IGNORE_NUMBER_SIGN": True}, 0),
    ("5.0", "5.00", {}, 0),
    (None, "None", {}, 1),
    ("x", None, {}, 0),
]


def test_exact_vectors(spark):
    rows = [(i, g, a, json.dumps(o)) for i, (g, a, o, _) in enumerate(EXACT_VECTORS)]
    df = spark.createDataFrame(rows, "i int, gt string, actual string, options string")
    score = S.match_score(F.col("gt"), F.col("actual"), S.options_of(F.parse_json("options")))
    got = {r.i: r.s for r in df.select("i", score.alias("s")).collect()}
    assert [got[i] for i in range(len(EXACT_VECTORS))] == [v[3] for v in EXACT_VECTORS]


def test_empty_configuration_means_default(spark):
    df = spark.createDataFrame([("$1", "1", "{}"), ("$1", "1", None), ("$1", "1", '{"IGNORE_DOTS":true}')], "g string, a string, o string")
    score = S.match_score(F.col("g"), F.col("a"), S.options_of(F.try_parse_json("o"), {"IGNORE_DOLLAR_SIGN": True}))
    assert [r.s for r in df.select(score.alias("s")).collect()] == [1, 1, 0]


# The first three scores are stored results to match.
FUZZY_VECTORS = [
    ("Happiest Valley Farms", "Henry Ross", 0.33),
    ("value1", "wrong_value", 0.91),
    ("value3", "value,3", 0.91),
    ("", "", 0.0),
    ("5.0", "5.00", 1.0),
    ("www.shop.com", "http://other.com", 1.0),
    ("same", "same", 1.0),
    ("--", "--", 0.0),
    ("é", "é", 0.0),
    (None, "a", 0.0),
    ("a", None, 0.0),
]


def test_fuzzy_vectors(spark):
    df = spark.createDataFrame([(i, g, a) for i, (g, a, _) in enumerate(FUZZY_VECTORS)], "i int, g string, a string")
    by_column = df.select("i", S.fuzzy_score(F.col("g"), F.col("a")).alias("s"))
    by_frame = S.with_fuzzy_score(df, "s", F.col("g"), F.col("a")).select("i", "s")
    want = [v[2] for v in FUZZY_VECTORS]
    for out in (by_column, by_frame):
        got = {r.i: r.s for r in out.collect()}
        assert [got[i] for i in range(len(want))] == pytest.approx(want)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_window_search_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 18)))
        s, t = sorted((a, b), key=len)
        pairs = [(s, t)] + ([(t, s)] if len(s) == len(t) else [])
        best = 0.0
        for x, y in pairs:
            spans = {y[i:i + len(x)] for i in range(len(y) - len(x) + 1)}
            spans |= {y[:k] for k in range(1, len(x))} | {y[-k:] for k in range(1, len(x))}
            best = max(best, *(200 * _lcs(x, w) / (len(x) + len(w)) for w in spans))
        assert S.best_window_percent(a, b) == pytest.approx(best)


def test_long_texts_are_searched_whole():
    needle = "x" * 90 + "needle"
    assert S.best_window_percent(needle, "y" * 400 + needle + "y" * 10) == 100


def test_truthiness(spark):
    values = {'"False"': True, '""': False, "true": True, "false": False, "0": False, "0.0": False, "2": True,
              "null": False, "[]": False, "[0]": True, "{}": False, '{"a":1}': True}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.t for r in df.select("v", S.truthy(F.parse_json("v")).alias("t")).collect()}
    assert got == values


def test_scores_from_sql_equal_those_of_frames(spark):
    from paperloom.functions.sqlfunctions import register_sql_functions

    register_sql_functions(spark)
    texts = [None, "", "None", "$1,234.50", "1234.50", "$$5", "Red, Widget", "widget red", "ré-d", "été", "new york mets", "yankees", "a.b-c (d)", "abc d"]
    options = ["{}", '{"IGNORE_COMMAS":true,"IGNORE_DOTS":"False"}', '{"IGNORE_DOLLAR_SIGN":1,"IGNORE_PARENTHETHES":[0],"IGNORE_DASHES":""}', '{"ADDITIONAL_MATCHES":["abc d",7,"$$5"]}', "bad"]
    rows = [(a, b, o) for a in texts for b in texts for o in options]
    df = spark.createDataFrame(rows, "gt string, actual string, options string")
    df.createOrReplaceTempView("sql_pairs")
    got = spark.sql("SELECT gt, actual, options, match_score(gt, actual, options) AS m, fuzzy_score(gt, actual) AS f FROM sql_pairs").collect()
    want = df.select("gt", "actual", "options", S.match_score(F.col("gt"), F.col("actual"), S.options_of(F.try_parse_json("options"))).alias("m"),
                     S.fuzzy_score(F.col("gt"), F.col("actual")).alias("f")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_literal_options_score_like_a_column(spark):
    import json

    texts = [None, "$1,234.50", "1234.50", "Red, Widget", "(a)-b", "ab", "x"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "gt string, actual string")
    for o in ({}, {"IGNORE_COMMAS": True, "IGNORE_DOTS": 0}, {"IGNORE_DOLLAR_SIGN": "x"}, {"IGNORE_PARENTHETHES": 1, "IGNORE_DASHES": [1], "ADDITIONAL_MATCHES": ["x", 3]}):
        both = df.select(S.match_score(F.col("gt"), F.col("actual"), o).alias("a"),
                         S.match_score(F.col("gt"), F.col("actual"), S.options_of(F.parse_json(F.lit(json.dumps(o))))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both)
