"""Response repair and classification on written-out cases."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import repair as R

FENCE = "```"
CASES = [
    # content, fixed status, fixed strategy, strict status
    ('{"a": 1}', "ok", None, "ok"),
    (f'{FENCE}json\n{{"a": 1}}\n{FENCE}', "repaired", "fence", "likely_truncation"),
    (f'{FENCE}\n[1]\n{FENCE}', "repaired", "fence", "likely_truncation"),
    ('Here: {"a": 1}', "repaired", "object", "repaired"),
    ("Items: [1, 2]", "repaired", "array", "repaired"),
    ("{'a': 'b'}", "repaired", "object_syntax", "repaired"),
    ('{"a": 1,}', "repaired", "object_syntax", "repaired"),
    ("{a: word}", "repaired", "object_syntax", "repaired"),
    ("[{a: 1}, {b: two words},]", "repaired", "array_syntax", "repaired"),
    ('{"a": 1', "likely_truncation", None, "likely_truncation"),
    ('{"a": [1}', "likely_truncation", None, "likely_truncation"),
    ('{"a": "cut', "likely_truncation", None, "likely_truncation"),
    ("{'u': 'http://x'}", "json_parse_error", None, "json_parse_error"),
    ("", "json_parse_error", None, "json_parse_error"),
    ("no braces", "likely_truncation", None, "likely_truncation"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, c[0], "stop") for i, c in enumerate(CASES)], "i int, content string, finish_reason string")


@pytest.mark.parametrize("mode,column", [("fixed", 1), ("strict", 3)])
def test_status(frame, mode, column):
    got = {r.i: r for r in R.repair_json(frame, mode=mode).collect()}
    assert [got[i].status for i in range(len(CASES))] == [c[column] for c in CASES]
    if mode == "fixed":
        assert [got[i].strategy for i in range(len(CASES))] == [c[2] for c in CASES]


def test_data_and_markers(frame):
    rows = {r.i: r for r in R.repair_json(frame).withColumn("j", F.to_json("data")).collect()}
    assert json.loads(rows[8].j) == [{"a": 1}, {"b": "two words"}]
    assert rows[9].indicators == ["unbalanced braces", "ends abruptly"]
    assert rows[9].extraction_failed and not rows[0].extraction_failed
    assert rows[9].raw_content == CASES[9][0]


def test_repairing_twice_changes_nothing(frame):
    once = R.repair_json(frame).filter(F.col("data").isNotNull()).select("i", F.to_json("data").alias("content"))
    again = R.repair_json(once)
    assert {r.status for r in again.collect()} == {"ok"}


def test_clean_response_cuts_after_balance(spark):
    df = spark.createDataFrame([('x {"a": {"b": 1}} y } z',), ("[1] and [2] more",), ("plain",)], "c string")
    assert [r.c for r in df.select(R.clean_response(F.col("c")).alias("c")).collect()] == ['{"a": {"b": 1}}', "[1]", "plain"]


def test_classes(spark):
    rows = [
        (0, '{"a":1}', "stop", None), (1, '{"a":1}', "length", None), (2, None, None, "timeout"),
        (3, "so {'a': 'b'}", "stop", None), (4, '{"a":', "stop", None), (5, "{]}[", "stop", None), (6, f"{FENCE}json\n1\n{FENCE}", "stop", None),
    ]
    df = spark.createDataFrame(rows, "i int, content string, finish_reason string, api_error string")
    got = {r.i: (r.status, r.strategy) for r in R.classify_response(df).collect()}
    assert got == {
        0: ("ok", None), 1: ("token_limit_exceeded", None), 2: ("api_error", None), 3: ("repaired", "cleaned"),
        4: ("likely_truncation", None), 5: ("likely_truncation", None), 6: ("likely_truncation", None),
    }


def test_plugged_in_repair(spark):
    df = spark.createDataFrame([("{<a>}",)], "content string")
    extra = [*R.REPAIRS, ("angles", lambda c: F.lit('{"a":1}'))]
    assert R.repair_json(df, repairs=extra).first().strategy == "angles"
