"""Paid calls: each payload is answered once, whatever is run again."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.operators.stages import run_stage
from paperloom.sources.journal import Journal

SCHEMA = "id string, chunk_idx int, stage string, payload string"


def model(calls, crash=None):
    """A paid function that leaves a file per call; the worker dies the first time it meets ``crash``."""

    def call(text):
        if text == crash and not os.path.exists(f"{calls}/crashed"):
            open(f"{calls}/crashed", "w").close()
            os._exit(1)
        open(f"{calls}/{text}.{os.getpid()}.{len(os.listdir(calls))}", "w").close()
        if text.startswith("bad"):
            raise ValueError(text)
        return text.upper()

    return call


def made(calls):
    return Counter(f.split(".")[0] for f in os.listdir(calls) if f != "crashed")


@pytest.fixture
def work(spark):
    rows = [(f"d{i}", 0, "ocr", f"p{i}") for i in range(30)] + [("d0", 1, "ocr", "bad1"), ("d1", 1, "ocr", None), ("d0", 0, "ocr", "p0")]
    return spark.createDataFrame(rows, SCHEMA).where("payload IS NOT NULL")


@pytest.fixture
def calls(tmp_path):
    path = tmp_path / "calls"
    path.mkdir()
    return str(path)


def answers(df):
    return sorted((r["payload"], r["output"], r["error"]) for r in df.collect())


def test_two_actions_call_once(spark, work, calls, tmp_path):
    done = run_stage(work, model(calls), 4, journal=Journal(spark, f"{tmp_path}/journal"))
    first = answers(done)
    assert answers(done) == first and len(first) == 32
    assert ("bad1", None, "ValueError: bad1") in first and ("p7", "P7", None) in first
    assert set(made(calls).values()) == {1} and len(made(calls)) == 31


def test_a_killed_task_keeps_its_answers(spark, work, calls, tmp_path):
    journal = f"{tmp_path}/journal"
    with pytest.raises(Exception):
        run_stage(work, model(calls, crash="p20"), 2, journal=Journal(spark, journal)).collect()
    before = made(calls)
    assert 0 < len(before) < 31
    got = answers(run_stage(work, model(calls, crash="p20"), 2, journal=Journal(spark, journal)))
    assert len(got) == 32 and set(made(calls).values()) == {1} and len(made(calls)) == 31


def test_folded_answers_never_reach_python(spark, work, calls, tmp_path):
    journal = Journal(spark, f"{tmp_path}/journal")
    want = answers(run_stage(work, model(calls), 4, journal=journal))
    assert journal.fold(spark) == 31 and not os.path.exists(f"{tmp_path}/journal/calls")
    again = run_stage(work, model(calls), 4, journal=journal)
    assert answers(again) == want and set(made(calls).values()) == {1}
    assert journal.answers().count() == 31


def test_errors_can_be_tried_again_and_payloads_tell_calls_apart(spark, work, calls, tmp_path):
    path = f"{tmp_path}/journal"
    run_stage(work, model(calls), 4, journal=Journal(spark, path)).collect()
    run_stage(work, model(calls), 4, journal=Journal(spark, path, retry_errors=True)).collect()
    assert made(calls)["bad1"] == 2 and made(calls)["p3"] == 1
    changed = work.withColumn("payload", F.concat("payload", F.lit("-new")))
    run_stage(changed, model(calls), 4, journal=Journal(spark, path)).collect()
    assert made(calls)["p3-new"] == 1 and made(calls)["p3"] == 1
    assert run_stage(work.limit(0), model(calls), 2, journal=Journal(spark, path)).count() == 0


def test_files_do_not_grow_with_calls(spark, tmp_path):
    work = spark.range(20_000).selectExpr("concat('d', id) AS id", "0 AS chunk_idx", "'ocr' AS stage", "concat('p', id) AS payload")
    journal = Journal(spark, f"{tmp_path}/journal")
    done = run_stage(work, str.upper, 4, journal=journal)
    assert done.where("output = upper(payload)").count() == 20_000
    files = [f for _, _, names in os.walk(f"{tmp_path}/journal/calls") for f in names if f.endswith(".json")]
    assert len(files) <= 4096 + 4
    with open(f"{tmp_path}/journal/calls/{files[0]}", "a") as f:
        f.write('{"output": "cut o')  # a task died here
    assert done.where("output = upper(payload)").count() == 20_000 and journal.fold(spark) == 20_000
