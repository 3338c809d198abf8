"""Pushed events: every value of a file is read, and what cannot be read is kept apart."""

import json

from paperloom.plans import QUERIES
from paperloom.streaming import events as TE, sinks as TS


def event(i):
    return {"id": f"e{i}", "eventType": "Microsoft.Storage.BlobCreated", "eventTime": "2024-01-01T00:00:00Z", "data": {"url": f"u{i}"}}


def run(tmp_path, df, name):
    return TS.run_to_files(df, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")).collect()


def test_lists_and_single_events_of_one_file_and_a_broken_line(spark, tmp_path):
    push = tmp_path / "push"
    push.mkdir()
    lines = [json.dumps([event(1), event(2)]), json.dumps(event(3)), '{"id": "e9"', "", json.dumps([event(4)]), "[1]", json.dumps(event(5)) + "{}"]
    (push / "a.json").write_text("\n".join(lines))
    (push / "b.json").write_text(json.dumps([event(6), event(7)], indent=1))
    got = run(tmp_path, TE.stream_blob_events(spark, str(push)), "events")
    assert sorted(r["event_id"] for r in got) == ["e1", "e2", "e3", "e4", "e6", "e7"]
    bad = run(tmp_path, TE.stream_push_errors(spark, str(push)), "errors")
    assert sorted(r["body"] for r in bad) == sorted([lines[2], "1", lines[6]]) and all(r["error"] for r in bad)


def test_one_bad_element_costs_no_other(spark, tmp_path):
    push = tmp_path / "push"
    push.mkdir()
    elements = [event(i) for i in range(64)]
    elements[20] = {"eventType": "x"}
    (push / "a.json").write_text(json.dumps(elements))
    got = run(tmp_path, TE.stream_blob_events(spark, str(push)), "events")
    assert sorted(r["event_id"] for r in got) == sorted(f"e{i}" for i in range(64) if i != 20)
    bad = run(tmp_path, TE.stream_push_errors(spark, str(push)), "errors")
    assert [(json.loads(r["body"]), r["error"]) for r in bad] == [({"eventType": "x"}, "not an event")]


def test_no_event_is_lost_at_a_larger_scale(spark):
    large = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{large}/pages.parquet").count()
    assert QUERIES["S-06_stream_blob_events"](spark, large).count() == pages
    assert QUERIES["T-02_dedupe_events"](spark, large).count() == pages


def test_chunks_hold_whole_texts(spark):
    from pyspark.sql import functions as F

    from paperloom.plans.views import chunk_view, doc_view

    large = "/root/testdata/sf0.1"
    chars = chunk_view(spark, large).agg(F.sum(F.char_length("chunk_text"))).first()[0]
    assert chars == doc_view(spark, large).where("num_pages > 0").agg(F.sum(F.char_length("ocr_output"))).first()[0]
