"""Streams: duplicates, arrival order, timeouts, late rows, upserts."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import events as TE
from paperloom.streaming import sinks as TS
from paperloom.streaming import state as TT

UPDATE = "id string, step string, event_time timestamp, value boolean, seconds double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return (START + timedelta(minutes=minutes)).isoformat()


def write_batches(path, batches):
    """One JSON-lines file per batch; names and times follow the order."""
    import os
    for i, rows in enumerate(batches):
        file = path / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


@pytest.fixture
def dirs(tmp_path):
    def make(name):
        d = tmp_path / name
        d.mkdir(exist_ok=True)
        return d
    return make


STEPS = ["file_landed", "ocr_completed", "gpt_extraction_completed", "gpt_evaluation_completed", "gpt_summary_completed", "processing_completed"]


def lifecycle(doc, upto, reset_at=None):
    rows = [{"id": doc, "step": s, "event_time": at(i), "value": True, "seconds": 1.0 + i} for i, s in enumerate(STEPS[:upto])]
    if reset_at is not None:
        rows.append({"id": doc, "step": "reset", "event_time": at(reset_at), "value": True, "seconds": None})
    return rows


def test_state_does_not_depend_on_arrival(spark, dirs):
    rows = lifecycle("a", 6) + lifecycle("b", 3) + lifecycle("c", 6, reset_at=4.5) + lifecycle("d", 2, reset_at=9)
    batch = spark.read.schema(UPDATE).json(write_batches(dirs("whole"), [rows]))
    want = {r.id: r.asDict() for r in TT.document_state(batch).collect()}
    assert want["a"]["processing_completed"] and want["a"]["ocr_completed_time_seconds"] == 2.0
    assert not want["c"]["ocr_completed"] and want["c"]["file_landed"] and want["c"]["processing_completed"]
    assert want["d"]["file_landed"] and not want["d"]["ocr_completed"]
    random.Random(1).shuffle(rows)
    src = write_batches(dirs("parts"), [rows[i::4] for i in range(4)])
    table, cp = str(dirs("table")), str(dirs("cp"))
    query = TT.state_stream(stream(spark, src, UPDATE), table, cp, compact_after=3)
    query.awaitTermination()
    assert not any(p["stateOperators"] for p in query.recentProgress)  # nothing grows in the stream
    assert {r.id: r.asDict() for r in TT.read_states(spark, table).collect()} == want
    late = lifecycle("d", 6)[1:2] + [{"id": "a", "step": "reset", "event_time": at(99), "value": True, "seconds": None}]
    write_batches(dirs("parts2"), [late])
    TT.state_stream(stream(spark, str(dirs("parts2").parent / "parts2"), UPDATE), table, str(dirs("cp2"))).awaitTermination()
    got = {r.id: r.asDict() for r in TT.read_states(spark, table).collect()}
    assert got["a"]["file_landed"] and not got["a"]["processing_completed"] and not got["d"]["ocr_completed"]
    assert {k: got[k] for k in "bc"} == {k: want[k] for k in "bc"}


def test_duplicates_are_dropped_across_batches(spark, dirs):
    def event(i):
        return {"id": f"e{i}", "eventType": "Microsoft.Storage.BlobCreated", "eventTime": at(i).replace("+00:00", "Z"), "data": {"url": f"u{i}"}}

    push = dirs("push")
    handshake = {"id": "h", "eventType": "Microsoft.EventGrid.SubscriptionValidationEvent", "data": {"validationCode": "c"}}
    (push / "0.json").write_text(json.dumps([event(1), event(2), event(1)]))
    (push / "1.json").write_text(json.dumps(event(2), indent=1))
    (push / "2.json").write_text(json.dumps([handshake, event(3)]))
    events = TE.dedupe_events(TE.stream_blob_events(spark, str(push), max_files=1))
    out = TS.run_to_files(events.select("event_id", "url"), str(dirs("out")), str(dirs("cp")))
    assert sorted(r.event_id for r in out.collect()) == ["e1", "e2", "e3"]


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    """Results must not depend on the session's time zone."""
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stuck_documents_time_out(spark, dirs, zone):
    quiet = lifecycle("stuck", 2) + lifecycle("done", 6)
    # an update of a finished document that arrives late, but not behind the watermark, opens nothing
    late_step = [{"id": "done", "step": "file_landed", "event_time": at(3), "value": True, "seconds": 0.0}]
    again = lifecycle("redo", 6, reset_at=7)
    later = [{"id": "late", "step": "file_landed", "event_time": at(500), "value": True, "seconds": 0.0}]
    last = [{"id": "late", "step": "processing_completed", "event_time": at(501), "value": True, "seconds": 0.0}]
    src = write_batches(dirs("in"), [quiet, late_step + again, later, last])
    stuck = TT.stuck_stream(stream(spark, src, UPDATE), "60 minutes")
    out = TS.run_to_files(stuck, str(dirs("out")), str(dirs("cp")))
    got = {r.id: r.t for r in out.select("id", F.unix_micros("updated_at").alias("t")).collect()}
    assert got == {"stuck": int((START + timedelta(minutes=1)).timestamp() * 1e6), "redo": int((START + timedelta(minutes=7)).timestamp() * 1e6)}


def test_stuck_stream_drops_its_state(spark, dirs):
    batches = [[{"id": f"d{b}-{i}", "step": s, "event_time": at(b * 100 + j), "value": True, "seconds": 0.0}
                for i in range(20) for j, s in enumerate(("file_landed", "processing_completed"))] for b in range(4)]
    query = (
        TT.stuck_stream(stream(spark, write_batches(dirs("in"), batches), UPDATE), "60 minutes", "1 minute")
        .writeStream.format("noop").outputMode("append").option("checkpointLocation", str(dirs("cp"))).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 40


def test_stuck_batch(spark, dirs):
    rows = lifecycle("stuck", 2) + lifecycle("done", 6) + lifecycle("fresh", 1)
    rows[-1]["event_time"] = at(100)
    states = TT.document_state(spark.read.schema(UPDATE).json(write_batches(dirs("b"), [rows])))
    found = TT.stuck_documents(states, F.lit(at(120)).cast("timestamp"), "60 MINUTES")
    assert [r.id for r in found.collect()] == ["stuck"]


def test_timeline_closes_days_and_drops_late_rows(spark, dirs):
    def doc(day, status="completed"):
        return {"request_timestamp": at(day * 1440 + 5), "status": status}

    # A batch drops what is behind the watermark of the batch before it.
    batches = [[doc(0), doc(0, "failed"), doc(1)], [doc(6)], [doc(6)], [doc(0), doc(12)]]
    src = write_batches(dirs("in"), batches)
    counts = TS.timeline_stream(stream(spark, src, "request_timestamp timestamp, status string"))
    out = TS.run_to_files(counts, str(dirs("out")), str(dirs("cp"))).collect()
    assert sorted((str(r.date), r.n, r.completed, r.failed) for r in out) == [
        ("2024-01-01", 2, 1, 1), ("2024-01-02", 1, 1, 0), ("2024-01-07", 2, 2, 0),
    ]


def test_rerun_of_upserts_adds_nothing(spark, dirs):
    src = write_batches(dirs("in"), [[{"id": "a", "v": 1, "version": 1}], [{"id": "a", "v": 2, "version": 2}, {"id": "b", "v": 3, "version": 1}]])
    log, cp = str(dirs("log")), str(dirs("cp"))
    for _ in range(2):
        TS.upsert_stream(stream(spark, src, "id string, v int, version int"), log, cp).awaitTermination()
    assert {(r.id, r.v) for r in TS.read_upserts(spark, log).collect()} == {("a", 2), ("b", 3)}


def test_upserts_are_folded_and_a_batch_counts_once(spark, dirs):
    from paperloom.sources.snapshots import SnapshotTable

    batches = [[{"id": f"k{i % 5}", "v": b, "version": b} for i in range(b + 1)] for b in range(7)]
    src, log, cp = write_batches(dirs("in"), batches), str(dirs("log")), str(dirs("cp"))
    TS.upsert_stream(stream(spark, src, "id string, v int, version int"), log, cp, compact_after=3).awaitTermination()
    table = SnapshotTable(spark, log)
    assert table.open_deltas() == 1  # two folds of three, one batch since
    want = {(f"k{i}", 6) for i in range(5)}
    assert {(r.id, r.v) for r in TS.read_upserts(spark, log).collect()} == want
    version = table.version()
    assert table.append(spark.createDataFrame([("k0", 99, 99)], "id string, v int, version int"), cp, 6) == version
    table.compact()
    assert {(r.id, r.v) for r in TS.read_upserts(spark, log).collect()} == want and table.open_deltas() == 0


@pytest.mark.parametrize("name", ["T-05_timeline_stream", "T-06_upsert_stream", "T-03_document_state_stream", "T-04_stuck_stream"])
def test_a_table_may_be_one_file_or_a_folder(spark, sf, tmp_path, name):
    import __spark_entry__ as entry

    for table in ("documents", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = [sorted(map(str, entry.queries()[name](spark, at).collect())) for at in (sf, str(tmp_path))]
    assert rows[0] and rows[0] == rows[1]


def test_stuck_documents_are_watched_by_bucket(spark, dirs):
    rows = [u for i in range(300) for u in lifecycle(f"d{i}" if i else None, i % 7, reset_at=2.5 if i % 5 == 0 else None)]
    rows += [{"id": "clock", "step": "reset", "event_time": at(m), "value": True, "seconds": None} for m in (0, 60)]
    path = write_batches(dirs("in"), [rows[::2], rows[1::2], rows[-1:]])
    batch = spark.read.schema(UPDATE).json(path)
    now = batch.agg(F.max("event_time")).scalar()
    want = {(r.id, r.updated_at) for r in TT.stuck_documents(TT.document_state(batch), now, "30 MINUTES").collect()}
    out, cp = str(dirs("out")), str(dirs("cp"))
    query = TT.stuck_stream(stream(spark, path, UPDATE), "30 minutes", "1 hour", buckets=8).writeStream.format("parquet").option(
        "checkpointLocation", cp).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert all(p.stateOperators[0].numRowsTotal <= 8 for p in query.recentProgress)
    late = stream(spark, write_batches(dirs("late"), [[{"id": "clock", "step": "reset", "event_time": at(120), "value": True, "seconds": None}]]), UPDATE)
    whole = stream(spark, path, UPDATE).union(late)
    got = {(r.id, r.updated_at) for r in TS.run_to_files(TT.stuck_stream(whole, "30 minutes", "1 hour", buckets=8), str(dirs("out2")), str(dirs("cp2"))).collect()}
    assert len(want) > 100 and {r for r in got if r[0] != "clock"} == want
