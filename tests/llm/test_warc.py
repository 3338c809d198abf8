import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import warc
from paperloom.llm.store import new_path

SCHEMA = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


PAGES = [(5, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (9, None, None), (3, "u", ""), (4, "v", "WARC/1.1\r\n\r\n" * 3), (4, "v", "WARC/1.1\r\n\r\n" * 3), (8, "w", "x" * 300_000)]


def archive(spark, rows, **more):
    path = new_path(spark, "test-warc")
    warc.write_warc(warc.page_records(spark.createDataFrame(rows, SCHEMA), **more), path)
    return path


def test_pages_come_back(spark):
    got = {(r["page_id"], r["record_type"], r["refers_to"]): (r["payload_bytes"], r["payload_digest"]) for r in warc.page_archive(spark, archive(spark, PAGES)).collect()}
    size = lambda t: len((t or "").encode())
    want = {(2, "response", None): PAGES[1], (5, "revisit", 2): PAGES[0], (3, "response", None): PAGES[3], (9, "revisit", 3): PAGES[2],
            (4, "response", None): PAGES[4], (8, "response", None): PAGES[6]}
    assert got == {k: (size(p[2]), digest(p[2])) for k, p in want.items()}


def test_small_payloads_are_responses(spark):
    got = warc.page_archive(spark, archive(spark, PAGES, min_bytes=20))
    assert {r["page_id"] for r in got.where("record_type = 'revisit'").collect()} == set()
    assert got.count() == len(PAGES)


def test_filters_are_pushed_and_payloads_skipped(spark):
    path = archive(spark, PAGES)
    df = warc.read_warc(spark, path, "none").where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [r["payload"] for r in df.collect()] == [None]
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "") or df.count() == 1
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("u", "v")), GreaterThan(("content_type",), "a")]))
    assert [type(f) for f in left] == [GreaterThan]
    assert reader.wanted({"warc-type": "response", "warc-target-uri": "u"}) and not reader.wanted({"warc-type": "response"})


def test_partitions_pack_files(spark):
    path = archive(spark, [(i, "u", str(i)) for i in range(50)])
    small, large = warc.WarcReader({"path": path, "partitionbytes": "1"}), warc.WarcReader({"path": path})
    files = [f for p in small.partitions() for f in p.files]
    assert len(large.partitions()) == 1 and sorted(large.partitions()[0].files) == sorted(files) and len(files) == len(set(files))


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: x\r\n  y\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r["record_type"], r["target_uri"], bytes(r["payload"])) for r in rows] == [("resource", "x y", b"abc")] * 4
    (tmp_path / "c.warc").write_bytes(record[:-6])
    with pytest.raises(Exception, match="ends early"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_empty_table_null_ids_and_base32(spark):
    assert warc.page_archive(spark, archive(spark, [])).count() == 0
    got = warc.page_archive(spark, archive(spark, [(None, "u", "t"), (None, "u", "t"), (7, "u", "t")])).collect()
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == [("revisit", 7), ("revisit", 7)]
    t = spark.createDataFrame([(x,) for x in ["", "a", "é" * 50]], "t string").select("t", warc.base32_sha1(F.col("t")).alias("d"))
    assert all(r["d"] == digest(r["t"]) for r in t.collect())
