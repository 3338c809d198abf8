"""Stored tables: what a change rewrites, what readers see, reruns, failed and rival writers, deltas."""

import pytest
from pyspark.sql import functions as F

from paperloom.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "id string, v int, version int"


@pytest.fixture
def table(spark, tmp_path):
    made = SnapshotTable(spark, f"{tmp_path}/t", buckets=8)
    made.create(rows(spark, {f"k{i}": (i, 0) for i in range(200)}))
    return made


def rows(spark, values):
    return spark.createDataFrame([(k, v, n) for k, (v, n) in values.items()], SCHEMA)


def held(table, version=None):
    return {r["id"]: (r["v"], r["version"]) for r in table.read(version).collect()}


def names(table, version=None):
    return {r["file"] for r in table.files(version).collect()}


def test_upsert_rewrites_only_touched_files(spark, table):
    before, want = names(table), held(table)
    assert table.upsert(rows(spark, {"k7": (70, 1), "new": (1, 1)})) == 2
    assert held(table) == want | {"k7": (70, 1), "new": (1, 1)}
    assert held(table, 1) == want
    assert len(before - names(table)) == 1 and len(before) > 4
    assert table.files().agg(F.sum("rows")).first()[0] == 201


def test_rerun_changes_nothing(spark, table):
    change = rows(spark, {"k7": (70, 1), "k8": (8, 0)})
    table.upsert(change)
    files = names(table)
    assert table.upsert(change) == 2 and names(table) == files and table.versions() == [1, 2]
    gone = rows(spark, {"k1": (0, 0), "none": (0, 0)})
    assert table.delete(gone) == 3
    assert "k1" not in held(table) and len(held(table)) == 199
    assert table.delete(gone) == 3


def test_failed_writer_leaves_the_old_version(spark, table):
    want, files = held(table), names(table)
    broken = rows(spark, {"k7": (70, 1)}).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert held(table) == want and names(table) == files and table.version() == 1


def test_rival_writer_fails_and_loses_nothing(spark, table, monkeypatch):
    rival, real = SnapshotTable(spark, table.path), table._write

    def slow(changed, seq=0):
        out = real(changed, seq)
        rival.upsert(rows(spark, {"k9": (90, 1)}))
        return out

    monkeypatch.setattr(table, "_write", slow)
    with pytest.raises(Conflict):
        table.upsert(rows(spark, {"k7": (70, 1)}))
    assert held(table)["k9"] == (90, 1) and held(table)["k7"] == (7, 0)
    monkeypatch.undo()
    table.upsert(rows(spark, {"k7": (70, 1)}))
    assert held(table)["k9"] == (90, 1) and held(table)["k7"] == (70, 1)


def test_deltas_are_taken_once_and_folded(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/d", order=["version"], buckets=4)
    table.append(rows(spark, {"a": (1, 1), "b": (1, 5)}), "s", 0)
    second = rows(spark, {"a": (2, 2), "b": (2, 2), "c": (2, 1)})
    for _ in range(2):
        table.append(second, "s", 1)
    want = {"a": (2, 2), "b": (1, 5), "c": (2, 1)}
    assert held(table) == want and table.open_deltas() == 2
    table.compact()
    assert held(table) == want and table.open_deltas() == 0
    assert table.append(second, "s", 1) == table.version()
    files = names(table)
    table.append(rows(spark, {"a": (0, 1), "d": (3, 0)}), "s", 2)
    assert held(table) == want | {"d": (3, 0)}
    table.compact()
    assert held(table) == want | {"d": (3, 0)} and len(files - names(table)) == 0
    table.append(rows(spark, {"a": (9, 9), "c": (9, 9)}), "s", 3)
    table.delete(rows(spark, {"a": (0, 0)}))
    assert held(table) == {"b": (1, 5), "c": (9, 9), "d": (3, 0)} and table.open_deltas() == 0


def test_expire_drops_what_no_version_needs(spark, table):
    table.upsert(rows(spark, {"k7": (70, 1)}))
    table.upsert(rows(spark, {"k7": (71, 2)}))
    want = held(table)
    assert table.expire(1) == 2
    assert table.versions() == [3] and held(table) == want


def test_empty_updates_and_empty_table(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/e")
    table.create(rows(spark, {}) if False else spark.createDataFrame([], SCHEMA))
    assert held(table) == {}
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == 1
    table.upsert(rows(spark, {"a": (1, 1)}), ["version"])
    assert held(table) == {"a": (1, 1)}
    with pytest.raises(Conflict):
        table.create(rows(spark, {"a": (1, 1)}))
