"""Stored tables of files with versions: upserts, deletes, streamed deltas, compaction.

A version is a manifest of files. A change writes new files, then a new manifest, and then one small version file, by a
rename that fails if that version exists. So readers see the old version or the new one; a writer that dies leaves only files
nobody refers to, and of two writers at once the second fails.

* Rows lie in buckets by a hash of their key. A change looks only into the buckets of its keys, reads just the key and
  what it compares there, and rewrites only the files that hold a changed row. Rows that are already stored as asked are no change.
* Streamed batches are appended as deltas. A read costs the base and the open deltas; ``compact`` folds these into the
  base. The number of each source's last batch is part of the version, so a batch that runs again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperloom.operators.ordering import latest_by

BUCKETS = 64
#: Rows in a file at most.
FILE_ROWS = 1_000_000
_MANIFEST = "file string, bucket int, seq long, rows long"


class Conflict(RuntimeError):
    """Another writer made the next version first; nothing of this change is visible. Run it again."""


class SnapshotTable:
    """A table below ``path``, keyed by ``key``. Of rows with one key the last written stands, or, where ``order`` is
    given, the one greatest in it, the later written among equals. All three settings are those of the table once it exists."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str] = "id", order: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.order, self.buckets = [key] if isinstance(key, str) else list(key), list(order), buckets

    # versions

    def version(self) -> int:
        """Number of the newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def versions(self) -> list[int]:
        fs, folder = self._fs("versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _state(self, version: int) -> dict:
        state = json.loads(self.spark.read.text(f"{self.path}/versions/{version:012}.json", wholetext=True).first()[0])
        self.key, self.order, self.buckets = state["key"], state["order"], state["buckets"]
        return state

    def _commit(self, version: int, state: dict) -> int:
        draft, file = f".{uuid.uuid4().hex}", f"{version:012}.json"
        fs, folder = self._fs("versions")
        fs.mkdirs(folder)
        jvm = self.spark._jvm
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, draft))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(folder, draft), jvm.org.apache.hadoop.fs.Path(folder, file), rename)
        except Py4JJavaError as e:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder, draft), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} of {self.path} exists") from e
            raise
        return version

    def _fs(self, below: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    # reading

    def files(self, version: int | None = None) -> DataFrame:
        """``file, bucket, seq, rows``: the files of a version; ``seq`` is 0 in the base and counts up over deltas."""
        state = self._state(self.version() if version is None else version)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/{state['manifest']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = version or self.version()
        state, files = self._state(version), self.files(version)
        base = self._rows(state, files.where("seq = 0"))
        if not state["deltas"]:
            return base
        return self._folded(base, self._newest(self._rows(state, files.where("seq > 0"), True)))

    def _rows(self, state: dict, files: DataFrame, numbered: bool = False, *more: Column) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        if numbered:
            schema = T.StructType([*schema.fields, T.StructField("__seq", T.LongType())])
        names = [f"{self.path}/{r['file']}" for r in files.select("file").collect()]
        read = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        return read.select("*", *more) if names else read.limit(0)

    def _newest(self, deltas: DataFrame) -> DataFrame:
        return latest_by(deltas, self.key, [*self.order, "__seq"])

    def _folded(self, base: DataFrame, newest: DataFrame) -> DataFrame:
        """Base and the newest delta row of each key; the base is filtered, not regrouped."""
        columns = base.columns
        ahead = newest.select(*self.key, F.lit(True).alias("__hit"), F.struct(*self._ranks()).alias("__rank"))
        stays = F.col("__hit").isNull() | self._outranks(F.struct(*self._ranks()), F.col("__rank"))
        kept = base.join(ahead, self.key, "left").where(stays).select(columns)
        if self.order:
            ranks = base.select(*self.key, F.struct(*self._ranks()).alias("__old"))
            beaten = newest.withColumn("__rank", F.struct(*self._ranks())).join(ranks, self.key).where(F.col("__old") > F.col("__rank"))
            newest = newest.join(beaten.select(self.key), self.key, "left_anti")
        return kept.unionByName(newest.select(columns))

    def _ranks(self) -> list[Column]:
        return [F.col(c) for c in self.order] or [F.lit(0)]

    def _outranks(self, stored: Column, new: Column) -> Column:
        return stored > new if self.order else F.lit(False)

    # changes

    def create(self, rows: DataFrame) -> int:
        """Version 1 from rows with distinct keys."""
        if self.version():
            raise Conflict(f"{self.path} has versions already")
        state = {"schema": json.loads(rows.schema.json()), "key": self.key, "order": self.order, "buckets": self.buckets, "done": {}, "deltas": 0}
        return self._next(0, state, None, self._write(rows))

    def upsert(self, updates: DataFrame, order: Sequence[str] = ()) -> int:
        """Store the update of each key that is greatest by ``order``, then by the table's own; returns the version that
        holds them. Without either, keys must be distinct. Columns that the table lacks only order."""
        by = [*order, *(c for c in self.order if c not in order)]
        return self._rewrite(latest_by(updates, self.key, by) if by else updates, False)

    def delete(self, ids: DataFrame) -> int:
        """Remove rows by key; keys that are not stored change nothing."""
        return self._rewrite(ids.select(*self.key).distinct(), True)

    def append(self, batch: DataFrame, source: str, batch_id: int) -> int:
        """Add a batch of a stream as a delta, once: batches of ``source`` up to its last are skipped."""
        version = self.version()
        if not version:
            self.create(batch.limit(0))
            version = 1
        state = self._state(version)
        if state["done"].get(source, -1) >= batch_id:
            return version
        new = batch if not self.order else latest_by(batch, self.key, self.order)
        rows = new.select(T.StructType.fromJson(state["schema"]).fieldNames()).withColumn("__seq", F.lit(version + 1).cast("long"))
        state["done"][source] = batch_id
        return self._next(version, state | {"deltas": state["deltas"] + 1}, self.files(version), self._write(rows, version + 1))

    def compact(self) -> int:
        """Fold open deltas into the base; files of the base without a changed row stay as they are."""
        return self._rewrite(None, False)

    def open_deltas(self) -> int:
        version = self.version()
        return self._state(version)["deltas"] if version else 0

    def _rewrite(self, changes: DataFrame | None, gone: bool) -> int:
        version = self.version()
        state, files = self._state(version), self.files(version)
        names = {f.name: f.dataType for f in T.StructType.fromJson(state["schema"])}
        asked = None
        if changes is not None:
            asked = changes.select(*self.key, *(F.lit(None).cast(t).alias(c) for c, t in names.items() if c not in self.key)) if gone else changes
            asked = asked.select(*names, F.lit(gone).alias("__gone"))
        if state["deltas"]:
            deltas = self._newest(self._rows(state, files.where("seq > 0"), True)).withColumn("__gone", F.lit(False))
            if asked is None:
                asked = deltas.drop("__seq")
            elif gone:
                asked = asked.unionByName(deltas.drop("__seq").join(asked.select(*self.key), self.key, "left_anti"))
            else:
                asked = self._newest(asked.withColumn("__seq", F.lit(version + 1).cast("long")).unionByName(deltas)).drop("__seq")
        if asked is None:
            return version
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        asked.withColumn("__bucket", self._bucket()).write.parquet(draft)
        asked = self.spark.read.parquet(draft)
        touched = [r[0] for r in asked.select("__bucket").distinct().collect()]  # BUCKETS at most
        base = files.where(F.col("seq") == 0)
        near = base.where(F.col("bucket").isin(touched)) if touched else base.limit(0)
        dirty = []
        if not near.isEmpty():
            old = self._rows(state, near, False, F.col("_metadata.file_path").alias("__file")).select(
                *self.key, "__file", F.struct(*self._ranks()).alias("__rank"), _digest(names).alias("__digest"))
            wanted = asked.select(*self.key, "__gone", F.struct(*self._ranks()).alias("__new"), _digest(names).alias("__want"))
            met = old.join(wanted, self.key)
            settled = met.where(~F.col("__gone") & ((F.col("__digest") == F.col("__want")) | self._outranks(F.col("__rank"), F.col("__new"))))
            dirty = [r[0] for r in met.join(settled.select(*self.key), self.key, "left_anti").select("__file").distinct().collect()]
            asked = asked.join(settled.select(*self.key), self.key, "left_anti")
        real = asked.where("NOT __gone").select(*names)
        if not dirty and not state["deltas"] and real.isEmpty():
            self._drop(draft)
            return version
        dirty = [f"data/{f.rsplit('/data/', 1)[1]}" for f in dirty]
        rewritten = real
        if dirty:
            is_dirty = F.col("file").isin(dirty)
            rewritten = self._rows(state, near.where(is_dirty)).join(asked.select(*self.key), self.key, "left_anti").unionByName(real)
            base = base.where(~is_dirty)
        new = self._next(version, state | {"deltas": 0}, base, self._write(rewritten))
        self._drop(draft)
        return new

    def _next(self, version: int, state: dict, kept: DataFrame | None, new: DataFrame) -> int:
        manifest = f"manifests/{version + 1:012}-{uuid.uuid4().hex}"
        files = new if kept is None else kept.unionByName(new)
        files.coalesce(1 + self.buckets // 64).write.parquet(f"{self.path}/{manifest}")
        return self._commit(version + 1, state | {"manifest": manifest})

    def _write(self, rows: DataFrame, seq: int = 0) -> DataFrame:
        """Write rows by bucket and list the files. A base is spread by ranges of bucket and key, which splits a bucket of any
        size; a delta goes by bucket, so that its rows are computed once."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("__bucket", self._bucket())
        spread = placed.repartition("__bucket") if seq else placed.repartitionByRange("__bucket", *self.key).sortWithinPartitions("__bucket", *self.key)
        spread.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        name = F.concat(F.lit("data/"), F.substring_index("__file", "/data/", -1))
        reader = self.spark.read.schema("__bucket int").option("basePath", f"{self.path}/{folder}")
        listed = reader.parquet(f"{self.path}/{folder}").select("__bucket", F.col("_metadata.file_path").alias("__file"))
        return listed.groupBy(name.alias("file"), F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).select(
            "file", "bucket", F.lit(seq).cast("long").alias("seq"), "rows")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def expire(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` versions and the files that none of these refers to; returns the files dropped.

        Not while others write: files of a change that is not committed yet are not referred to.
        """
        versions = self.versions()
        states = {v: self._state(v) for v in versions[-keep:]}
        held = reduce(lambda a, b: a.unionByName(b), (self.files(v) for v in states)).select("file").distinct()
        fs, data = self._fs("data")
        there = [str(f) for f in self._walk(fs, data)]
        names = self.spark.createDataFrame([(f"data/{f.rsplit('/data/', 1)[1]}",) for f in there], "file string")
        gone = [r[0] for r in names.join(held, "file", "left_anti").collect()]
        for v in versions[:-keep]:
            self._drop(f"{self.path}/versions/{v:012}.json")
        for f in gone:
            self._drop(f"{self.path}/{f}")
        fs, folder = self._fs("manifests")
        for s in fs.listStatus(folder):
            if f"manifests/{s.getPath().getName()}" not in {x["manifest"] for x in states.values()}:
                fs.delete(s.getPath(), True)
        return len(gone)

    def _walk(self, fs, folder):
        if not fs.exists(folder):
            return
        found = fs.listFiles(folder, True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet"):
                yield path.toUri().getPath()

    def _drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _digest(names: Sequence[str]) -> Column:
    """A row's content, to tell whether a stored row is the one asked for."""
    return F.to_json(F.struct(*names))
