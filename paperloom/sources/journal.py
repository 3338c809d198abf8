"""A journal of paid calls: each answer is stored as it comes, so that no call is made twice.

Answers are lines of segments. A segment holds calls of one bucket, by the first digits of the call's hash, so there are as many
files as buckets and not as many as calls. A task takes its calls in order of their hash, a bucket at a time, and looks into the
bucket's segments before it calls. That covers retried tasks, second actions and later runs. ``fold`` gathers the
segments into tables now and then.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SCHEMA = "output string, error string, seconds double, at double, __call string"
#: Digits of a call's hash that name its bucket.
BUCKET = 3


class Journal:
    """Answers below ``path``, in the folder all executors share: a local or mounted one, or a store that Arrow reads.

    ``retry_errors``: calls that failed are made again by the next run, and their answers replaced.
    """

    def __init__(self, spark: SparkSession, path: str, retry_errors: bool = False):
        self.path, self.retry_errors = path.rstrip("/"), retry_errors
        self._answers = _reader(spark, self.path, retry_errors)

    def __getstate__(self) -> dict:
        return {"path": self.path, "retry_errors": self.retry_errors}

    @staticmethod
    def call(key: Sequence[str], payload: str) -> Column:
        """Hash of a call: its key columns and payload, each with its length, nulls apart from empty texts."""
        part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
        return F.sha2(F.concat_ws("|", *(part(c) for c in (*key, payload))), 256)

    def answers(self) -> DataFrame:
        """``__call, output, error, seconds`` stored by now."""
        return self._answers()

    @staticmethod
    def task(call: str, parallel: int) -> Column:
        """Which of ``parallel`` tasks makes a call: each has a range of the hashes, so a bucket belongs to few tasks."""
        share = F.conv(F.left(call, F.lit(8)), 16, 10).cast("long") * F.lit(parallel) / F.lit(1 << 32)
        return F.floor(share).cast("int")

    def opened(self) -> Ledger:
        """What a task asks for its calls."""
        return Ledger(self.path, self.retry_errors)

    def fold(self, spark: SparkSession) -> int:
        """Gather the segments into one table; returns how many answers. Not while calls are being made."""
        store, root = _filesystem(self.path)
        if store.get_file_info(f"{root}/calls").type != fs.FileType.Directory:
            return 0
        table = f"{self.path}/tables/{uuid.uuid4().hex}"
        _newest(_segments(spark, self.path)).write.parquet(table)
        store.delete_dir(f"{root}/calls")
        return spark.read.schema(_SCHEMA).parquet(table).count()


class Ledger:
    """One task's use of a journal, for calls in ascending order.

    Its segments are written through line by line where that is seen at once, that is in local and mounted folders; other stores show a file
    when it is closed, so there a segment is one answer.
    """

    def __init__(self, path: str, retry_errors: bool):
        self.retry_errors = retry_errors
        self.store, root = _filesystem(path)
        self.folder = f"{root}/calls"
        self.store.create_dir(self.folder, recursive=True)
        self.through = self.store.type_name == "local"
        self.segments: dict[str, list[str]] = defaultdict(list)
        for file in self.store.get_file_info(fs.FileSelector(self.folder, recursive=True)):
            if file.type == fs.FileType.File:
                self.segments[file.base_name[:BUCKET]].append(file.path)
        self.bucket, self.stored, self.last, self.out = "", {}, {"__call": None}, None

    def once(self, call: str, make: Callable[[], tuple]) -> tuple:
        """The stored answer of ``call``, or that of ``make``, stored."""
        if call[:BUCKET] != self.bucket:
            self._turn(call[:BUCKET])
        old = self.last if self.last["__call"] == call else self.stored.get(call)
        if old is None or (self.retry_errors and old["error"] is not None and old is not self.last):
            output, error, seconds = make()
            # the call comes last: a line that a dying task did not finish has none
            old = self.last = {"output": output, "error": error, "seconds": seconds, "at": time.time(), "__call": call}
            if self.out is None:
                self.out = self.store.open_output_stream(f"{self.folder}/{self.bucket}-{uuid.uuid4().hex}.json")
            self.out.write(json.dumps(old).encode() + b"\n")
            if not self.through:
                self.close()
        return old["output"], old["error"], old["seconds"]

    def _turn(self, bucket: str) -> None:
        self.close()
        self.bucket, self.stored = bucket, {}
        for file in self.segments.get(bucket, ()):
            with self.store.open_input_stream(file) as f:
                lines = f.read().split(b"\n")
            for line in lines:
                try:
                    answer = json.loads(line)
                except ValueError:  # not finished
                    continue
                old = self.stored.get(answer["__call"])
                if old is None or _rank(old) < _rank(answer):
                    self.stored[answer["__call"]] = answer

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _rank(answer: dict) -> tuple[bool, float]:
    return answer["error"] is None, answer.get("at") or 0.0


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, root


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).json(f"{path}/calls").where("__call IS NOT NULL")


def _newest(answers: DataFrame) -> DataFrame:
    """One answer per call: the newest, but an error only if there is nothing else."""
    fields = ("output", "error", "seconds", "at")
    best = F.max_by(F.struct(*fields), F.struct(F.col("error").isNull(), "at"))
    return answers.groupBy("__call").agg(best.alias("a")).select(*(F.col(f"a.{c}") for c in fields), "__call")


def _reader(spark: SparkSession, path: str, retry_errors: bool) -> Callable[[], DataFrame]:
    def read() -> DataFrame:
        store, root = _filesystem(path)
        for folder in ("calls", "tables"):
            store.create_dir(f"{root}/{folder}", recursive=True)
        tables = spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}/tables")
        one = _newest(_segments(spark, path).unionByName(tables)).drop("at")
        return one.where("error IS NULL") if retry_errors else one

    return read
