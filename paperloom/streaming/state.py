"""Document state from step updates, and documents that do not finish in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.schemas import SKIP_FLAGS, STEP_FLAGS
from paperloom.streaming.sinks import read_upserts, upsert_stream

RESET = "reset"
# The state store that keeps keyed state off the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_state(updates: DataFrame) -> DataFrame:
    """Current state of each document from ``id, step, event_time, value, seconds`` updates.

    A step's newest update counts if it is not older than the document's last reset; a
    reset leaves the file landed. The result does not depend on arrival order, so the same
    aggregation serves a batch and a stream (update mode); it combines before the shuffle.
    """
    steps = [*STEP_FLAGS, *SKIP_FLAGS]
    newest = [
        F.max(F.when(F.col("step") == s, F.struct("event_time", "value", "seconds"))).alias(s) for s in steps
    ]
    reset_at = F.max(F.when(F.col("step") == RESET, F.col("event_time"))).alias("__reset")
    grouped = updates.groupBy("id").agg(*newest, reset_at, F.max("event_time").alias("updated_at"))

    def current(step: str) -> Column:
        return F.col("__reset").isNull() | (F.col(f"{step}.event_time") >= F.col("__reset"))

    flags = []
    for s in steps:
        value = F.coalesce(F.when(current(s), F.col(f"{s}.value")), F.lit(False))
        if s == "file_landed":
            value = value | F.col("__reset").isNotNull()
        flags.append(value.alias(s))
        if s in STEP_FLAGS[:5]:
            flags.append(F.when(current(s), F.col(f"{s}.seconds")).alias(f"{s}_time_seconds"))
    return grouped.select("id", *flags, "updated_at")


def stuck_documents(states: DataFrame, now: Column, timeout: str) -> DataFrame:
    """Documents landed but not finished whose last update is older than ``timeout``."""
    return states.filter(
        F.col("file_landed") & ~F.col("processing_completed") & (F.col("updated_at") < now - F.expr(f"INTERVAL {timeout}"))
    ).select("id", "updated_at")


def state_stream(updates: DataFrame, path: str, checkpoint: str, compact_after: int = 16) -> StreamingQuery:
    """Keep the document states of a stream of updates in a stored table; ``read_states`` returns them.

    A state is what the newest update of each step says, whatever the order of arrival, so a batch only has to
    store its updates by document and step: the stream itself holds no state that could grow, a document of any age may
    be updated late, and a batch that runs again changes nothing.
    """
    steps = updates.select("id", F.coalesce("step", F.lit("")).alias("step"), "event_time", "value", "seconds")
    return upsert_stream(steps, path, checkpoint, ["id", "step"], ["event_time", "value", "seconds"], compact_after=compact_after)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Current document states of a table kept by ``state_stream``."""
    return document_state(read_upserts(spark, path, ["id", "step"], ["event_time", "value", "seconds"]))


# Below any time: a document was never landed, finished or reset.
_NEVER = -(1 << 61)
_TIMES = ["landed", "done", "reset", "last"]
_WATCHED = "id array<string>, " + ", ".join(f"{c} array<long>" for c in _TIMES)


def _watch(wait_ms: int):
    """Watches the documents of one bucket: the newest landing, completion, reset and update of each, one timeout for all.

    Landing and completion are microseconds times two, plus one if the flag was on, so every column's newest is its maximum.
    """

    def newest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).groupby("id", dropna=False, sort=False)[_TIMES].max().reset_index()

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs = pd.DataFrame(dict(zip(["id", *_TIMES], map(list, state.get)))) if state.exists else None
        if not state.hasTimedOut:
            for batch in batches:
                docs = newest([batch[["id", *_TIMES]]] if docs is None else [docs, batch[["id", *_TIMES]]])
        current = lambda x: (x % 2 == 1) & (x // 2 >= docs["reset"])
        waiting = (current(docs["landed"]) | (docs["reset"] != _NEVER)) & ~current(docs["done"])
        # what is finished is remembered until the watermark has passed: no update before it can still come
        due = docs["last"] // 1000 + waiting * wait_ms
        over = due < state.getCurrentWatermarkMs()
        kept = docs[~over]
        if len(kept):
            ids = [i if isinstance(i, str) else None for i in kept["id"]]
            state.update((ids, *(kept[c].tolist() for c in _TIMES)))
            state.setTimeoutTimestamp(int(due[~over].min()))
        elif state.exists:
            state.remove()
        stuck = docs[over & waiting]
        if len(stuck):
            yield pd.DataFrame({"id": stuck["id"], "updated_us": stuck["last"]})

    return watch


def stuck_stream(updates: DataFrame, timeout: str, watermark: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """Stream of documents that went ``timeout`` of event time without finishing, by the rule of ``stuck_documents``.

    State is a few numbers per open document. It goes when the document is reported, or once it is finished and the watermark
    has passed its last update; a document that lands or is reset later is watched anew. Documents are
    watched by bucket, as a call of Python per document costs milliseconds; ``buckets`` stays the same for a checkpoint. Times travel as microseconds, so the session's time zone plays no part.
    """
    spark = updates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    wait_ms = int(pd.Timedelta(timeout.lower()).total_seconds() * 1000)
    us = F.unix_micros("event_time")
    flagged = us * 2 + F.coalesce(F.col("value"), F.lit(False)).cast("int")
    only = lambda step, value: F.when(F.col("step") == step, value).otherwise(F.lit(_NEVER))
    times = (only("file_landed", flagged), only("processing_completed", flagged), only(RESET, us), us)
    steps = updates.filter(F.col("event_time").isNotNull()).withWatermark("event_time", watermark).select(
        F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", "event_time", *(t.alias(c) for t, c in zip(times, _TIMES)))
    stuck = steps.groupBy("bucket").applyInPandasWithState(
        _watch(wait_ms), "id string, updated_us long", _WATCHED, "append", GroupStateTimeout.EventTimeTimeout)
    return stuck.select("id", F.timestamp_micros("updated_us").alias("updated_at"))
