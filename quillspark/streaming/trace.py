"""Trace streams: deltas, drains that are safe for late commits, replay, run states and their expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming.queue import run_jobs

TERMINAL = ("ok", "error", "cancelled", "interrupted")
TTL_SECONDS = 60


def since(events: DataFrame, cursor: int) -> tuple[DataFrame, DataFrame]:
    """(events from the cursor on, the next cursor as a frame of one row) of events numbered by seq per run."""
    return events.filter(F.col("seq") >= cursor), events.groupBy("run_id").agg((F.max("seq") + 1).alias("next_cursor"))


def drain(steps: DataFrame, after: int) -> DataFrame:
    """Steps past a mark, in order. A step that commits late under the mark is missed; see new_steps()."""
    return steps.filter(F.col("step_index") > after).orderBy("run_id", "branch", "step_index")


def new_steps(steps: DataFrame, emitted: DataFrame) -> DataFrame:
    """Steps not emitted yet, by identity, so those that commit out of order come too."""
    return steps.join(emitted.select("run_id", "branch", "step_index"), ["run_id", "branch", "step_index"], "left_anti")


def unique_steps(stream: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream of steps with each (run, branch, step) once; state goes with the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "branch", "step_index"])


def snapshot_then_tail(history: DataFrame, stream: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """The history up to an event number, and the stream behind it: no event is in both, none is missing."""
    return history.filter(F.col("seq") <= upto), stream.filter(F.col("seq") > upto)


def replay(runs: DataFrame, messages: DataFrame) -> DataFrame:
    """Events that stand for a run which memory has forgotten: by its status its answer, its error or its interruption."""
    last = messages.filter("role = 'assistant'").groupBy("run_id").agg(F.max_by("content", "id").alias("content"))
    kind = F.when(F.col("status") == "ok", "final").when(F.col("status") == "error", "error").when(F.col("status").isin("cancelled", "interrupted"), "interrupted")
    return runs.join(last, "run_id", "left").filter(kind.isNotNull()).select("run_id", kind.alias("type"), F.coalesce("content", F.lit("")).alias("data"))


def reconcile_dangling(runs: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with running ones interrupted, replies for user turns that never got one)."""
    fixed = runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))
    answered = messages.filter("role = 'assistant'").select("run_id")
    orphans = messages.filter("role = 'user' and run_id is not null").join(answered, "run_id", "left_anti")
    return fixed, orphans.select("session_id", F.lit("assistant").alias("role"), F.lit("").alias("content"), "run_id")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 8) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def sse_text(rows: DataFrame, kind: str, data: str) -> DataFrame:
    """Rows as server-sent events."""
    return rows.select(F.concat(F.lit("event: "), F.col(kind), F.lit("\ndata: "), F.col(data), F.lit("\n\n")).alias("value"))


def run_states(stream: DataFrame) -> DataFrame:
    """(run_id, status, n_events, evicted): a run's state after each batch. The first terminal status stays; a run's state

    is dropped TTL_SECONDS after it. stream: run_id, type, status, ts; the state is a small tuple a run.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], status, n, True)], columns=["run_id", "status", "n_events", "evicted"])
            return
        status, n = state.get if state.exists else ("running", 0)
        for pdf in batches:
            n += len(pdf)
            ends = pdf[pdf["status"].isin(TERMINAL)].sort_values("ts")
            if status == "running" and len(ends):
                status = ends["status"].iloc[0]
        state.update((status, n))
        if status != "running":
            state.setTimeoutDuration(TTL_SECONDS * 1000)
        yield pd.DataFrame([(key[0], status, n, False)], columns=["run_id", "status", "n_events", "evicted"])

    return stream.groupBy("run_id").applyInPandasWithState(step, "run_id long, status string, n_events long, evicted boolean", "status string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


RUN_CHANGE = "run_id long, status string, n_events long, ended timestamp, evicted boolean"
#: RUN_CHANGE with the end in microseconds.
_CHANGE = "run_id long, status string, n_events long, ended long, evicted boolean"
_RUNS = pa.schema([("run_id", pa.int64()), ("status", pa.string()), ("n_events", pa.int64()), ("ended", pa.int64())])
#: The end of a run that hasn't ended.
_OPEN = np.iinfo(np.int64).max


class _Lifecycle(StatefulProcessor):
    """The runs of a bucket: status, number of events and end of each. The first terminal status stays; the bucket's timer, set for
    the run that is due first, removes all that are due."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("runs", "runs binary, timer long")

    def _read(self) -> tuple[pd.DataFrame, int | None]:
        raw, timer = self.held.get() if self.held.exists() else (None, None)
        table = _RUNS.empty_table() if raw is None else pa.ipc.open_stream(bytes(raw)).read_all()
        return table.to_pandas().set_index("run_id"), timer

    def _write(self, runs: pd.DataFrame, timer: int | None) -> None:
        """Keep these runs, and a timer for the first that is due in the place of the one there is."""
        due = min((x for x in [runs["ended"].min()] if x < _OPEN), default=None) if len(runs) else None
        due = None if due is None else int(due) // 1000 + self.ttl_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if not len(runs):
            self.held.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _RUNS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(pa.Table.from_pandas(runs.reset_index(), _RUNS, preserve_index=False))
        self.held.update((out.getvalue().to_pybytes(), due))

    def _told(self, key: tuple, runs: pd.DataFrame, evicted: bool) -> pd.DataFrame:
        ended = pd.array(runs["ended"], "Int64")
        ended[(runs["ended"] == _OPEN).to_numpy()] = pd.NA
        run_id = pd.array(runs.index, "Int64") if key[0] >= 0 else pd.array([pd.NA] * len(runs), "Int64")
        return pd.DataFrame({"run_id": run_id, "status": runs["status"].to_numpy(), "n_events": runs["n_events"].to_numpy(), "ended": ended, "evicted": evicted})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        counts, ends = [], []
        for pdf in rows:
            counts.append(pdf.groupby("run_id").size())
            ends.append(pdf.loc[pdf["status"].isin(TERMINAL), ["run_id", "at", "status"]])
        n = pd.concat(counts).groupby(level=0).sum()
        first = pd.concat(ends).sort_values(["at", "status"]).drop_duplicates("run_id").set_index("run_id")
        runs, timer = self._read()
        new = pd.DataFrame({"status": "running", "n_events": 0, "ended": _OPEN}, index=n.index.difference(runs.index).rename("run_id"))
        runs = pd.concat([x for x in (runs, new) if len(x)])
        runs.loc[n.index, "n_events"] += n
        ending = first.index[(runs.loc[first.index, "status"] == "running").to_numpy()]
        runs.loc[ending, "status"] = first.loc[ending, "status"]
        runs.loc[ending, "ended"] = first.loc[ending, "at"]
        self._write(runs, timer)
        yield self._told(key, runs.loc[n.index], False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        runs, timer = self._read()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        upto = max(fired, timerValues.getCurrentWatermarkInMs() - 1)  # timers under the watermark fire
        due = (runs["ended"] < _OPEN) & (runs["ended"] // 1000 + self.ttl_ms <= upto)
        self._write(runs[~due], None if timer == fired else timer)  # one that fired is gone
        yield self._told(key, runs[due], True)

    def close(self) -> None:
        pass


def run_lifecycle(stream: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """RUN_CHANGE rows: each run's state after a batch that has events of it, and its eviction ttl_seconds after its end, by event time.

    stream: run_id, status (null unless the event ends the run), ts. The watermark, late behind the newest event, drives the timers, so
    the same events give the same evictions at any speed. An ended run's further events are counted until it is evicted; then
    they begin it anew. State is three values a run, kept by RocksDB: the session needs its provider (rocks()). Runs share a state and
    a timer by buckets of their ids, as a call for each run costs far more than its rows; a stream keeps the number it began with.
    """
    bucket = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
    rows = stream.withWatermark("ts", late).select(
        bucket.alias("bucket"), F.coalesce("run_id", F.lit(0)).cast("long").alias("run_id"), F.when(F.col("ts").isNotNull(), F.col("status")).alias("status"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), "ts"
    )
    changes = rows.groupBy("bucket").transformWithStateInPandas(_Lifecycle(ttl_seconds), _CHANGE, "Update", "EventTime")
    return changes.withColumn("ended", F.timestamp_micros("ended"))


def rocks(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB, which timers and large states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def queue_worker(handle: Callable[[Any], Any], passing: tuple[type[Exception], ...], lanes: int = 1) -> Callable[[DataFrame, int], DataFrame]:
    """A foreachBatch function over pending rows (id, status): handled ones are done, failures that may pass stay pending.

    Rows are run in tasks, in the order of ids within each of the lanes; see queue.py for a queue that several workers share.
    """
    return lambda batch, _: run_jobs(batch.filter("status = 'pending'"), handle, passing, lanes).select("id", "status")


def windowed_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Extension: counts a kind in tumbling windows under a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
