"""Streaming forms: image folders as file streams, and per-key state machines over event streams.

State lives in Spark's state store, keyed by the key, so a key's events may come in any number of
micro-batches; within one they are put in order. The folds are the ones of `operators.health`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.health import Breaker


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 4) -> DataFrame:
    """New images of a folder, so many files a micro-batch (back pressure)."""
    out = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*").load(folder)
    return out.filter(F.lower("path").rlike(r"\.(webp|png|jpe?g)$")).select("path", "modificationTime", "content")


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _events(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A group's rows of a micro-batch in order."""
    return pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")


def _breaker_fold(failures: int, open_s: int, successes: int, timers: bool):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(failures, open_s, successes, *([tuple(state.get)] if state.exists else []))
        if state.hasTimedOut:  # the timer is set for open breakers only
            breaker.name, breaker.s = "HalfOpen", 0
        else:
            rows = _events(batches)
            breaker.run(rows["at"].to_numpy("int64"), rows["ok"].to_numpy(bool))
        state.update(tuple(int(x) if not isinstance(x, str) else x for x in breaker.state()))
        if timers and breaker.name == "Open":
            state.setTimeoutDuration(max(1, open_s * 1000))
        name, *_, trips, refused = breaker.state()
        yield pd.DataFrame({"key": [key[0]], "state": [name], "trips": [trips], "refused": [refused]})

    return fold


def breaker_stream(events: DataFrame, failures: int = 5, open_s: int = 60, successes: int = 3, timers: bool = False) -> DataFrame:
    """Breaker state of each key after each micro-batch; events have key, at (seconds), tie and ok.

    With `timers`, an open breaker without events becomes half open after `open_s` seconds of processing time, and says so.
    """
    return events.groupBy("key").applyInPandasWithState(
        _breaker_fold(failures, open_s, successes, timers), "key long, state string, trips long, refused long", "state string, f long, s long, opened long, trips long, refused long",
        "update", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout,
    )


def _health_fold(unhealthy: int, recover: int, recent_s: int, timers: bool):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f, s, last, n, lost, now = state.get if state.exists else (0, 0, None, 0, 0, 0)
        if state.hasTimedOut:
            now += recent_s
        else:
            for at, ok in _events(batches)[["at", "ok"]].itertuples(index=False):
                f, s, n, lost, now = (0 if ok else f + 1), (s + 1 if ok else 0), n + 1, lost + (not ok), int(at)
                last = (None if s >= recover else last) if ok else int(at)
        degraded = f > 0 and last is not None and now - last < recent_s
        health = "Unhealthy" if f >= unhealthy else "Degraded" if degraded else "Healthy"
        state.update((f, s, last, n, int(lost), now))
        if timers and health == "Degraded":
            state.setTimeoutDuration(max(1, recent_s * 1000))
        yield pd.DataFrame({"key": [key[0]], "health": [health], "consecutive_failures": [f], "requests": [n], "failures": [int(lost)]})

    return fold


def health_stream(events: DataFrame, unhealthy: int = 3, recover: int = 5, recent_s: int = 60, timers: bool = False) -> DataFrame:
    """Health of each key after each micro-batch, by the rules of `operators.health.key_health`; events as for `breaker_stream`.

    With `timers`, a Degraded key without events is Healthy after `recent_s` seconds of processing time, and says so.
    """
    return events.groupBy("key").applyInPandasWithState(
        _health_fold(unhealthy, recover, recent_s, timers), "key long, health string, consecutive_failures long, requests long, failures long", "f long, s long, last long, n long, lost long, now long",
        "update", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout,
    )


def _cache_fold(capacity: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}  # the one used longest ago first
        out = []
        for at, tie, name, value in _events(batches)[["at", "tie", "name", "value"]].itertuples(index=False):
            hit, gone = name in held, None
            old = held.pop(name, None)
            if value is not None or hit:
                held[name] = value if value is not None else old
            if len(held) > capacity:
                gone = next(iter(held))
                del held[gone]
            out.append((key[0], int(at), int(tie), name, held.get(name), hit, gone))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["shard", "at", "tie", "name", "value", "hit", "evicted"])

    return fold


def cache_stream(events: DataFrame, capacity: int = 10_000) -> DataFrame:
    """An LRU cache of bounded capacity for each shard: value, hit and evicted name of each event.

    events: shard, at, tie, name, value; a null value is a look-up, which counts as a use, and another value is put.
    """
    return events.groupBy("shard").applyInPandasWithState(
        _cache_fold(capacity), "shard long, at long, tie long, name string, value string, hit boolean, evicted string", "names array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout,
    )


def _ring_fold(most: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        new = _events(batches)["value"].tolist()
        n, held = n + len(new), (held + new)[-most:]
        state.update((n, held))
        ordered = sorted(held)
        at = lambda p: ordered[int((len(ordered) - 1) * p)]
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [sum(held) // len(held)], "p50": [at(0.5)], "p95": [at(0.95)], "p99": [at(0.99)]})

    return fold


def ring_stream(samples: DataFrame, most: int = 10_000) -> DataFrame:
    """Count of all samples, and integer mean and percentiles of the last `most`, of each key after each micro-batch; samples have key, at, tie and value."""
    return samples.groupBy("key").applyInPandasWithState(
        _ring_fold(most), "key long, n long, mean long, p50 long, p95 long, p99 long", "n long, held array<long>", "update", GroupStateTimeout.NoTimeout,
    )


class DirtyFlush:
    """For foreachBatch: keeps micro-batches in a folder and hands them on together, when some are kept and `interval_s` has passed since
    the last time; `close` hands on what is left.

    `write` gets all kept rows with their `batch`. A batch that is run again replaces its rows, and a batch may be handed on again after a
    failure, so `write` must be an upsert.
    """

    def __init__(self, spark: SparkSession, folder: str, write: Callable[[DataFrame], None], interval_s: float, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.write, self.interval_s, self.clock = spark, folder.rstrip("/"), write, interval_s, clock
        self.dirty, self.last = False, clock()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
            self.dirty = True
        if self.dirty and self.clock() - self.last >= self.interval_s:
            self.flush()

    def flush(self) -> None:
        self.write(self.spark.read.parquet(self.folder))
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.dirty, self.last = False, self.clock()

    def close(self) -> None:
        if self.dirty:
            self.flush()


def flush_every(df: DataFrame, write: Callable[[DataFrame, int], None], seconds: int, checkpoint: str) -> StreamingQuery:
    """A query that hands each micro-batch to `write`, at the given interval; end it with `stop_flushed`."""
    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def stop_flushed(query: StreamingQuery, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Stops a query once all that is there has been handed on, and closes a `DirtyFlush`."""
    query.processAllAvailable()
    query.stop()
    if isinstance(write, DirtyFlush):
        write.close()
