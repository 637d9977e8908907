"""Health of keys and circuit breakers over ordered events.

Event time stands for the clock. Health is counted by partial aggregates, so a key of any share of the events is spread over
tasks. A breaker's next state depends on the one before, so its events stream through one task, sorted there, in bounded
memory. The streaming forms are in `leafmill.streaming`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def key_health(events: DataFrame, key: str, at: str, tie: str, ok: Column, now: Column | None = None, unhealthy: int = 3, recover: int = 5, recent_s: int = 60) -> DataFrame:
    """requests, failures, failure rate, consecutive failures and successes, last failure (unless forgotten) and health of each key.

    `unhealthy` consecutive failures make a key Unhealthy; a failure less than `recent_s` seconds ago
    with a consecutive failure, Degraded; `recover` consecutive successes forget the last failure. `at` is
    in seconds; `now` defaults to the key's last event.
    """
    good = F.coalesce(ok, F.lit(False))
    rows = events.select(F.col(key).alias("__k"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), good.alias("ok")).alias("__e"))
    win = F.col("__e.ok")
    marks = rows.groupBy("__k").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~win).alias("failures"), F.max("__e.at").alias("__clock"),
        F.max(F.when(win, F.col("__e"))).alias("__won"), F.max(F.when(~win, F.col("__e"))).alias("__lost"),
    )
    # What came after the last success, or after the last failure, is a run; only those rows are counted.
    after = lambda mark: F.count_if(F.coalesce(F.col("__e") > F.col(mark), F.lit(True)))
    of_row = rows.withColumnRenamed("__k", "__key")
    runs = of_row.join(marks, F.col("__key").eqNullSafe(F.col("__k"))).groupBy(F.col("__key").alias("__run")).agg(after("__won").alias("consecutive_failures"), after("__lost").alias("consecutive_successes"))
    out = marks.join(runs, F.col("__k").eqNullSafe(F.col("__run")))
    last = F.when(F.col("consecutive_successes") < recover, F.col("__lost.at"))
    clock = now if now is not None else F.col("__clock")
    bad = F.col("consecutive_failures")
    health = F.when(bad >= unhealthy, "Unhealthy").when((bad > 0) & (clock - last < recent_s), "Degraded").otherwise("Healthy")
    return out.select(F.col("__k").alias(key), "requests", "failures", (F.col("failures") / F.col("requests")).alias("failure_rate"), "consecutive_failures", "consecutive_successes", last.alias("last_failure"), health.alias("health"))


class Breaker:
    """A breaker's state, moved over arrays of event times and outcomes by jumps from one change of state to the next."""

    def __init__(self, failures: int, open_s: int, successes: int, state: tuple = ("Closed", 0, 0, 0, 0, 0)):
        self.failures, self.open_s, self.successes = failures, open_s, successes
        self.name, self.f, self.s, self.opened, self.trips, self.refused = state

    def state(self) -> tuple:
        return self.name, self.f, self.s, self.opened, self.trips, self.refused

    def trip(self, at: int) -> None:
        self.name, self.f, self.s, self.opened, self.trips = "Open", 0, 0, at, self.trips + 1

    def run(self, at: np.ndarray, ok: np.ndarray) -> None:
        n = len(at)
        bad = np.flatnonzero(~ok)
        since = np.arange(n) - np.maximum.accumulate(np.where(ok, np.arange(n), -1))  # failures in a row up to here
        full = np.flatnonzero(since >= self.failures)
        p = 0
        while p < n:
            if self.name == "Open":
                q = p + int(np.searchsorted(at[p:], self.opened + self.open_s))
                self.refused += q - p
                if q < n:
                    self.name, self.s = "HalfOpen", 0
                p = q
            elif self.name == "HalfOpen":
                k = np.searchsorted(bad, p)
                first = int(bad[k]) if k < len(bad) else n
                need = p + self.successes - self.s  # where it closes if nothing fails before
                if first < min(need, n):
                    self.trip(int(at[first]))
                    p = first + 1
                elif need <= n:
                    self.name, self.f, self.s, p = "Closed", 0, 0, need
                else:
                    self.s, p = self.s + n - p, n
            else:
                ahead = self.failures - self.f  # failures in a row from here, on top of those before
                hit = p + ahead - 1
                if not (hit < n and since[hit] >= ahead):
                    k = np.searchsorted(full, p + self.failures - 1)
                    hit = int(full[k]) if k < len(full) else n
                if hit < n:
                    self.trip(int(at[hit]))
                    p = hit + 1
                else:
                    run = int(since[n - 1]) if not ok[n - 1] else 0
                    self.f = self.f + n - p if run >= n - p else run
                    p = n


def _broken(failures: int, open_s: int, successes: int):
    def run(batches):
        held = None  # (key, breaker) of the key that the batches are in
        names = ("state", "trips", "refused")

        def out(done: list) -> pa.RecordBatch:
            states = [b.state() for _, b in done]
            return pa.record_batch([pa.array([k for k, _ in done], key_type), pa.array([s[0] for s in states], pa.string()), pa.array([s[4] for s in states], pa.int64()), pa.array([s[5] for s in states], pa.int64())], names=["k", *names])

        key_type = None
        for batch in batches:
            keys, key_type, done = batch.column(0), batch.schema.field(0).type, []
            code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            at, ok = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)]), len(code)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = keys[a].as_py()
                if held is None or held[0] != k:
                    done += [held] if held else []
                    held = (k, Breaker(failures, open_s, successes))
                held[1].run(at[a:b], ok[a:b])
            if done:
                yield out(done)
        if held:
            yield out([held])

    return run


def breaker(events: DataFrame, key: str, at: str, tie: str, ok: Column, failures: int = 5, open_s: int = 60, successes: int = 3) -> DataFrame:
    """Final state, trips and refused requests of each key's circuit breaker.

    Closed opens after `failures` consecutive failures. A request to an open breaker is refused, until
    `open_s` seconds after it opened, when it becomes half open. Half open, `successes` successes close
    it, and a failure opens it again.
    """
    rows = events.select(F.col(key).alias("k"), F.col(at).cast("long").alias("at"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col(tie).alias("tie"))
    rows = rows.filter("at is not null").repartition(F.col("k")).sortWithinPartitions("k", "at", "tie", "ok").select("k", "at", "ok")
    kind = rows.schema["k"].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("state", T.StringType()), T.StructField("trips", T.LongType()), T.StructField("refused", T.LongType())])
    return rows.mapInArrow(_broken(failures, open_s, successes), schema).withColumnRenamed("k", key)
