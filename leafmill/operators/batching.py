"""Chunks, two-level batches and display numbers over an ordered list of rows.

The numbering of a whole table needs its order: ranks are counted by range partition and the few partition
totals are summed, instead of one window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """0-based place of each row in the order (which must be total), without a single-task window.

    Rows are range-partitioned by the order; places are the row numbers in the partition plus the rows of
    the partitions before, of which there is one total each.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    out = dealt.withColumn(name, within)
    return out.join(F.broadcast(before), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def chunk(place: Column, size: int) -> Column:
    """Number of the chunk of `size` rows."""
    return F.floor(place / F.lit(size)).cast("long")


def ceil_div(a: Column, b: Column | int) -> Column:
    return F.ceil(a / (b if isinstance(b, Column) else F.lit(b))).cast("long")


def two_level(df: DataFrame, place: str, total: Column, keys: int, reuse: int) -> DataFrame:
    """key_chunk, sub_chunk and display_number: rows are cut for `keys` keys, and each cut `reuse` times."""
    per_key = F.greatest(ceil_div(total, keys), F.lit(1))
    key = F.floor(F.col(place) / per_key)
    length = F.least(per_key, total - key * per_key)
    per_sub = F.greatest(ceil_div(length, reuse), F.lit(1))
    sub = F.floor((F.col(place) - key * per_key) / per_sub)
    return df.withColumns({"key_chunk": key.cast("long"), "sub_chunk": sub.cast("long"), "display_number": (F.col(place) + 1).cast("long")})


def round_robin(place: Column, n: int) -> Column:
    """Key of each pick among n healthy keys."""
    return F.pmod(place, F.lit(n)).cast("long")


def retry_delays(attempts: int, limited: Column | bool = False, base_ms: int = 1000, limit_ms: int = 10_000) -> Column:
    """Delay before each retry in ms, without jitter: doubling, or `limit_ms` after a rate limit."""
    limited = limited if isinstance(limited, Column) else F.lit(limited)
    return F.transform(F.sequence(F.lit(0), F.lit(attempts)), lambda i: F.when(limited, F.lit(limit_ms)).otherwise(F.pow(F.lit(2), i) * base_ms).cast("long"))


def capped_delays(attempts: int, first_ms: int = 1000, most_ms: int = 10_000) -> Column:
    """Doubling delays with a cap."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.pow(F.lit(2), i) * first_ms, F.lit(most_ms)).cast("long"))


def jittered_delays(attempts: int, limited: Column, *seed: Column, base_ms: int = 1000, limit_ms: int = 10_000) -> Column:
    """As `retry_delays`, with 0 to 999 ms added to the doubling delays, by a hash of the seed and the attempt: retries of a task agree."""
    jitter = lambda i: F.pmod(F.xxhash64(*seed, i), F.lit(1000))
    return F.transform(F.sequence(F.lit(0), F.lit(attempts)), lambda i: F.when(limited, F.lit(limit_ms)).otherwise(F.pow(F.lit(2), i) * base_ms + jitter(i)).cast("long"))


def tiers(keys: DataFrame, key: str, health: str, idle_s: Column, recover_s: int = 60) -> DataFrame:
    """The keys that a pick may take, with `slot` and `slots`: the Healthy ones; without any, the Degraded ones; without any, the
    Unhealthy ones whose last failure is more than `recover_s` seconds ago (or unknown). There may be none.

    A pool has few keys (it is configuration), so its window is one small task.
    """
    tier = F.when(F.col(health) == "Healthy", 0).when(F.col(health) == "Degraded", 1).when(F.coalesce(idle_s > recover_s, F.lit(True)), 2)
    best = Window.partitionBy()
    ranked = keys.withColumn("__tier", tier).filter("__tier is not null").withColumn("__best", F.min("__tier").over(best)).filter("__tier = __best")
    return ranked.select(key, (F.row_number().over(best.orderBy(key)) - 1).cast("long").alias("slot"), F.count(F.lit(1)).over(best).alias("slots"))


def picked(requests: DataFrame, place: str, pool: DataFrame, key: str) -> DataFrame:
    """requests with the key that each takes in turn from a pool of `tiers`; null if it has none. `place` numbers them from 0."""
    size = pool.agg(F.count(F.lit(1)).alias("__slots"))
    turn = requests.crossJoin(F.broadcast(size)).withColumn("__slot", F.when(F.col("__slots") > 0, F.pmod(F.col(place), F.col("__slots"))))  # one row
    return turn.join(F.broadcast(pool.select(F.col(key).alias("picked"), F.col("slot").alias("__at"))), F.col("__slot") == F.col("__at"), "left").drop("__slots", "__slot", "__at")


def failover(attempts: DataFrame, request: str, turn: str, ok: Column, most: Column) -> DataFrame:
    """Outcome of each request over its attempts, at most `most` (the number of keys): tries, whether one succeeded, and the turn that did.

    Attempts after the first success, or beyond the bound, were never made.
    """
    made = attempts.filter(F.col(turn) < most)
    first = F.min(F.when(ok, F.col(turn)))
    out = made.groupBy(request).agg(first.alias("winner"), F.count(F.lit(1)).alias("__n"))
    return out.select(request, F.coalesce(F.col("winner") + 1, F.col("__n")).cast("long").alias("tries"), F.col("winner").isNotNull().alias("succeeded"), F.col("winner").cast("long").alias("winner"))
