"""Batch analytics: counters, the lower nearest-rank percentile, integer means and text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile(values: Column, p: float) -> Column:
    """Of a sorted array: the value at trunc((n - 1) * p); 0 if empty."""
    at = ((F.size(values) - 1) * F.lit(p)).cast("int")
    return F.when(F.size(values) > 0, F.get(values, at)).otherwise(F.lit(0))


def integer_mean(value: Column | str) -> Column:
    """Aggregate: sum div count; 0 if empty."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.floor(F.sum(v) / F.nullif(F.count(v), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(F.lit(0.0))


def percentage(part: Column, total: Column, digits: int = 1) -> Column:
    return F.when(total > 0, F.round(part * 100.0 / total, digits))


def region_counts(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions in all, by label, and by background, of each key."""
    return regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_regions"), *[F.count_if(F.col("label") == k).alias(f"n_label_{k}") for k in (0, 1, 2)],
        F.count_if(F.col("background_type") == "Simple").alias("n_simple"), F.count_if(F.col("background_type") != "Simple").alias("n_complex"),
    )


def api_calls(pages: DataFrame) -> DataFrame:
    """Derived calls: one for simple regions if there are any, one for each page with complex ones, one for each image."""
    return pages.agg(F.max(F.when(F.col("n_simple") > 0, 1).otherwise(0)).cast("long").alias("api_calls_simple"), F.sum(F.when(F.col("n_complex") > 0, 1).otherwise(0)).cast("long").alias("api_calls_complex"), F.sum("n_images").cast("long").alias("api_calls_images"))


def exposition(counters: DataFrame, name: str, value: str, prefix: str = "") -> DataFrame:
    """One line `name {} value` for each counter row, as text scrapers read it."""
    return counters.select(F.format_string(f"{prefix}%s {{}} %d", F.col(name), F.col(value)).alias("line"))


def call_summary(calls: DataFrame, latency: str, ok: Column, most: int = 10_000, order: list[Column] | None = None) -> DataFrame:
    """Calls, failures, integer mean and p50/p95/p99 of the latencies of the last `most` samples.

    The sample buffer bounds what one row holds.
    """
    counts = calls.agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))
    recent = calls.orderBy(*(order or [])).limit(most) if order else calls
    stats = recent.agg(integer_mean(latency).alias("mean"), F.sort_array(F.collect_list(latency)).alias("__v"))
    stats = stats.select("mean", *[percentile(F.col("__v"), p).cast("long").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])
    return counts.crossJoin(stats)  # one row each


def saturating(whole: Column, part: Column) -> Column:
    """whole - part, 0 at least: the estimate of cache hits from regions and translations."""
    return F.greatest(whole - part, F.lit(0).cast("long"))


def merged(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Additive merge of metric rows: the sum of every other column, 0 where all are null."""
    values = [c for c in rows.columns if c not in (keys or [])]
    return rows.groupBy(*(keys or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values])


def key_statistics(health: DataFrame) -> DataFrame:
    """One row: keys, healthy keys, requests, failures and failure rate of a pool, from rows of `health.key_health`."""
    requests, failures = F.coalesce(F.sum("requests"), F.lit(0)), F.coalesce(F.sum("failures"), F.lit(0))
    rate = F.when(requests > 0, failures / requests).otherwise(F.lit(0.0))
    return health.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("health") == "Healthy").alias("healthy_keys"), requests.alias("requests"), failures.alias("failures"), rate.alias("failure_rate"))


#: Fields of a snapshot in their order.
SNAPSHOT = (
    "api_calls_total", "api_calls_success", "api_calls_failed", "api_tokens_input", "api_tokens_output", "api_latency_avg_ms", "api_latency_p50_ms", "api_latency_p95_ms", "api_latency_p99_ms",
    "cache_hits", "cache_misses", "cache_hit_rate", "cache_size", "phase1_avg_ms", "phase2_avg_ms", "phase3_avg_ms", "phase4_avg_ms", "batches_processed", "images_processed", "circuit_breaker_trips", "uptime_seconds",
)
SAMPLES = 10_000


def snapshot(samples: DataFrame) -> DataFrame:
    """One row of the fields of `SNAPSHOT`, from samples of a service.

    samples: at (seconds), seq (orders samples of a second), kind, value, ok, tokens_in, tokens_out. Kinds: `api` (value: latency in ms), `cache` (ok: a hit),
    `cache_size`, `phase1` to `phase4` (value: ms), `batch` (value: images), `trip`, `start`. Latencies and phases count by their last 10,000 samples
    each; counters count all. Counters are one partial aggregate; what one row holds is bounded by the sample rings.
    """
    kind, value = F.col("kind"), F.col("value")
    of = lambda name: F.when(kind == name, value)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counters = samples.agg(
        F.count_if(kind == "api").alias("api_calls_total"), F.count_if((kind == "api") & F.col("ok")).alias("api_calls_success"), F.count_if((kind == "api") & ~F.coalesce("ok", F.lit(False))).alias("api_calls_failed"),
        zero(F.sum(F.when(kind == "api", F.col("tokens_in")))).alias("api_tokens_input"), zero(F.sum(F.when(kind == "api", F.col("tokens_out")))).alias("api_tokens_output"),
        F.count_if((kind == "cache") & F.col("ok")).alias("cache_hits"), F.count_if((kind == "cache") & ~F.coalesce("ok", F.lit(False))).alias("cache_misses"),
        zero(F.max_by(of("cache_size"), F.when(kind == "cache_size", F.struct("at", "seq")))).alias("cache_size"),
        F.count_if(kind == "batch").alias("batches_processed"), zero(F.sum(of("batch"))).alias("images_processed"), F.count_if(kind == "trip").alias("circuit_breaker_trips"),
        zero(F.max("at") - F.min(F.when(kind == "start", F.col("at")))).alias("uptime_seconds"),
    )
    out = counters.withColumn("cache_hit_rate", hit_rate(F.col("cache_hits"), F.col("cache_misses")))
    for name, field in (("api", "api_latency"), *((f"phase{i}", f"phase{i}") for i in (1, 2, 3, 4))):
        ring = samples.filter(kind == name).orderBy(F.desc("at"), F.desc("seq")).limit(SAMPLES)
        values = F.sort_array(F.collect_list("value"))
        got = [integer_mean("value").alias(f"{field}_avg_ms")]
        if name == "api":
            got += [percentile(values, p).cast("long").alias(f"{field}_p{int(p * 100)}_ms") for p in (0.5, 0.95, 0.99)]
        out = out.crossJoin(ring.agg(*got))  # one row each
    return out.select(*SNAPSHOT)


#: Families of the exposition: name, help, type, and (label, snapshot field) of each line.
FAMILIES = (
    ("api_calls_total", "Total number of API calls made", "counter", (("", "api_calls_total"),)),
    ("api_calls_success", "Number of successful API calls", "counter", (("", "api_calls_success"),)),
    ("api_calls_failed", "Number of failed API calls", "counter", (("", "api_calls_failed"),)),
    ("api_tokens_input_total", "Total input tokens consumed", "counter", (("", "api_tokens_input"),)),
    ("api_tokens_output_total", "Total output tokens generated", "counter", (("", "api_tokens_output"),)),
    ("api_latency_avg_ms", "Average API latency in milliseconds", "gauge", (("", "api_latency_avg_ms"),)),
    ("cache_hit_rate", "Cache hit rate (0.0 to 1.0)", "gauge", (("", "cache_hit_rate"),)),
    ("cache_size", "Current cache size", "gauge", (("", "cache_size"),)),
    ("phase_avg_duration_ms", "Average phase duration in milliseconds", "gauge", tuple((f'phase="{i}"', f"phase{i}_avg_ms") for i in (1, 2, 3, 4))),
    ("batches_processed_total", "Total number of batches processed", "counter", (("", "batches_processed"),)),
    ("images_processed_total", "Total number of images processed", "counter", (("", "images_processed"),)),
    ("circuit_breaker_trips_total", "Total circuit breaker trips", "counter", (("", "circuit_breaker_trips"),)),
    ("uptime_seconds", "Application uptime in seconds", "counter", (("", "uptime_seconds"),)),
)


def number_text(value: Column) -> Column:
    """A number as text, a whole one without a fraction."""
    whole = value.cast("long")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def exposition_text(snap: DataFrame) -> DataFrame:
    """(text): all families of a snapshot with HELP and TYPE, an empty line between families."""
    lines = []
    for name, said, kind, fields in FAMILIES:
        lines += [F.lit(f"# HELP {name} {said}\n# TYPE {name} {kind}\n")]
        lines += [F.concat(F.lit(f"{name} {{{label}}} "), number_text(F.col(field)), F.lit("\n")) for label, field in fields]
        lines += [F.lit("\n")] if name != FAMILIES[-1][0] else []
    return snap.select(F.concat(*lines).alias("text"))


def stats_json(snap: DataFrame) -> DataFrame:
    """(value): a snapshot as one JSON object."""
    return snap.select(F.to_json(F.struct(*SNAPSHOT)).alias("value"))


def phase_shares(analytics: DataFrame, keys: list[str]) -> DataFrame:
    """Each phase's time and its percentage of all four; null without any time."""
    phases = [f"phase{i}_time_ms" for i in (1, 2, 3, 4)]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in phases[1:]), F.coalesce(phases[0], F.lit(0.0)))
    return analytics.select(*keys, *phases, *[percentage(F.col(c), total).alias(c.replace("_time_ms", "_share")) for c in phases])
