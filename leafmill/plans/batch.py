"""The whole page pipeline as one plan: detections and cache in, page results and analytics out.

Model outputs (detections, child texts, translations) are input tables. Failed pages stay, with
their error. Work is decided before anything costly: cached regions are split off by key first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, quality_gate
from ..operators import batching, exchange, metrics, regions
from ..sources.writers import page_result


@dataclass(frozen=True)
class Options:
    """Request options after their defaults are resolved."""

    confidence: float = 0.3
    keep_orphans: bool = True
    include_free_text: bool = False
    use_cache: bool = True
    keys: int = 1
    reuse_factor: int = 4


@dataclass
class Stages:
    """What each phase gives."""

    regions: DataFrame
    warnings: DataFrame
    texts: DataFrame
    cached: DataFrame
    requests: DataFrame
    translated: DataFrame


def warnings(det: DataFrame) -> DataFrame:
    """(page_index, bubble_index, warning): partial overlaps, parents without children, orphans."""
    return regions.with_warnings(det).select("page_index", "bubble_index", F.explode("warnings").alias("warning"))


def process(det: DataFrame, readings: DataFrame, cache: DataFrame, responses: DataFrame, options: Options = Options()) -> Stages:
    """One batch of pages.

    det: page_index, bubble_index, label, x1, y1, x2, y2, score. readings: page_index, region_id, pos,
    text, confidence. cache: key (of the joined text), translated_text. responses: page_index,
    region_id, translated_text; a region without a response keeps its own text.
    """
    det = regions.confident(det, options.confidence)
    found = regions.categorised(det, keep_orphans=options.keep_orphans, include_free_text=options.include_free_text)
    good = readings.filter(quality_gate("text", "confidence") & not_blank("text"))
    texts = exchange.joined_text(good, ["page_index", "region_id"], ["pos"], "text").withColumnRenamed("joined", "original_text")
    texts = texts.join(found.select("page_index", "region_id", "background_type"), ["page_index", "region_id"])
    keyed = texts.withColumn("key", F.md5("original_text"))
    known = cache if options.use_cache else cache.limit(0)
    cached = exchange.cache_hits(keyed, known.select("key", "translated_text"), "key")
    work = exchange.cache_misses(keyed, known, "key")
    total = work.agg(F.count(F.lit(1)).alias("n"))
    placed = batching.ordinal(work, ["page_index", "region_id"]).crossJoin(F.broadcast(total))  # total is one row
    requests = batching.two_level(placed, "ord", F.col("n"), options.keys, options.reuse_factor).drop("ord", "n")
    new = exchange.with_fallback(work, responses, ["page_index", "region_id"], "translated_text", F.col("original_text"))
    columns = ["page_index", "region_id", "background_type", "key", "original_text", "translated_text"]
    translated = cached.select(*columns, F.lit("cached").alias("origin")).unionByName(new.select(*columns, F.lit("new").alias("origin")))
    return Stages(found, warnings(det), texts, cached, requests, translated)


def updated_cache(cache: DataFrame, stages: Stages) -> DataFrame:
    """The cache with the new translations put over it."""
    new = exchange.last_write(stages.translated.filter("origin = 'new'"), ["key"], ["page_index", "region_id"], ["original_text", "translated_text"])
    return exchange.upsert(cache.select("key", "original_text", "translated_text"), new, ["key"], ["original_text", "translated_text"])


def results(pages: DataFrame, stages: Stages) -> DataFrame:
    """(page_index, result): JSON of every page. pages: page_index, filename, content, error, ms."""
    url = F.when(F.col("error").isNull(), F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("content"), r"\s", "")))
    lists = exchange.fan_in(pages, stages.translated, "page_index", ["region_id"], F.col("translated_text"), "texts")
    return lists.select("page_index", page_result("page_index", "filename", "error", url, F.col("ms")).alias("result"), "texts")


def analytics(pages: DataFrame, stages: Stages) -> DataFrame:
    """One row: pages, failures, regions by kind, warnings, cache hits, requests and mean time a page."""
    kind = lambda c: F.count_if(c)
    done = pages.agg(F.count(F.lit(1)).alias("total"), kind(F.col("error").isNull()).alias("successful"), kind(F.col("error").isNotNull()).alias("failed"), (F.coalesce(F.sum("ms"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_ms"))
    of_regions = stages.regions.agg(*[kind(F.col("label") == k).alias(f"label_{k}") for k in (0, 1, 2)], kind(F.col("background_type") == "Simple").alias("simple"), kind(F.col("background_type") != "Simple").alias("complex"))
    warned = stages.warnings.agg(F.count(F.lit(1)).alias("validation_warnings"))
    texts = stages.translated.agg(kind(F.col("origin") == "cached").alias("cache_hits"), kind(F.col("origin") == "new").alias("cache_misses"))
    out = done.crossJoin(of_regions).crossJoin(warned).crossJoin(texts)  # one row each
    return out.withColumn("hit_rate", metrics.hit_rate(F.col("cache_hits"), F.col("cache_misses")))


#: Fields of a batch's analytics in their order.
ANALYTICS = (
    "total_images", "total_regions", "simple_bg_count", "complex_bg_count", "label_0_count", "label_1_count", "label_2_count", "validation_warnings", "api_calls_simple", "api_calls_complex", "api_calls_banana",
    "input_tokens", "output_tokens", "cache_hits", "cache_misses", "phase1_time_ms", "phase2_time_ms", "phase3_time_ms", "phase4_time_ms", "total_time_ms", "inference_time_ms", "api_wait_time_ms",
)


def batch_analytics(pages: DataFrame, stages: Stages, timings: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """One row of the fields of `ANALYTICS`.

    timings: phase (1 to 4), ms; tokens: input_tokens, output_tokens, a row for each call. Inference and waiting times aren't measured and are 0, as are absent tables.
    """
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    by_page = metrics.region_counts(stages.regions, ["page_index"]).withColumn("n_images", zero)
    calls = metrics.api_calls(by_page).select(*[F.coalesce(c, zero).alias(c) for c in ("api_calls_simple", "api_calls_complex")], zero.alias("api_calls_banana"))
    kinds = stages.regions.agg(
        F.count(F.lit(1)).alias("total_regions"), F.count_if(F.col("background_type") == "Simple").alias("simple_bg_count"), F.count_if(F.col("background_type") != "Simple").alias("complex_bg_count"),
        *[F.count_if(F.col("label") == k).alias(f"label_{k}_count") for k in (0, 1, 2)],
    )
    origin = stages.translated.agg(F.count_if(F.col("origin") == "cached").alias("cache_hits"), F.count_if(F.col("origin") == "new").alias("cache_misses"))
    out = pages.agg(F.count(F.lit(1)).alias("total_images"), F.coalesce(F.sum("ms"), none).alias("total_time_ms"))
    out = out.crossJoin(kinds).crossJoin(calls).crossJoin(stages.warnings.agg(F.count(F.lit(1)).alias("validation_warnings"))).crossJoin(origin)  # one row each
    phase = lambda i: F.coalesce(F.sum(F.when(F.col("phase") == i, F.col("ms"))), none).alias(f"phase{i}_time_ms")
    out = out.crossJoin(timings.agg(*[phase(i) for i in (1, 2, 3, 4)])) if timings is not None else out.withColumns({f"phase{i}_time_ms": none for i in (1, 2, 3, 4)})
    used = ("input_tokens", "output_tokens")
    out = out.crossJoin(tokens.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in used])) if tokens is not None else out.withColumns({c: zero for c in used})
    return out.withColumns({"inference_time_ms": none, "api_wait_time_ms": none}).select(*ANALYTICS)


def batch_result(pages: DataFrame, page_results: DataFrame, analysed: DataFrame, most_pages: int = 10_000) -> DataFrame:
    """(value): a batch's response as one JSON object: totals, analytics, and the pages' results in the order of their index.

    page_results: page_index and result (JSON), as `results` gives them. One response holds one request's pages; more than `most_pages` are an error, so
    what one row holds is bounded.
    """
    done = pages.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("processing_time_ms"),
    ).withColumn("average_time_per_page_ms", F.col("processing_time_ms") / F.greatest("total", F.lit(1)))
    some = page_results.select("page_index", "result").limit(most_pages + 1).agg(F.array_sort(F.collect_list(F.struct("page_index", "result"))).alias("__all"))
    listed = F.array_join(F.transform("__all", lambda x: x["result"]), ",")
    listed = F.when(F.size("__all") <= most_pages, listed).otherwise(F.raise_error(F.lit(f"a batch has more than {most_pages} pages")).cast("string"))
    head = F.to_json(F.struct("total", "successful", "failed", "processing_time_ms", "average_time_per_page_ms"))
    row = done.crossJoin(analysed.select(F.to_json(F.struct(*ANALYTICS)).alias("__analytics"))).crossJoin(some)  # one row each
    return row.select(F.concat(F.regexp_replace(head, "[}]$", ""), F.lit(',"analytics":'), "__analytics", F.lit(',"results":['), listed, F.lit("]}")).alias("value"))
