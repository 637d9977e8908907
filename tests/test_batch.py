"""The whole page pipeline on two pages."""

import json

from pyspark.sql import functions as F

from leafmill.plans import batch


def tables(spark):
    det = spark.createDataFrame([(0, 0, 0, 0, 0, 100, 100, 0.9), (0, 1, 1, 10, 10, 40, 40, 0.8), (0, 2, 1, 90, 90, 120, 120, 0.8), (0, 3, 2, 0, 200, 50, 220, 0.9), (1, 0, 0, 0, 0, 50, 50, 0.9), (1, 1, 1, 5, 5, 20, 20, 0.2)], "page_index long, bubble_index int, label int, x1 int, y1 int, x2 int, y2 int, score double")
    readings = spark.createDataFrame([(0, 0, 1, "world", 0.9), (0, 0, 0, "hello", 0.9), (0, 1, 0, "ab", 0.9), (0, 1, 1, "side text", 0.9), (1, 10000, 0, "known text", 0.8), (1, 10000, 1, "noise", 0.3)], "page_index long, region_id long, pos int, text string, confidence double")
    cache = spark.createDataFrame([("known text", "bekannt")], "original_text string, translated_text string").withColumn("key", F.md5("original_text"))
    responses = spark.createDataFrame([(0, 0, "hallo welt")], "page_index long, region_id long, translated_text string")
    return det, readings, cache, responses


def test_batch(spark):
    det, readings, cache, responses = tables(spark)
    s = batch.process(det, readings, cache, responses, batch.Options())
    assert sorted((r.region_id, r.label, r.background_type) for r in s.regions.collect()) == [(0, 0, "Simple"), (1, 1, "Complex"), (10000, 0, "Complex")]
    assert sorted((r.page_index, r.bubble_index, r.warning) for r in s.warnings.collect()) == [(0, 2, "orphan"), (0, 2, "partial overlap"), (1, 0, "no child")]
    got = {r.region_id: (r.original_text, r.translated_text, r.origin) for r in s.translated.collect()}
    assert got == {0: ("hello\nworld", "hallo welt", "new"), 1: ("side text", "side text", "new"), 10000: ("known text", "bekannt", "cached")}
    assert sorted((r.region_id, r.display_number) for r in s.requests.collect()) == [(0, 1), (1, 2)]
    assert {r.original_text for r in batch.updated_cache(cache, s).collect()} == {"hello\nworld", "side text", "known text"}
    pages = spark.createDataFrame([(0, "a.png", bytearray(b"x"), None, 4.0), (1, "b.png", None, "broken", 2.0)], "page_index long, filename string, content binary, error string, ms double")
    out = {r.page_index: (json.loads(r.result), r.texts) for r in batch.results(pages, s).collect()}
    assert out[0][0]["success"] and out[0][0]["data_url"].startswith("data:image/png;base64,") and out[0][1] == ["hallo welt", "side text"]
    assert out[1][0]["error"] == "broken" and "data_url" not in out[1][0] and out[1][1] == ["bekannt"]
    a = batch.analytics(pages, s).first()
    assert (a.total, a.failed, a.mean_ms, a.label_0, a.label_1, a.label_2, a.validation_warnings, a.cache_hits, a.cache_misses) == (2, 1, 3.0, 2, 1, 0, 3, 1, 2)


def test_options(spark):
    det, readings, cache, responses = tables(spark)
    s = batch.process(det, readings, cache, responses, batch.Options(confidence=0.1, keep_orphans=False, include_free_text=True, use_cache=False))
    assert sorted((r.region_id, r.label) for r in s.regions.collect()) == [(0, 0), (1, 2), (10000, 0)]
    assert s.cached.count() == 0 and {r.origin for r in s.translated.collect()} == {"new"}
