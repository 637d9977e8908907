"""Settings, errors, streams, pixels and files against hand-worked values and plain Python."""

import json
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import errors, hashing, params, raster, text
from leafmill.operators import batching, health, metrics, regions, sequence
from leafmill.sources import readers, writers
from leafmill.streaming import pages


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


# ------------------------------------------------------------------------------------------ settings and errors


def test_settings_parse_or_default(tmp_path):
    s = params.Settings.from_env({
        "BANANA_MODE_ENABLED": "1", "ADAPTIVE_UPSCALE": "false", "TEXT_STROKE_ENABLED": "true", "BLUR_FREE_TEXT": " true", "MAX_RETRIES": " 4", "SERVER_PORT": "+80", "BLUR_RADIUS": "1_0", "CONFIDENCE_THRESHOLD": "5e-1",
        "LOG_LEVEL": "WARNING", "TEXT_ALIGNMENT": "justify", "INFERENCE_BACKEND": " cuda ", "GEMINI_API_KEYS": " a,\t,b ",
    })
    assert (s.banana_mode_enabled, s.adaptive_upscale, s.text_stroke_enabled, s.blur_free_text) == (False, False, True, False)
    assert (s.max_retries, s.server_port, s.blur_radius, s.confidence_threshold) == (3, 80, 10.0, 0.5)
    assert (s.log_level, s.text_alignment, s.inference_backend, s.gemini_api_keys) == ("warn", "center", "CUDA", ("a", "b"))
    assert params.Settings.from_env({"INFERENCE_BACKEND": " "}).inference_backend is None


@pytest.mark.parametrize(("given", "n"), [
    ({}, 0), ({"target_size": 319}, 1), ({"target_size": 2049}, 1), ({"target_size": 2048}, 0), ({"server_port": 0}, 0), ({"iou_threshold": float("nan")}, 1), ({"batch_size_n": 0, "api_batch_size_m": 0}, 2), ({"cache_dir": "/no/such/place/x"}, 1),
    ({"rate_limit_max_requests": 0}, 0), ({"rate_limit_enabled": True, "rate_limit_max_requests": 0, "rate_limit_window_seconds": 0}, 2), ({"upscale_factor": 11}, 1), ({"simple_bg_white_threshold": -0.1}, 1), ({"max_concurrent_batches": 0}, 1),
])
def test_settings_rules(given, n):
    assert len(params.Settings(**given).problems()) == n


def test_errors_have_context(spark):
    low = errors.PageError("NoBubbles", {"threshold": 0.3, "page_index": 4})
    assert str(low) == "No bubbles detected with confidence >= 0.3 (page 4)" and low.family == "detection"
    assert str(low.at(4)) == "Detection failed on page 4: " + str(low) and low.at(4).__cause__ is low
    keys = errors.PageError("AllKeysFailed", {"key_count": 2, "attempts": 3})
    assert str(keys.at(1, 5)) == "Translation failed for bubble 5 on page 1: All 2 API keys exhausted after 3 attempts"
    for bad in (lambda: low.at(1, 2), lambda: keys.at(1), lambda: errors.PageError("BatchFailed", {"reason": "x"}).at(1)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "k int, v int")
    got = errors.isolated(rows, {"InvalidBatchSize": (F.col("v") > 0, errors.error_text("InvalidBatchSize", value=F.coalesce(F.col("v").cast("string"), F.lit("none"))))})
    assert [tuple(r)[2:] for r in got.orderBy("k").collect()] == [(None, None), ("InvalidBatchSize", "Batch size must be > 0, got 0"), ("InvalidBatchSize", "Batch size must be > 0, got none")]


# ------------------------------------------------------------------------------------------ strings, keys and hashes


def test_font_sheet_goes_on_to_a_known_suffix(spark):
    css = "@font-face {\n  src: url('https://x.example/a.eot');\n  src: local('b');\n  src: url( \"https://x.example/a.ttf\" ) format('truetype');\n}"
    assert one(spark, text.css_font_url(F.lit(css))) == "https://x.example/a.ttf"
    assert one(spark, text.css_font_url(F.lit("src: url('a.eot')"))) is None
    assert one(spark, text.key_list(F.lit("\t a \n,　,b"))) == ["a", "b"]


def test_known_hashes(spark):
    """XXH3-64 of nothing and of a letter, as published; keys with a null part are null."""
    df = spark.createDataFrame([(b"",), (b"a",), (None,)], "b binary")
    got = [r[0] for r in df.select(hashing.xxh3("b")).collect()]
    assert [x % (1 << 64) if x is not None else None for x in got] == [0x2D06800538D394C2, 0xE6C632B61E964E1F, None]
    boxes = spark.createDataFrame([(got[1], b"a", 0, 0, 1, 1), (None, b"a", 0, 0, 1, 1), (got[1], None, 0, 0, None, 1)], "h long, b binary, x1 int, y1 int, x2 int, y2 int")
    cells = ("x1", "y1", "x2", "y2")
    keys = boxes.select(hashing.cache_key("h", *cells), hashing.region_key("b", *cells)).collect()
    assert keys[0][0] == hashing.cache_key_of(got[1], (0, 0, 1, 1)) and keys[1][0] is None and keys[1][1] is not None and tuple(keys[2]) == (None, None)


def test_picks_of_a_pool(spark):
    """Four picks of three healthy keys come round to the first; without a healthy key, one that may recover; within the minute, none."""
    requests = spark.createDataFrame([(i,) for i in range(4)], "n long")
    def picks(*keys):
        pool = batching.tiers(spark.createDataFrame(list(keys), "key string, health string, idle int"), "key", "health", F.col("idle"))
        return [r.picked for r in batching.picked(requests, "n", pool, "key").orderBy("n").collect()]
    assert picks(("a", "Healthy", 0), ("b", "Healthy", 0), ("c", "Healthy", 0), ("d", "Degraded", 0)) == ["a", "b", "c", "a"]
    assert picks(("a", "Unhealthy", 90), ("b", "Unhealthy", 10)) == ["a"] * 4
    assert picks(("a", "Unhealthy", 60), ("b", "Unhealthy", 10)) == [None] * 4
    assert picks(("a", "Unhealthy", None), ("b", "Degraded", 10)) == ["b"] * 4


def test_jitter_is_seeded(spark):
    a, b, c = one(spark, batching.jittered_delays(3, F.lit(False), F.lit(1)), batching.jittered_delays(3, F.lit(False), F.lit(1)), batching.jittered_delays(3, F.lit(False), F.lit(2)))
    assert a == b != c and all(0 <= x - 1000 * 2**i < 1000 for i, x in enumerate(a))
    assert one(spark, batching.jittered_delays(2, F.lit(True), F.lit(1))) == [10_000] * 3


# ------------------------------------------------------------------------------------------ health and breakers


def plain_health(oks):
    f = s = n = lost = 0
    last = None
    for at, ok in enumerate(oks):
        f, s, n, lost = (0 if ok else f + 1), (s + 1 if ok else 0), n + 1, lost + (not ok)
        last = (None if s >= 5 else last) if ok else at
    return n, lost, f, s, last, "Unhealthy" if f >= 3 else "Degraded" if f else "Healthy"


def test_key_health_like_a_fold(spark):
    rng = random.Random(6)
    runs = {k: [rng.random() < 0.7 for _ in range(rng.randrange(1, 30))] for k in range(40)} | {None: [False, True]}
    given = [(k, i, i, ok) for k, v in runs.items() for i, ok in enumerate(v)]
    df = spark.createDataFrame(given, "key long, at long, tie long, ok boolean").repartition(5)
    got = {r.key: (r.requests, r.failures, r.consecutive_failures, r.consecutive_successes, r.last_failure, r.health) for r in health.key_health(df, "key", "at", "tie", F.col("ok")).collect()}
    assert got == {k: plain_health(v) for k, v in runs.items()}


def test_breaker_jumps_like_single_steps():
    rng = random.Random(7)
    for _ in range(400):
        n, share = rng.randrange(1, 40), rng.random()
        at, ok = np.arange(n), np.array([rng.random() < share for _ in range(n)])
        settings = rng.randrange(1, 5), rng.randrange(0, 9), rng.randrange(1, 4)
        whole, single = health.Breaker(*settings), health.Breaker(*settings)
        cut = rng.randrange(n + 1)
        for part in (slice(0, cut), slice(cut, n)):
            whole.run(at[part], ok[part])
        for i in range(n):
            single.run(at[i : i + 1], ok[i : i + 1])
        assert whole.state()[4:] == single.state()[4:] and whole.name == single.name


def test_breaker_recovers_and_reopens():
    b = health.Breaker(2, 10, 2)
    steps = [(0, False, "Closed"), (1, False, "Open"), (2, True, "Open"), (12, True, "HalfOpen"), (13, True, "Closed"), (14, False, "Closed"), (15, False, "Open"), (26, False, "Open")]
    for at, ok, name in steps:
        b.run(np.array([at]), np.array([ok]))
        assert b.name == name
    assert (b.trips, b.refused) == (3, 1)


# ------------------------------------------------------------------------------------------ streams


def streamed(spark, tmp_path, df, parts, make, name):
    """Rows that a stream gives for the parts of df, a micro-batch each, in order."""
    folder = str(tmp_path / "in")
    for i, p in enumerate(parts):
        df.filter(p).coalesce(1).write.mode("append").parquet(f"{folder}/p={i}")
    stream = make(pages.event_stream(spark, folder, df.schema))
    q = stream.writeStream.outputMode("append" if name == "cached" else "update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [r.asDict() for r in spark.sql(f"select * from {name}").collect()]


def test_health_stream_like_the_batch_form(spark, tmp_path):
    rng = random.Random(8)
    given = [(k, i, i, rng.random() < 0.6) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(given, "key long, at long, tie long, ok boolean")
    rows = streamed(spark, tmp_path, df, ["tie < 12", "tie >= 12"], pages.health_stream, "healths")
    want = {r.key: (r.requests, r.health) for r in health.key_health(df, "key", "at", "tie", F.col("ok")).collect()}
    last = {}
    for r in rows:
        last[r["key"]] = max(last.get(r["key"], (0, "")), (r["requests"], r["health"]))
    assert last == want


def test_breaker_stream_states(spark, tmp_path):
    """Also the states, after each of two micro-batches: their rows come one batch after the other."""
    rng = random.Random(9)
    given = [(k, i * 7, i, rng.random() < 0.6) for k in range(8) for i in range(40)]
    df = spark.createDataFrame(given, "key long, at long, tie long, ok boolean")
    rows = [(r["key"], r["state"], r["trips"], r["refused"]) for r in streamed(spark, tmp_path, df, ["tie < 15", "tie >= 15"], lambda s: pages.breaker_stream(s, 2, 30, 2), "states")]
    assert len(rows) == 16
    for some, got in ((df.filter("tie < 15"), rows[:8]), (df, rows[8:])):
        want = [(r.key, r.state, r.trips, r.refused) for r in health.breaker(some, "key", "at", "tie", F.col("ok"), 2, 30, 2).collect()]
        assert sorted(got) == sorted(want)


def test_open_breaker_gets_half_open_by_a_timer(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 0, 0, False), (1, 1, 1, False)], "key long, at long, tie long, ok boolean")
    df.coalesce(1).write.parquet(folder)
    q = pages.breaker_stream(pages.event_stream(spark, folder, df.schema), 2, 1, 2, timers=True).writeStream.outputMode("update").format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end, states = time.monotonic() + 60, []
        while "HalfOpen" not in states and time.monotonic() < end:
            q.awaitTermination(1)
            states = [r.state for r in spark.sql("select state from timed").collect()]
    finally:
        q.stop()
    assert states[0] == "Open" and states[-1] == "HalfOpen"


def test_cache_stream_evicts_what_was_used_longest_ago(spark, tmp_path):
    steps = [("a", "1"), ("b", "2"), ("a", None), ("c", "3"), ("b", None), ("a", "9"), ("d", None), ("c", None)]
    df = spark.createDataFrame([(0, i, i, n, v) for i, (n, v) in enumerate(steps)], "shard long, at long, tie long, name string, value string")
    rows = streamed(spark, tmp_path, df, ["tie < 4", "tie >= 4"], lambda s: pages.cache_stream(s, 2), "cached")
    got = [(r["name"], r["value"], r["hit"], r["evicted"]) for r in sorted(rows, key=lambda r: r["at"])]
    assert got == [("a", "1", False, None), ("b", "2", False, None), ("a", "1", True, None), ("c", "3", False, "b"), ("b", None, False, None), ("a", "9", True, None), ("d", None, False, None), ("c", "3", True, None)]


def test_ring_stream_keeps_the_last(spark, tmp_path):
    df = spark.createDataFrame([(1, i, i, i * 10) for i in range(9)], "key long, at long, tie long, value long")
    rows = streamed(spark, tmp_path, df, ["tie < 5", "tie >= 5"], lambda s: pages.ring_stream(s, 4), "rings")
    assert max((r["n"], r["mean"], r["p50"], r["p99"]) for r in rows) == (9, 65, 60, 70)


def test_dirty_flush(spark, tmp_path):
    now, handed = [0.0], []
    flush = pages.DirtyFlush(spark, str(tmp_path / "kept"), lambda df: handed.append(sorted(r.v for r in df.collect())), 10, lambda: now[0])
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    flush(batch(1, 2), 0)
    flush(batch(1, 2), 0)  # the same batch again
    now[0] = 11
    flush(batch(3), 1)
    assert handed == [[1, 2, 3]] and not flush.dirty
    now[0] = 30
    flush(batch().limit(0), 2)  # nothing new: nothing to do
    flush(batch(4), 3)
    now[0] = 31
    flush(batch(5), 4)
    flush.close()
    flush.close()
    assert handed[1:] == [[4], [5]]


def test_flush_every_and_stop(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long").parquet(str(tmp_path / "in"))
    handed = []
    flush = pages.DirtyFlush(spark, str(tmp_path / "kept"), lambda df: handed.append(df.count()), 3600)
    pages.stop_flushed(pages.flush_every(stream, flush, 1, str(tmp_path / "c")), flush)
    assert handed == [2]


def test_page_stream_takes_images_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.PNG", "b.webp", "c.txt"):
        (folder / name).write_bytes(b"x")
    q = pages.page_stream(spark, str(folder), 1).select("path").writeStream.format("memory").queryName("images").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.path.rpartition("/")[2] for r in spark.sql("select * from images").collect()) == ["a.PNG", "b.webp"]


# ------------------------------------------------------------------------------------------ pixels


def test_resampling():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (9, 13, 3), dtype=np.uint8)
    for kernel, support in ((raster.triangle, 1.0), (raster.lanczos3, 3.0)):
        assert (raster.resample(image, 9, 13, kernel, support) == image).all()
        assert (raster.resample(np.full((9, 13, 3), 77, np.uint8), 5, 40, kernel, support) == 77).all()
    assert raster.resample(np.array([[0, 100]], np.uint8), 1, 1).tolist() == [[50]]
    ramp = np.repeat(np.arange(0, 200, 20, dtype=np.uint8)[None, :], 4, axis=0)
    assert (np.diff(raster.resample(ramp, 8, 25).astype(int), axis=1) >= 0).all()


def test_model_inputs():
    image = np.random.default_rng(3).integers(0, 256, (30, 50, 3), dtype=np.uint8)
    x = raster.chw(image, 64)
    assert x.shape == (3, 64, 64) and x.dtype == np.float32 and 0 <= x.min() and x.max() <= 1
    x, (h, w, scale) = raster.cleaner_input(image, 1000)
    assert (h, w) == (640, 1024) and x.shape == (3, 640, 1024) and scale == 20 and x.max() > 1
    assert raster.fitted_size(10, 10, 100) == (256, 256, 10.0)
    x, steps = raster.line_input(image)
    assert x.shape == (3, 60, 100) and steps == 25
    assert raster.line_input(np.zeros((600, 20, 3), np.uint8))[0].shape == (3, 60, 10)


def test_compositing():
    page = np.zeros((6, 6), np.uint8)
    part = np.full((3, 3), 9, np.uint8)
    pasted = raster.overlay(page, [(0, 0, part), (2, 2, part + 1), (5, 5, part)])
    assert pasted[2, 2] == 10 and pasted[5, 5] == 9 and pasted[0, 5] == 0
    assert raster.assemble((4, 4), [(0, 0, part), (1, 1, part - 5)])[1, 1] == 9 and raster.assemble((4, 4), []).sum() == 0
    assert raster.fill_white(np.zeros((2, 2, 3), np.uint8), np.array([[1, 0], [0, 0]])).sum() == 3 * 255
    framed = raster.outline(np.zeros((8, 8, 3), np.uint8), -5, 1, 20, 6, (1, 2, 3), 1)
    assert (framed[1] == (1, 2, 3)).all() and (framed[6] == (1, 2, 3)).all() and (framed[1:7, 0] == (1, 2, 3)).all() and framed[0].sum() == 0
    panel = raster.numbered_panel(np.zeros((4, 5, 3), np.uint8), 40)
    assert panel.shape == (4, 45, 3) and (panel[:, :38] == 255).all() and (panel[:, 38:40] == 200).all() and (panel[:, 40:] == 0).all()
    maps = [np.eye(3), np.ones((2, 2)) / 2]
    assert np.allclose(raster.combined(maps, 3, 3), np.maximum(np.eye(3), 0.5))
    stack = np.random.default_rng(4).random((5, 8, 8))
    masks = raster.mask_of(stack, 0.9)
    assert (raster.dilate(masks) == np.stack([raster.dilate(m) for m in masks])).all() and (raster.rotate_stack(masks) == np.stack([np.rot90(m) for m in masks])).all()
    assert np.allclose(raster.resize_bilinear(stack, 5, 9), np.stack([raster.resize_bilinear(m, 5, 9) for m in stack]))


def test_best_font_size():
    assert raster.best_font_size(lambda s: True, 7, 40) == 40
    assert raster.best_font_size(lambda s: False, 7, 40) == 6
    assert raster.best_font_size(lambda s: s <= 6.0, 9, 40) == 6
    for edge in np.arange(7, 40, 0.7):
        got = raster.best_font_size(lambda s, e=edge: s <= e, 7, 40)
        assert edge - 1 < got <= edge
    assert raster.best_font_size(lambda s: s <= 20 or 21.5 <= s <= 22.6, 7, 40) > 20  # a line break less


# ------------------------------------------------------------------------------------------ files and responses


def test_bad_images_keep_their_rows(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(raster.png(np.zeros((2, 3), np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {r.origin.rpartition("/")[2]: (r.width, r.error) for r in readers.decoded_images(spark, str(tmp_path)).collect()}
    assert got["good.png"] == (3, None) and got["bad.png"][0] is None and got["bad.png"][1]
    with pytest.raises(ValueError, match="No images"):
        readers.required(readers.image_files(spark, str(tmp_path)).filter("false"))


def test_written_images(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b.png", b"1"), (1, "a b.png", b"22"), (2, "../up.png", b"3"), (3, "none.png", None)], "index int, filename string, content binary").withColumn("data_url", text.data_url("content"))
    got = {r.filename: r.n_bytes for r in writers.write_images(df, str(tmp_path)).collect()}
    assert got == {"a_b.png": 1, "a_b_2.png": 2, "---up.png": 1, "none.png": None}
    assert {p.name: len(p.read_bytes()) for p in tmp_path.iterdir()} == {k: v for k, v in got.items() if v}


def test_cache_file_is_bounded(spark):
    entries = spark.range(5).select(F.col("id").alias("key"), F.lit("a").alias("original_text"), F.lit("b").alias("translated_text"))
    assert len(json.loads(writers.cache_json(entries, 5).first()[0])) == 5
    with pytest.raises(Exception, match="more than 4 entries"):
        writers.cache_json(entries, 4).collect()


def test_exposition_of_one_call(spark):
    rows = [(0, 0, "start", None, None, None, None), (5, 1, "api", 100, True, 500, 200), (6, 2, "api", 50, False, 0, 0), (6, 3, "cache", None, True, None, None), (6, 4, "cache", None, False, None, None), (7, 5, "batch", 10, None, None, None)]
    snap = metrics.snapshot(spark.createDataFrame(rows, "at long, seq long, kind string, value long, ok boolean, tokens_in long, tokens_out long"))
    r = snap.first()
    assert (r.api_calls_total, r.api_calls_success, r.api_calls_failed, r.api_tokens_input, r.api_tokens_output, r.cache_hit_rate, r.batches_processed, r.images_processed, r.uptime_seconds, r.api_latency_avg_ms) == (2, 1, 1, 500, 200, 0.5, 1, 10, 7, 75)
    said = metrics.exposition_text(snap).first()[0]
    assert "api_calls_total {} 2\n" in said and said.count("# TYPE") == 13 and 'phase_avg_duration_ms {phase="4"} 0\n' in said
    assert json.loads(metrics.stats_json(snap).first()[0])["cache_hit_rate"] == 0.5
    none = metrics.snapshot(spark.createDataFrame([], "at long, seq long, kind string, value long, ok boolean, tokens_in long, tokens_out long")).first()
    assert set(none.asDict().values()) == {0}


def test_page_boxes_like_joins(spark):
    rng = random.Random(5)
    given = [(rng.randrange(12), i, rng.randrange(3), x := rng.randrange(50), y := rng.randrange(50), x + rng.randrange(5, 60), y + rng.randrange(5, 60)) for i in range(150)]
    det = spark.createDataFrame(given, "page_index long, bubble_index int, label int, x1 int, y1 int, x2 int, y2 int")
    inside = lambda c, p: c[0] == p[0] and c[3] >= p[3] and c[4] >= p[4] and c[5] <= p[5] and c[6] <= p[6]
    got = {r.bubble_index: (r.n_children, r.child_area, r.alone) for r in regions.with_page_boxes(det).collect()}
    for b in given:
        kids = [c for c in given if b[2] == 0 and c[2] == 1 and inside(c, b)]
        alone = b[2] == 1 and not any(p[2] == 0 and inside(b, p) for p in given)
        assert got[b[1]] == (len(kids), sum((c[5] - c[3]) * (c[6] - c[4]) for c in kids), alone)


def test_valid_set_and_narrow_profile(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [r.cleaned for r in regions.cleaned_or_skipped(df, None, ["id"]).collect()] == [True] * 3
    assert sorted((r.id, r.cleaned) for r in regions.cleaned_or_skipped(df, spark.createDataFrame([(2,), (2,)], "id int"), ["id"]).collect()) == [(1, False), (2, True), (2, True)]
    narrow = spark.createDataFrame([(1, x, 5 if x > 2 else 0) for x in range(9)], "k int, x int, v int")
    assert tuple(sequence.profile_columns(narrow, "k", "x", "v", least=1).first()) == (1, 0, 9, 0)


def test_png_sizes_are_read_from_the_header():
    raw = raster.png(np.zeros((3, 4), np.uint8))
    assert struct.unpack(">II", raw[16:24]) == (4, 3)
