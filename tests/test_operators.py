"""Hand-worked vectors of the operators, and random comparison with plain Python."""

import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import hashing, params, raster, text
from leafmill.operators import batching, exchange, geometry, health, metrics, regions, sequence
from leafmill.sources import readers, writers
from leafmill.streaming import pages


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def boxes(spark, *given):
    return spark.createDataFrame([(0, *x) for x in given], "page_index long, bubble_index int, label int, x1 int, y1 int, x2 int, y2 int, score double")


def test_boxes_within_overlap_iou(spark):
    df = spark.createDataFrame([((2, 2, 8, 8), (0, 0, 10, 10)), ((0, 0, 10, 10), (0, 0, 10, 10)), ((5, 5, 12, 8), (0, 0, 10, 10)), ((10, 0, 20, 10), (0, 0, 10, 10)), ((11, 0, 20, 10), (0, 0, 10, 10)), ((1, 1, 11, 11), (0, 0, 10, 10))], "a struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>")
    got = df.select(geometry.within("a", "b").alias("w"), geometry.overlaps("a", "b").alias("o"), geometry.iou("a", "b").alias("i")).collect()
    assert [r.w for r in got] == [True, True, False, False, False, False]
    assert [r.o for r in got] == [True, True, True, True, False, True]
    assert got[5].i == 81 / 119 and got[3].i == 0


def test_suppression_keeps_the_best(spark):
    df = boxes(spark, (0, 0, 0, 0, 10, 10, 0.9), (1, 0, 1, 1, 11, 11, 0.8), (2, 0, 20, 20, 30, 30, 0.7), (3, 0, 2, 2, 12, 12, 0.6))
    assert rows(geometry.nms(df, ["page_index", "label"], "score", ["bubble_index"], 0.5), "bubble_index") == [(0,), (2,), (3,)]


def test_suppression_like_plain_python(spark):
    rng = random.Random(1)
    given_ = [(i, i % 2, x := rng.randrange(40), y := rng.randrange(40), x + rng.randrange(5, 30), y + rng.randrange(5, 30), rng.randrange(100) / 100) for i in range(60)]
    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return 0 if w <= 0 or h <= 0 else w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)
    kept = []
    for b in sorted(given_, key=lambda b: (-b[6], b[0])):
        if all(k[1] != b[1] or iou(k, b) <= 0.4 for k in kept):
            kept.append(b)
    got = rows(geometry.nms(boxes(spark, *given_), ["page_index", "label"], "score", ["bubble_index"], 0.4), "bubble_index")
    assert got == sorted((b[0],) for b in kept)


def test_categories(spark):
    df = boxes(spark, (0, 0, 0, 0, 100, 100, 1.0), (1, 1, 10, 10, 20, 20, 1.0), (2, 1, 200, 200, 210, 210, 1.0), (3, 2, 0, 0, 5, 5, 1.0), (4, 0, 300, 300, 310, 310, 1.0))
    got = rows(regions.categorised(df), "region_id", "label", "background_type", "n_children", "child_area")
    assert got == [(0, 0, "Simple", 1, 100), (1, 0, "Complex", 0, 0), (2, 1, "Complex", 0, 0), (3, 2, "Complex", 0, 0)]
    assert regions.categorised(df, keep_orphans=False, include_free_text=False).count() == 2
    assert [r[0] for r in spark.sql("select * from values (6,10),(5,10),(0,0) as t(w,n)").select(regions.background(F.col("w"), F.col("n"))).collect()] == ["Simple", "Complex", "Complex"]


def test_two_level_batches(spark):
    df = batching.ordinal(spark.range(10), ["id"]).withColumn("n", F.lit(10).cast("long"))
    got = rows(batching.two_level(df, "ord", F.col("n"), 3, 2), "key_chunk", "sub_chunk")
    assert got == sorted([(0, 0)] * 2 + [(0, 1)] * 2 + [(1, 0)] * 2 + [(1, 1)] * 2 + [(2, 0), (2, 1)])
    assert spark.range(1).select(batching.retry_delays(3).alias("a"), batching.capped_delays(6).alias("b")).first() == ([1000, 2000, 4000, 8000], [1000, 2000, 4000, 8000, 10000, 10000])


def test_percentiles_and_means(spark):
    p = lambda v, q: spark.range(1).select(metrics.percentile(F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>"), q)).first()[0]
    assert (p([1, 2], 0.95), p([10, 20, 30, 40], 0.5), p([], 0.5)) == (1, 20, 0)
    df = spark.createDataFrame([(1,), (2,), (4,)], "v long")
    assert df.agg(metrics.integer_mean("v")).first()[0] == 2 and df.filter("v > 9").agg(metrics.integer_mean("v")).first()[0] == 0
    assert spark.range(1).select(metrics.hit_rate(F.lit(1), F.lit(1)), metrics.hit_rate(F.lit(0), F.lit(0))).first() == (0.5, 0.0)
    assert metrics.exposition(spark.createDataFrame([("api_calls_total", 1)], "n string, v long"), "n", "v").first()[0] == "api_calls_total {} 1"


def test_ctc(spark):
    steps = F.array(*[F.lit(x) for x in (9, 1, 1, 9, 1, 2, 2, 9)])
    assert spark.range(1).select(sequence.ctc_collapse(steps, 9)).first()[0] == [1, 1, 2]
    assert spark.range(1).select(sequence.decode(F.array(F.lit(1), F.lit(7)), F.create_map(F.lit(1), F.lit("漢")))).first()[0] == "漢?"


def test_quality_gate(spark):
    df = spark.createDataFrame([("", 0.9), ("漢", 0.25), ("漢", 0.1), ("ab", 0.9), ("abc", 0.45), ("abc", 0.5), ("é", 0.3)], "t string, c double")
    assert [r[0] for r in df.select(text.quality_gate("t", "c")).collect()] == [False, True, False, False, False, True, True]


def test_strings(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.safe_filename(F.lit(x))) for x in ("Roboto", "Open Sans", "Noto Sans JP", "Font@#$%Name")] == ["Roboto", "Open_Sans", "Noto_Sans_JP", "Font----Name"]
    assert one(text.css_font_url(F.lit("@font-face {\n  src: url('https://x.example/a.woff2') format('woff2');\n}"))) == "https://x.example/a.woff2"
    assert one(text.css_font_url(F.lit("no font"))) is None
    assert one(text.trimmed(F.lit("　 a b \n"))) == "a b"
    assert one(text.hex_key(F.lit(-1).cast("long"))) == "f" * 16 and one(text.parse_hex_key(F.lit("f" * 16))) == -1 and one(text.parse_hex_key(F.lit("xyz"))) is None
    assert one(text.key_list(F.lit(" a, ,b ,"))) == ["a", "b"]
    raw = bytes(range(256)) * 2
    assert one(text.from_data_url(text.data_url(F.lit(raw)))) == raw
    assert one(raster.panel_width(F.lit(100))) == 40 and one(raster.panel_width(F.lit(400))) == 60 and one(raster.panel_width(F.lit(1000))) == 80
    assert one(raster.blend(F.lit(100), F.lit(200), F.lit(0.5))) == 150


def test_hash_keys(spark):
    import xxhash

    h = xxhash.xxh3_64_intdigest(b"test")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(bytearray(b"test"), 0, 0, 100, 100), (bytearray(b"test"), 0, 0, 100, 101)], "b binary, x1 int, y1 int, x2 int, y2 int")
    got = df.select(hashing.xxh3("b").alias("h"), "x1", "y1", "x2", "y2").withColumn("k", hashing.cache_key("h", "x1", "y1", "x2", "y2")).collect()
    assert got[0].h == signed(h) and got[0].k == signed(xxhash.xxh3_64_intdigest(struct.pack("<Q4i", h, 0, 0, 100, 100))) and got[0].k != got[1].k


def events(*oks, gap=1):
    return [(7, i * gap, i, ok) for i, ok in enumerate(oks)]


def test_key_health(spark):
    def state(*oks):
        df = spark.createDataFrame(events(*oks), "key long, at long, tie long, ok boolean")
        r = health.key_health(df, "key", "at", "tie", F.col("ok")).first()
        return r.health, r.consecutive_failures
    assert state(False, False, False) == ("Unhealthy", 3)
    assert state(*[False] * 3, *[True] * 5) == ("Healthy", 0)
    assert state(True, False) == ("Degraded", 1)


def breaker_of(given_, failures, open_s, successes):
    st_, f, s, opened, trips, refused = "Closed", 0, 0, 0, 0, 0
    for _, at, _, ok in given_:
        if st_ == "Open" and at - opened >= open_s:
            st_, s = "HalfOpen", 0
        if st_ == "Open":
            refused += 1
        elif st_ == "HalfOpen":
            if ok:
                s += 1
                if s >= successes:
                    st_, f = "Closed", 0
            else:
                st_, opened, trips = "Open", at, trips + 1
        elif ok:
            f = 0
        else:
            f += 1
            if f >= failures:
                st_, opened, trips, f = "Open", at, trips + 1, 0
    return st_, trips, refused


def test_breaker_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    given_ = [(k, i * 7, i, rng.random() < 0.6) for k in range(8) for i in range(40)]
    df = spark.createDataFrame(given_, "key long, at long, tie long, ok boolean")
    want = {k: breaker_of([e for e in given_ if e[0] == k], 2, 30, 2) for k in range(8)}
    got = {r.key: (r.state, r.trips, r.refused) for r in health.breaker(df, "key", "at", "tie", F.col("ok"), 2, 30, 2).collect()}
    assert got == want
    for part, (a, b) in enumerate(((0, 15), (15, 40))):  # two micro-batches, in order of time
        df.filter(f"tie >= {a} and tie < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={part}"))
    stream = pages.event_stream(spark, str(tmp_path / "in"), df.schema)
    q = pages.breaker_stream(stream, 2, 30, 2).writeStream.outputMode("update").format("memory").queryName("breakers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from breakers").collect():
        last[r.key] = max(last.get(r.key, ("", -1, -1)), (r.state, r.trips, r.refused), key=lambda x: (x[1], x[2]))
    assert {k: v[1:] for k, v in last.items()} == {k: v[1:] for k, v in want.items()}


def test_exchange(spark):
    w = spark.createDataFrame([(1, "simple", 0, "a"), (1, "simple", 1, "b"), (1, "complex", 0, "c")], "id int, kind string, pos int, t string").withColumn("prio", F.when(F.col("kind") == "complex", 1).otherwise(0))
    assert rows(exchange.last_write(w, ["id"], ["prio", "pos"], ["t"]), "id", "t") == [(1, "c")]
    pages_ = spark.createDataFrame([(1,), (2,)], "p int")
    items = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (9, 1, "z")], "p int, o int, t string")
    assert rows(exchange.fan_in(pages_, items, "p", ["o"], F.col("t")), "p", "items") == [(1, ["x", "y"]), (2, [])]
    texts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " 　")], "k int, o int, t string")
    assert rows(exchange.joined_text(texts, ["k"], ["o"], "t"), "joined") == [("a\nb",)]


def test_profile(spark):
    v = [0] * 10 + [5] * 20 + [0] * 10 + [5] * 4 + [0] * 6
    df = spark.createDataFrame([(1, x, y) for x, y in enumerate(v)] + [(2, x, 0) for x in range(30)], "k int, x int, v int")
    assert rows(sequence.profile_columns(df, "k", "x", "v"), "k", "x", "width", "position") == [(1, 8, 24, 0), (2, 0, 30, 0)]


def test_raster():
    m = np.zeros((7, 7), np.uint8)
    m[3, 3] = 255
    assert (raster.dilate(m) > 0).sum() == 25 and (raster.dilate(m)[1:6, 1:6] == 255).all()
    a = np.arange(12, dtype=float).reshape(3, 4)
    assert np.allclose(raster.resize_bilinear(a, 3, 4), a) and np.allclose(raster.resize_bilinear(a, 5, 7)[0, 0], 0) and np.allclose(raster.resize_bilinear(a, 5, 7)[-1, -1], 11)
    assert raster.white_share(np.full((10, 10, 3), 250, np.uint8), (0, 0, 8, 8), [(0, 0, 4, 4), (6, 6, 12, 12)]) == (20, 20)
    assert raster.bounding_boxes(np.pad(np.ones((12, 12), np.uint8), 3)) == [(3, 3, 15, 15)]


def test_png_is_read_by_spark(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(raster.png(image))
    (tmp_path / "B.PNG").write_bytes(raster.png(image[..., 0]))
    (tmp_path / "c.txt").write_text("no image")
    got = readers.image_files(spark, str(tmp_path)).collect()
    assert sorted((r.page_index, r.filename) for r in got) == [(0, "B.PNG"), (1, "a.png")]
    r = next(x for x in readers.decoded_images(spark, str(tmp_path)).collect() if x.nChannels == 3)
    assert (np.frombuffer(r.data, np.uint8).reshape(5, 7, 3)[..., ::-1] == image).all()


def test_cache_and_vocabulary(spark):
    entries = spark.createDataFrame([(5, "こんにちは", "Hello"), (-2, "a", "b")], "key long, original_text string, translated_text string")
    lines = writers.cache_json(entries).unionByName(spark.createDataFrame([("not json",), ('{"zz": {"original_text": "x", "translated_text": "y"}}',)], "value string"))
    assert rows(readers.cache_entries(lines), "key", "original_text", "translated_text") == rows(entries, "key", "original_text", "translated_text")
    vocab = {r.idx: (r.ch, r.is_blank) for r in readers.vocabulary(spark.createDataFrame([("0\t<blank>",), ("1\t<space>",), ("65\tA",), ("12345\t漢",), ("bad",), ("32\t ",)], "value string")).collect()}
    assert vocab[0][1] and vocab[1][0] == " " and vocab[12345][0] == "漢" and vocab[33][0] == "!" and vocab[32][0] == " "


def test_responses(spark):
    body = '{"candidates":[{"content":{"parts":[{"text":"{\\"translations\\":[{\\"bubble_number\\":1,\\"translated_text\\":\\"x\\"}]}"}]}}],"usageMetadata":{"promptTokenCount":5}}'
    r = spark.range(1).select(writers.response_texts(F.lit(body)).alias("t"), writers.token_usage(F.lit(body), "promptTokenCount").alias("n"), writers.token_usage(F.lit("{}"), "promptTokenCount").alias("z")).first()
    assert (r.t[0].bubble_number, r.t[0].translated_text, r.n, r.z) == (1, "x", 5, 0)
    three = '{"translations":[{"id":0,"text":"Hello world"},{"id":1,"text":"How are you?"},{"id":2,"text":"Good morning"}]}'
    assert len(spark.range(1).select(writers.structured_texts(F.lit(three))).first()[0]) == 3


def test_settings():
    s = params.Settings.from_env({"BATCH_SIZE_N": "9", "TARGET_SIZE": "x", "CONFIDENCE_THRESHOLD": "2"})
    assert (s.batch_size_n, s.target_size) == (9, 640) and len(s.problems()) == 1 and not params.Settings().problems()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6))
def test_png_bytes(h, w):
    raw = raster.png(np.zeros((h, w), np.uint8))
    assert raw.startswith(b"\x89PNG") and struct.unpack(">II", raw[16:24]) == (w, h) and zlib.crc32(b"IEND") == struct.unpack(">I", raw[-4:])[0]
