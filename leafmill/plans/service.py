"""Queries of the service side: settings, keys, requests and responses, metrics, errors, and whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors, params, raster, text
from ..operators import batching, exchange, geometry, health, metrics, regions, sequence
from ..session import table
from ..sources import writers
from . import batch
from .registry import query
from .relations import CALLS_SQL, DET_SQL, calls, dealt, detections, line_items, page_parts

DET, CALLS = f"WITH {DET_SQL}", f"WITH {CALLS_SQL}"


def _one_of(number, values: list[str]):
    """The values in turn, by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- strings and settings

_FONT_NAMES = ["anime-ace", "anime-ace-3", "arial", "comic-sans", "ms-yahei", "noto-sans-mono-cjk", "sans-serif-regular", "sans-serif-bold", "serif-regular", "serif-bold", "monospace-regular", "monospace-bold", "Roboto", "open sans", "unknown", "Élan", "arial-bold"]


@query(f"""WITH n AS (SELECT p_partkey, {_list_sql(_FONT_NAMES)}[CAST(p_partkey % {len(_FONT_NAMES)} + 1 AS INTEGER)] AS name FROM part)
SELECT p_partkey, name, CASE name WHEN 'anime-ace' THEN 'Anime Ace' WHEN 'anime-ace-3' THEN 'Anime Ace 3' WHEN 'arial' THEN 'Arial Unicode' WHEN 'comic-sans' THEN 'Comic Sans' WHEN 'ms-yahei' THEN 'Microsoft YaHei'
  WHEN 'noto-sans-mono-cjk' THEN 'Noto Sans Mono CJK' WHEN 'sans-serif-regular' THEN 'sans-serif' WHEN 'sans-serif-bold' THEN 'sans-serif' WHEN 'serif-regular' THEN 'serif' WHEN 'serif-bold' THEN 'serif'
  WHEN 'monospace-regular' THEN 'monospace' WHEN 'monospace-bold' THEN 'monospace' WHEN 'Roboto' THEN 'Roboto' WHEN 'open sans' THEN 'open sans' WHEN 'Élan' THEN 'Élan' ELSE 'sans-serif' END AS family, contains(name, 'bold') AS bold FROM n""")
def q_font_families(spark, sf):
    """Every name of the table of families, and names beside it."""
    n = table(spark, sf, "part").select("p_partkey", _one_of(F.col("p_partkey"), _FONT_NAMES).alias("name"))
    return n.select("p_partkey", "name", text.font_family("name").alias("family"), text.is_bold("name").alias("bold"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.woff2' WHEN 1 THEN url || '.ttf' WHEN 2 THEN url || '.woff2' WHEN 3 THEN NULL ELSE url || '.woff2?v=1' END AS font FROM pages""")
def q_font_sheets(spark, sf):
    """Style sheets with several sources: the first .woff2 or .ttf counts, wherever it is."""
    src = lambda before, suffix, after: F.concat(F.lit(f"  src: url({before}"), "url", F.lit(f"{suffix}{after}) format('x');\n"))
    eot, svg = src("'", ".eot", "'"), src('"', ".svg", '"')
    sheets = [F.concat(eot, src("'", ".woff2", "'")), F.concat(eot, svg, src("", ".ttf", " ")), F.concat(src(' "', ".woff2", '" '), src("", ".ttf", "")), F.concat(eot, svg), F.concat(F.lit("  src: local('x');\r\n"), src("'", ".woff2?v=1", "'"))]
    css = F.element_at(F.array(*[F.concat(F.lit("@font-face {\n"), s, F.lit("}\n")) for s in sheets]), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", text.css_font_url(css).alias("font"))


@query("SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^/+|/+$', '', 'g'), '/+', '/', 'g'), '/') AS keys FROM pages WHERE url IS NOT NULL")
def q_key_lists(spark, sf):
    """Lists with tabs, line ends and wide blanks around their entries."""
    given = F.concat(F.lit("\t,　"), F.replace("url", F.lit("/"), F.lit("\n,\t　 ")), F.lit(" , "))
    return table(spark, sf, "pages").filter("url is not null").select("page_id", text.key_list(given).alias("keys"))


_LEVELS = ["trace", "DEBUG", "Info", "warn", "Warning", "ERROR", "verbose", ""]


@query(f"""SELECT event_id, ['trace', 'debug', 'info', 'warn', 'warn', 'error', 'info', 'info'][CAST(event_id % 8 + 1 AS INTEGER)] AS level, ['left', 'center', 'right', 'center'][CAST(event_id % 4 + 1 AS INTEGER)] AS align FROM events""")
def q_levels_and_alignment(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", text.log_level(_one_of(k, _LEVELS)).alias("level"), text.text_align(_one_of(k, ["LEFT", "Center", "right", "justify"])).alias("align"))


_BOOLS = ["true", "false", "1", "TRUE", " true", "yes", ""]
_INTS = ["7", "+12", "-3", "4.5", " 8", "", "99999999999", "0"]
_FLOATS = ["0.5", "1e-1", ".25", "5.", "abc", "", "-1", "0,5"]


@query(f"""WITH k AS (SELECT o_orderkey, {_list_sql(_BOOLS)}[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS b, {_list_sql(_INTS)}[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS i, {_list_sql(_FLOATS)}[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS f FROM orders)
SELECT o_orderkey, CASE b WHEN 'true' THEN true WHEN 'false' THEN false ELSE true END AS flag, CAST(CASE i WHEN '7' THEN 7 WHEN '+12' THEN 12 WHEN '0' THEN 0 ELSE 640 END AS BIGINT) AS number,
CAST(CASE f WHEN '0.5' THEN 0.5 WHEN '1e-1' THEN 0.1 WHEN '.25' THEN 0.25 WHEN '5.' THEN 5 WHEN '-1' THEN -1 ELSE 0.3 END AS DOUBLE) AS share, CASE o_orderkey % 3 WHEN 0 THEN 'CPU' WHEN 1 THEN NULL ELSE 'CUDA' END AS backend FROM k""")
def q_setting_values(spark, sf):
    """Settings out of text: what can't be parsed is the default."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", params.bool_or(_one_of(k, _BOOLS), True).alias("flag"), params.int_or(_one_of(k, _INTS), 640).alias("number"), params.float_or(_one_of(k, _FLOATS), 0.3).alias("share"),
        params.text_or_null(_one_of(k, [" cpu\t", " ", "cuda"])).alias("backend"),
    )


@query("""SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN NOT p_size / 40.0::DOUBLE BETWEEN 0 AND 1 THEN 'confidence_threshold' END, CASE WHEN NOT p_size / 50.0::DOUBLE - 0.1::DOUBLE BETWEEN 0 AND 1 THEN 'iou_threshold' END, CASE WHEN NOT p_size * 50 BETWEEN 320 AND 2048 THEN 'target_size' END,
  CASE WHEN p_partkey % 5 < 1 THEN 'batch_size_n' END, CASE WHEN p_partkey % 7 < 1 THEN 'api_batch_size_m' END, CASE WHEN p_partkey % 11 < 1 THEN 'max_concurrent_batches' END,
  CASE WHEN NOT (p_partkey % 4) / 2.0::DOUBLE BETWEEN 0 AND 1 THEN 'simple_bg_white_threshold' END, CASE WHEN NOT p_partkey % 13 BETWEEN 1 AND 10 THEN 'upscale_factor' END,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 6 < 1 THEN 'rate_limit_max_requests' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 10 < 1 THEN 'rate_limit_window_seconds' END], lambda x: x IS NOT NULL), ',') AS broken FROM part""")
def q_broken_settings(spark, sf):
    """Rows of settings against all rules on their ranges."""
    k, size = F.col("p_partkey"), F.col("p_size")
    given = {
        "confidence_threshold": size / F.lit(40.0), "iou_threshold": size / F.lit(50.0) - 0.1, "target_size": size * 50, "batch_size_n": k % 5, "api_batch_size_m": k % 7, "max_concurrent_batches": k % 11,
        "simple_bg_white_threshold": (k % 4) / F.lit(2.0), "upscale_factor": k % 13, "rate_limit_max_requests": k % 6, "rate_limit_window_seconds": k % 10,
    }
    return table(spark, sf, "part").select("p_partkey", F.array_join(params.broken_rules(given, k % 2 == 0), ",").alias("broken"))


# ---------------------------------------------------------------- whole texts and tables


_CJK = r"regexp_matches(text, '[\x{3001}-\x{10FFFF}]')"


@query(f"""WITH q AS (SELECT doc_id, text, (n_chars % 10) / 10.0::DOUBLE AS conf, length(text) AS n, {_CJK} AS high, regexp_matches(text, '^[!-~]+$') AS ascii FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN false WHEN high THEN conf >= 0.2 WHEN n <= 2 AND ascii THEN false WHEN ascii AND conf < 0.5 THEN false ELSE conf >= 0.2 END AS good,
CASE WHEN n = 0 THEN false WHEN high THEN conf >= 0.2 WHEN n <= 2 THEN false ELSE conf >= 0.4 END AS good_strict FROM q""")
def q_text_quality(spark, sf):
    """Both gates on whole documents; the confidence is a digit of their length."""
    d = table(spark, sf, "documents").select("doc_id", "text", ((F.col("n_chars") % 10) / F.lit(10.0)).alias("conf"))
    return d.select("doc_id", text.quality_gate("text", "conf").alias("good"), text.strict_gate("text", "conf").alias("good_strict"))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, n_chars FROM documents), g AS (SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN '漢' || w WHEN 1 THEN w || 'é' ELSE w END AS text, (n_chars % 10) / 10.0::DOUBLE AS conf FROM w),
q AS (SELECT *, length(text) AS n, {_CJK} AS high, regexp_matches(text, '^[!-~]+$') AS ascii FROM g)
SELECT doc_id, count(*) AS n, count(*) FILTER (CASE WHEN n = 0 THEN false WHEN high THEN conf >= 0.2 WHEN n <= 2 AND ascii THEN false WHEN ascii AND conf < 0.5 THEN false ELSE conf >= 0.2 END) AS good,
count(*) FILTER (CASE WHEN n = 0 THEN false WHEN high THEN conf >= 0.2 WHEN n <= 2 THEN false ELSE conf >= 0.4 END) AS good_strict FROM q GROUP BY doc_id""")
def q_word_quality(spark, sf):
    """Both gates on every word of every document: short ones, and some with an ideograph or an accent added."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"), (F.col("n_chars") % 3).alias("k"), ((F.col("n_chars") % 10) / F.lit(10.0)).alias("conf"))
    w = w.withColumn("t", F.when(F.col("k") == 0, F.concat(F.lit("漢"), "w")).when(F.col("k") == 1, F.concat("w", F.lit("é"))).otherwise(F.col("w")))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.quality_gate("t", "conf")).alias("good"), F.count_if(text.strict_gate("t", "conf")).alias("good_strict"))


@query("SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q_page_fanin(spark, sf):
    """All line items of each order, in order."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = exchange.fan_in(table(spark, sf, "orders").select("o_orderkey"), li, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_partkey").cast("string"))
    return out.select("o_orderkey", F.array_join("items", ",").alias("parts"))


_LABELLED = "SELECT md5(text) AS k, min(doc_id) AS cached_id FROM documents JOIN labels USING (doc_id) GROUP BY 1"


def _labelled_cache(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents by the digest of their text, and a cache of those that have a label."""
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("k"))
    return d, d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("k").agg(F.min("doc_id").alias("cached_id"))


@query(f"SELECT doc_id, cached_id FROM documents JOIN ({_LABELLED}) ON md5(text) = k")
def q_cache_hits(spark, sf):
    return exchange.cache_hits(*_labelled_cache(spark, sf), "k").select("doc_id", "cached_id")


@query(f"SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT k FROM ({_LABELLED}))")
def q_cache_misses(spark, sf):
    return exchange.cache_misses(*_labelled_cache(spark, sf), "k").select("doc_id")


@query("SELECT k, max_by(v, (prio, v)) AS v FROM (SELECT o_custkey AS k, CAST(max(o_orderkey) AS VARCHAR) AS v, 0 AS prio FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_name, 1 FROM customer) GROUP BY k")
def q_cache_put_over(spark, sf):
    """A cache of orders, with all customers put over it."""
    old = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").cast("string").alias("v"))
    return exchange.upsert(old, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"], ["v"])


@query("SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn, text) AS joined FROM conversations WHERE trim(text) <> '' GROUP BY conv_id, role")
def q_texts_by_role(spark, sf):
    return exchange.joined_text(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn"], "text")


@query("""WITH RECURSIVE n AS (SELECT vec_id, label, vec_id // 100 AS block, embedding, row_number() OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) AS rn FROM embeddings),
k AS (
  SELECT label, block, rn, [{'vec_id': vec_id, 'e': embedding}] AS kept FROM n WHERE rn = 1
  UNION ALL
  SELECT n.label, n.block, n.rn, CASE WHEN len(list_filter(kept, lambda y: list_cosine_similarity(y.e, n.embedding) > 0.3)) > 0 THEN kept ELSE list_append(kept, {'vec_id': n.vec_id, 'e': n.embedding}) END
  FROM k JOIN n ON n.label = k.label AND n.block = k.block AND n.rn = k.rn + 1)
SELECT label, CAST(block AS BIGINT) AS block, CAST(len(max_by(kept, rn)) AS BIGINT) AS n_kept FROM k GROUP BY label, block""")
def q_nms_embedding_blocks(spark, sf):
    """Greedy suppression by cosine similarity, in groups of bounded size: a label's vectors of a block of 100 ids, as a page's boxes."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = table(spark, sf, "embeddings").withColumns({"e": F.transform("embedding", lambda x: x.cast("double")), "block": F.floor(F.col("vec_id") / 100).cast("long")})
    e = e.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    clash = lambda a, b: dot(a["e"], b["e"]) > 0.3 * a["norm"] * b["norm"]
    kept = geometry.greedy_suppression(e, ["label", "block"], [F.col("vec_id")], F.struct("e", "norm"), clash)
    return kept.select("label", "block", F.size("kept").cast("long").alias("n_kept"))


# ---------------------------------------------------------------- regions


_CATEGORISED = f"""{DET}, pairs AS (
  SELECT p.page_index, p.bubble_index, count(*) AS n FROM det p JOIN det c ON p.page_index = c.page_index AND p.label = 0 AND c.label = 1 AND c.x1 >= p.x1 AND c.y1 >= p.y1 AND c.x2 <= p.x2 AND c.y2 <= p.y2 GROUP BY ALL)"""
_SIDES = f"{_CATEGORISED}, boxes AS (SELECT d.page_index, d.bubble_index, d.label, coalesce(n, 0) AS n_children FROM det d LEFT JOIN pairs USING (page_index, bubble_index))"


def _boxes(spark, sf) -> DataFrame:
    return regions.with_page_boxes(detections(spark, sf)).select("page_index", "bubble_index", "label", "n_children")


@query(f"""{_SIDES}, t AS (SELECT l_orderkey AS page_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS bubble_index, CASE WHEN l_quantity > 40 THEN '  ' WHEN l_quantity > 10 THEN l_shipdate::DATE::VARCHAR END AS t FROM lineitem)
SELECT page_index, bubble_index, t AS translated_text FROM boxes JOIN t USING (page_index, bubble_index) WHERE n_children > 0 AND trim(t) <> '' AND page_index NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_renderable_regions(spark, sf):
    """Regions with child boxes and a translation that isn't blank, on pages that no image replaces."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    said = F.when(F.col("l_quantity") > 40, F.lit("  ")).when(F.col("l_quantity") > 10, F.date_format("l_shipdate", "yyyy-MM-dd"))
    t = line_items(spark, sf).select(F.col("l_orderkey").alias("page_index"), rank.alias("bubble_index"), said.alias("translated_text")).filter("translated_text is not null")
    images = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("page_index"))
    drawn = t.join(images, "page_index", "left_semi").select("page_index", "bubble_index")
    return regions.renderable(_boxes(spark, sf), t, drawn, ["page_index", "bubble_index"]).select("page_index", "bubble_index", "translated_text")


@query(f"""{DET} SELECT page_index, bubble_index, page_index IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000) AS cleaned, row_number() OVER (PARTITION BY page_index ORDER BY bubble_index) AS position FROM det""")
def q_cleaned_or_skipped(spark, sf):
    """Regions in and out of the valid set together, in the order of their ids."""
    d = detections(spark, sf).select("page_index", "bubble_index")
    valid = table(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("page_index"))
    both = regions.cleaned_or_skipped(d, dealt(valid, "page_index", page_parts(spark, sf)), ["page_index"])
    return both.withColumn("position", F.row_number().over(Window.partitionBy("page_index").orderBy("bubble_index")).cast("long"))


@query(f"""{DET}, c AS (SELECT page_index, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det WHERE label = 1 GROUP BY page_index),
s AS (SELECT *, CAST(greatest(x2 - x1, 1) AS DOUBLE) AS w, CAST(greatest(y2 - y1, 1) AS DOUBLE) AS h FROM c), m AS (SELECT *, least(greatest(least(w, h) * 0.02::DOUBLE, 2), 8) AS margin FROM s)
SELECT page_index, x1, y1, round(margin, 6) AS margin, round(greatest(w - 2 * margin, 10), 6) AS room_width, round(greatest(h - 2 * margin, 10), 6) AS room_height, round(greatest(least(greatest(h - 2 * margin, 10), 72), 8), 6) AS most_font,
round(greatest((greatest(w - 2 * margin, 10) - 50) / 2 + margin, margin), 6) AS offset_x FROM m""")
def q_text_canvas(spark, sf):
    """Canvas of each page's child boxes: margin, room, largest font, and where a text 50 wide starts."""
    union = detections(spark, sf, numbered=False).filter("label = 1").groupBy("page_index").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    out = union.withColumns(raster.canvas(*(F.col(c) for c in geometry.BOX)))
    offset = raster.centred(F.col("room_width"), F.lit(50.0), F.col("margin"))
    return out.select("page_index", "x1", "y1", *[F.round(c, 6).alias(c) for c in ("margin", "room_width", "room_height", "most_font")], F.round(offset, 6).alias("offset_x"))


@query(f"{DET} SELECT page_index, bubble_index, greatest(least(x1, 199), 0) AS x1, greatest(least(y1, 149), 0) AS y1, least(x2, 200) AS x2, least(y2, 150) AS y2 FROM det")
def q_crops_inside(spark, sf):
    """Boxes clamped so that they start at least a pixel inside the page."""
    return detections(spark, sf).withColumns(geometry.clamped(200, 150, last_start=True)).select("page_index", "bubble_index", *geometry.BOX)


@query(f"{DET} SELECT page_index, bubble_index, CASE label WHEN 0 THEN max(greatest(x2 - x1, y2 - y1)) OVER (PARTITION BY page_index) WHEN 1 THEN 640 ELSE x2 END AS target FROM det")
def q_batch_target_sizes(spark, sf):
    """Target sizes in batches: asked for 0, the largest side in the batch."""
    d = detections(spark, sf)
    side = F.max(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).over(Window.partitionBy("page_index"))
    asked = F.when(F.col("label") == 0, F.lit(0)).when(F.col("label") == 2, F.col("x2"))
    return d.select("page_index", "bubble_index", params.batch_target_size(asked, side).alias("target"))


@query(f"""{DET}, m AS (SELECT page_index, bubble_index, greatest(x1 + 10, 0) AS a, y1 AS b FROM det) SELECT page_index, count(*) AS warnings FROM (
  SELECT c.page_index FROM det c JOIN det p ON p.page_index = c.page_index AND p.label = 0 AND c.label = 1 AND c.x2 >= p.x1 AND p.x2 >= c.x1 AND c.y2 >= p.y1 AND p.y2 >= c.y1 AND NOT (c.x1 >= p.x1 AND c.y1 >= p.y1 AND c.x2 <= p.x2 AND c.y2 <= p.y2)
  UNION ALL SELECT page_index FROM det p WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM det c WHERE c.page_index = p.page_index AND c.label = 1 AND c.x1 >= p.x1 AND c.y1 >= p.y1 AND c.x2 <= p.x2 AND c.y2 <= p.y2)
  UNION ALL SELECT page_index FROM det c WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM det p WHERE p.page_index = c.page_index AND p.label = 0 AND c.x1 >= p.x1 AND c.y1 >= p.y1 AND c.x2 <= p.x2 AND c.y2 <= p.y2)) GROUP BY page_index""".replace(", m AS (SELECT page_index, bubble_index, greatest(x1 + 10, 0) AS a, y1 AS b FROM det)", ""))
def q_warning_counts(spark, sf):
    """All validation warnings of each page."""
    return batch.warnings(detections(spark, sf)).groupBy("page_index").agg(F.count(F.lit(1)).alias("warnings"))


# ---------------------------------------------------------------- sequences


_MINUTES = "e AS (SELECT user_id % 20 AS k, minute(ts) AS x FROM events), g AS (SELECT k, x FROM (SELECT DISTINCT k FROM e), (SELECT unnest(range(0, 60)) AS x)), p AS (SELECT g.k, g.x, count(e.k) AS v FROM g LEFT JOIN e ON g.k = e.k AND g.x = e.x GROUP BY ALL), m AS (SELECT k, avg(v) AS mean FROM p GROUP BY k)"


def _minutes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), F.minute("ts").alias("x"))
    grid = e.select("k").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(59))))
    return grid.join(e.groupBy("k", "x").agg(F.count(F.lit(1)).alias("v")), ["k", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


@query(f"""WITH {_MINUTES}, s AS (SELECT unnest([0.05::DOUBLE, 1.5, 50]) AS share), h AS (SELECT k, share, x, CASE WHEN v > share * mean THEN x END AS hit FROM p JOIN m USING (k), s)
SELECT k, share, CAST(CASE WHEN min(hit) IS NULL THEN 0 ELSE greatest(min(hit) - 2, 0) END AS BIGINT) AS top, CAST(CASE WHEN min(hit) IS NULL THEN 60 ELSE least(max(hit) + 3, 60) END AS BIGINT) AS bottom FROM h GROUP BY k, share""")
def q_vertical_extents(spark, sf):
    """Extents at three thresholds; nothing is above the highest, so all is in the extent."""
    p = _minutes(spark, sf)
    each = [sequence.extent(p, "k", "x", "v", share).withColumn("share", F.lit(share)) for share in (0.05, 1.5, 50.0)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH {_MINUTES}, t AS (SELECT p.k, v > 0.15 * mean AS a, lag(v > 0.15 * mean) OVER w AS pa, v > 0.9 * mean AS b, lag(v > 0.9 * mean) OVER w AS pb FROM p JOIN m USING (k) WINDOW w AS (PARTITION BY p.k ORDER BY x)),
n AS (SELECT k, count(*) FILTER (pa <> a) AS down, count(*) FILTER (pb <> b) AS across, k + 8 AS w, 24 AS h FROM t GROUP BY k)
SELECT k, down, across, CASE WHEN w > 2 * h THEN false ELSE (h / w > 1.3 AND across > down) OR h / w > 2 OR (h / w > 1 AND across > 2 * down) END AS vertical FROM n""")
def q_vertical_text(spark, sf):
    """Is a text vertical: changes of two profiles, at 0.15 and 0.9 of their means, and the sides."""
    p = _minutes(spark, sf)
    means = p.groupBy("k").agg(F.avg("v").alias("mean"))
    of = lambda share, name: sequence.transitions(p.join(means, "k"), "k", "x", F.col("v") > F.col("mean") * share).withColumnRenamed("transitions", name)
    n = of(0.15, "down").join(of(0.9, "across"), "k")
    return n.select("k", "down", "across", sequence.is_vertical(F.col("k") + 8, F.lit(24), F.col("across"), F.col("down")).alias("vertical"))


@query("SELECT l_orderkey AS page, string_agg(l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text, round(avg(l_discount * 10), 6) AS confidence FROM lineitem WHERE l_discount * 10 >= 0.2 GROUP BY l_orderkey")
def q_accepted_columns(spark, sf):
    """Texts and mean confidence of the accepted columns of a page."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t"), (F.col("l_discount") * 10).alias("c"))
    return sequence.mean_accepted(li, ["page"], F.col("c") >= 0.2, ["l_linenumber"], "t", "c").withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- keys and retries

_HEALTH = f"""{CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM calls),
lw AS (SELECT user_id, count(*) AS requests, count(*) FILTER (NOT ok) AS failures, max(i) AS n, coalesce(max(i) FILTER (ok), 0) AS won, coalesce(max(i) FILTER (NOT ok), 0) AS lost, max(sec) AS now, max(sec) FILTER (NOT ok) AS lf FROM o GROUP BY user_id),
hk AS (SELECT user_id, requests, failures, failures / requests AS failure_rate, n - won AS f, n - lost AS s, CASE WHEN n - lost < 5 THEN lf END AS last_failure, now FROM lw),
hh AS (SELECT *, CASE WHEN f >= 3 THEN 'Unhealthy' WHEN f > 0 AND now - last_failure < 60 THEN 'Degraded' ELSE 'Healthy' END AS health FROM hk)"""


def _health(spark, sf) -> DataFrame:
    return health.key_health(calls(spark, sf), "user_id", "at", "event_id", F.col("ok"))


@query(f"{_HEALTH} SELECT user_id, failure_rate, last_failure, health FROM hh")
def q_key_failures(spark, sf):
    """Failure rates and last failures of keys."""
    return _health(spark, sf).select("user_id", "failure_rate", "last_failure", "health")


@query(f"{_HEALTH} SELECT count(*) AS keys, count(*) FILTER (health = 'Healthy') AS healthy_keys, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(failures) AS BIGINT) AS failures, sum(failures) / sum(requests) AS failure_rate FROM hh")
def q_pool_statistics(spark, sf):
    return metrics.key_statistics(_health(spark, sf))


def _pool_of(kind: str) -> str:
    return f"""SELECT '{kind}' AS pool, n_nationkey AS key, CASE '{kind}' WHEN 'mixed' THEN ['Healthy', 'Degraded', 'Unhealthy'][CAST(n_nationkey % 3 + 1 AS INTEGER)] WHEN 'degraded' THEN ['Unhealthy', 'Degraded'][CAST(n_nationkey % 2 + 1 AS INTEGER)] ELSE 'Unhealthy' END AS health,
CASE '{kind}' WHEN 'gone' THEN 30 ELSE CAST(n_nationkey * 10 AS INTEGER) END AS idle FROM nation"""


@query(f"""WITH k AS ({" UNION ALL ".join(_pool_of(x) for x in ("mixed", "degraded", "recoverable", "gone"))}),
t AS (SELECT *, CASE WHEN health = 'Healthy' THEN 0 WHEN health = 'Degraded' THEN 1 WHEN idle > 60 THEN 2 END AS tier FROM k),
b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY pool) AS best FROM t) WHERE tier = best), s AS (SELECT pool, key, row_number() OVER (PARTITION BY pool ORDER BY key) - 1 AS slot, count(*) OVER (PARTITION BY pool) AS n FROM b),
q AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS ord FROM supplier), r AS (SELECT q.*, p.pool FROM q, (SELECT DISTINCT pool FROM k) p)
SELECT r.pool, s_suppkey, key AS picked FROM r LEFT JOIN s ON s.pool = r.pool AND s.slot = r.ord % s.n""")
def q_key_picks(spark, sf):
    """Suppliers' requests over four pools of keys: with healthy keys, with degraded ones, with recoverable ones, and with none."""
    requests = batching.ordinal(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"])
    k, out = F.col("n_nationkey"), None
    for kind, states in (("mixed", ["Healthy", "Degraded", "Unhealthy"]), ("degraded", ["Unhealthy", "Degraded"]), ("recoverable", ["Unhealthy"]), ("gone", ["Unhealthy"])):
        keys = table(spark, sf, "nation").select(k.alias("key"), _one_of(k, states).alias("health"), (F.lit(30) if kind == "gone" else k * 10).alias("idle"))
        got = batching.picked(requests, "ord", batching.tiers(keys, "key", "health", F.col("idle")), "key").select(F.lit(kind).alias("pool"), "s_suppkey", "picked")
        out = got if out is None else out.unionByName(got)
    return out


@query("""WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS turn, l_quantity > 25 AS ok FROM lineitem), m AS (SELECT *, 1 + l_orderkey % 4 AS most FROM a),
g AS (SELECT l_orderkey, min(turn) FILTER (ok) AS winner, count(*) AS n FROM m WHERE turn < most GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(winner + 1, n) AS tries, winner IS NOT NULL AS succeeded, winner FROM g""")
def q_failover(spark, sf):
    """Attempts with one key after the other, as many as there are keys, until one succeeds."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    a = line_items(spark, sf).select("l_orderkey", rank.alias("turn"), (F.col("l_quantity") > 25).alias("ok"))
    return batching.failover(a, "l_orderkey", "turn", F.col("ok"), 1 + F.col("l_orderkey") % 4)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '10000,10000,10000,10000' ELSE '1000,2000,4000,8000' END AS whole, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 4 END AS jittered FROM orders")
def q_jittered_retries(spark, sf):
    """Delays with jitter: its bounds, and what is left without it."""
    d = table(spark, sf, "orders").select("o_orderkey", batching.jittered_delays(3, F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("d"), batching.retry_delays(3, F.col("o_orderstatus") == "F").alias("b"))
    low = F.zip_with("d", "b", lambda x, y: F.when((x >= y) & (x - y < 1000), y).otherwise(x))
    again = batching.jittered_delays(3, F.lit(False), F.col("o_orderkey"))
    n = F.when(F.exists(F.zip_with("d", again, lambda x, y: x != y), lambda x: x), 0).otherwise(F.size(F.filter("d", lambda x: x.between(1000, 8999))))
    return d.select("o_orderkey", F.array_join(F.transform(low, lambda x: x.cast("string")), ",").alias("whole"), n.alias("jittered"))


# ---------------------------------------------------------------- metrics


def _samples(spark, sf) -> DataFrame:
    """Events as samples of a service."""
    kinds = [("click", "api"), ("view", "cache"), ("signup", "phase1"), ("purchase", "batch"), ("error", "trip")]
    kind = F.lit("start")
    for event, name in kinds:
        kind = F.when(F.col("event_type") == event, F.lit(name)).otherwise(kind)
    c = calls(spark, sf)
    all_ = c.select("at", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("latency").alias("value"), (F.col("event_id") % 3 > 0).alias("ok"), (F.col("event_id") % 100).alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"))
    begin = c.agg(F.min("at").alias("at")).select("at", F.lit(-1).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"))
    size = all_.filter("kind = 'cache'").withColumn("kind", F.lit("cache_size")).withColumn("value", F.col("seq"))
    return all_.unionByName(begin).unionByName(size)


_SNAPSHOT = f"""{CALLS}, a AS (SELECT * FROM calls WHERE event_type = 'click' ORDER BY sec DESC, event_id DESC LIMIT 10000), v AS (SELECT list_sort(list(latency)) AS v, CAST(sum(latency) // count(latency) AS BIGINT) AS mean FROM a),
ph AS (SELECT latency FROM calls WHERE event_type = 'signup' ORDER BY sec DESC, event_id DESC LIMIT 10000),
snap AS (SELECT (SELECT count(*) FROM calls WHERE event_type = 'click') AS api_calls_total, (SELECT count(*) FROM calls WHERE event_type = 'click' AND event_id % 3 > 0) AS api_calls_success, (SELECT count(*) FROM calls WHERE event_type = 'click' AND event_id % 3 = 0) AS api_calls_failed,
  (SELECT CAST(sum(event_id % 100) AS BIGINT) FROM calls WHERE event_type = 'click') AS api_tokens_input, (SELECT CAST(sum(event_id % 7) AS BIGINT) FROM calls WHERE event_type = 'click') AS api_tokens_output,
  (SELECT mean FROM v) AS api_latency_avg_ms, (SELECT v[1 + CAST(floor((len(v) - 1) * 0.5) AS INT)] FROM v) AS api_latency_p50_ms, (SELECT v[1 + CAST(floor((len(v) - 1) * 0.95) AS INT)] FROM v) AS api_latency_p95_ms, (SELECT v[1 + CAST(floor((len(v) - 1) * 0.99) AS INT)] FROM v) AS api_latency_p99_ms,
  (SELECT count(*) FROM calls WHERE event_type = 'view' AND event_id % 3 > 0) AS cache_hits, (SELECT count(*) FROM calls WHERE event_type = 'view' AND event_id % 3 = 0) AS cache_misses,
  (SELECT count(*) FILTER (event_id % 3 > 0) / count(*) FROM calls WHERE event_type = 'view') AS cache_hit_rate, (SELECT arg_max(event_id, (sec, event_id)) FROM calls WHERE event_type = 'view') AS cache_size,
  (SELECT CAST(sum(latency) // count(latency) AS BIGINT) FROM ph) AS phase1_avg_ms, CAST(0 AS BIGINT) AS phase2_avg_ms, CAST(0 AS BIGINT) AS phase3_avg_ms, CAST(0 AS BIGINT) AS phase4_avg_ms,
  (SELECT count(*) FROM calls WHERE event_type = 'purchase') AS batches_processed, (SELECT CAST(sum(latency) AS BIGINT) FROM calls WHERE event_type = 'purchase') AS images_processed,
  (SELECT count(*) FROM calls WHERE event_type = 'error') AS circuit_breaker_trips, (SELECT max(sec) - min(sec) FROM calls) AS uptime_seconds)"""


@query(f"{_SNAPSHOT} SELECT * FROM snap")
def q_metrics_snapshot(spark, sf):
    return metrics.snapshot(_samples(spark, sf))


def _line(name: str, said: str, kind: str, *values: tuple[str, str]) -> str:
    lines = "".join(f" || '{name} {{{label}}} ' || {field} || chr(10)" for label, field in values)
    return f"'# HELP {name} {said}' || chr(10) || '# TYPE {name} {kind}' || chr(10)" + lines


_TEXT = " || chr(10) || ".join((
    _line("api_calls_total", "Total number of API calls made", "counter", ("", "api_calls_total")), _line("api_calls_success", "Number of successful API calls", "counter", ("", "api_calls_success")), _line("api_calls_failed", "Number of failed API calls", "counter", ("", "api_calls_failed")),
    _line("api_tokens_input_total", "Total input tokens consumed", "counter", ("", "api_tokens_input")), _line("api_tokens_output_total", "Total output tokens generated", "counter", ("", "api_tokens_output")), _line("api_latency_avg_ms", "Average API latency in milliseconds", "gauge", ("", "api_latency_avg_ms")),
    _line("cache_hit_rate", "Cache hit rate (0.0 to 1.0)", "gauge", ("", "cache_hit_rate")), _line("cache_size", "Current cache size", "gauge", ("", "cache_size")),
    _line("phase_avg_duration_ms", "Average phase duration in milliseconds", "gauge", *[(f'phase="{i}"', f"phase{i}_avg_ms") for i in (1, 2, 3, 4)]), _line("batches_processed_total", "Total number of batches processed", "counter", ("", "batches_processed")),
    _line("images_processed_total", "Total number of images processed", "counter", ("", "images_processed")), _line("circuit_breaker_trips_total", "Total circuit breaker trips", "counter", ("", "circuit_breaker_trips")), _line("uptime_seconds", "Application uptime in seconds", "counter", ("", "uptime_seconds")),
))


@query(f"{_SNAPSHOT} SELECT {_TEXT} AS text FROM snap")
def q_metrics_exposition(spark, sf):
    """All 13 families, with HELP and TYPE."""
    return metrics.exposition_text(metrics.snapshot(_samples(spark, sf)))


@query(f"{_SNAPSHOT}, j AS (SELECT CAST(to_json(snap) AS VARCHAR) AS value FROM snap) SELECT md5(value) AS digest, value FROM j")
def q_stats_json(spark, sf):
    return metrics.stats_json(metrics.snapshot(_samples(spark, sf))).select(F.md5("value").alias("digest"), "value")


@query(f"{CALLS} SELECT user_id, CAST(greatest(count(*) FILTER (ok) - count(*) FILTER (event_type = 'view') * 4, 0) AS BIGINT) AS estimate FROM calls GROUP BY user_id")
def q_hit_estimates(spark, sf):
    c = calls(spark, sf).groupBy("user_id").agg(F.count_if("ok").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return c.select("user_id", metrics.saturating(F.col("a"), F.col("b") * 4).alias("estimate"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN l_suppkey END), 0) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag")
def q_merged_metrics(spark, sf):
    """Rows of metrics added up; a column of nulls is 0."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("parts"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("suppliers"))
    return metrics.merged(rows, ["l_returnflag"])


@query("""WITH p AS (SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 10 ELSE 0 END) AS DOUBLE) AS p1, CAST(sum(CASE WHEN o_orderpriority LIKE '2%' THEN 10 ELSE 0 END) AS DOUBLE) AS p2, CAST(sum(CASE WHEN o_orderpriority LIKE '3%' THEN 10 ELSE 0 END) AS DOUBLE) AS p3, CAST(sum(CASE WHEN o_orderpriority LIKE '4%' THEN 10 ELSE 0 END) AS DOUBLE) AS p4 FROM orders GROUP BY 1)
SELECT o_custkey, p1 AS phase1_time_ms, p2 AS phase2_time_ms, p3 AS phase3_time_ms, p4 AS phase4_time_ms, round(p1 * 100 / t, 1) AS phase1_share, round(p2 * 100 / t, 1) AS phase2_share, round(p3 * 100 / t, 1) AS phase3_share, round(p4 * 100 / t, 1) AS phase4_share FROM (SELECT *, nullif(p1 + p2 + p3 + p4, 0) AS t FROM p)""")
def q_phase_shares(spark, sf):
    """Times of four phases and their shares of the whole; null without any time."""
    of = lambda i: F.sum(F.when(F.col("o_orderpriority").startswith(str(i)), 10).otherwise(0)).cast("double").alias(f"phase{i}_time_ms")
    return metrics.phase_shares(table(spark, sf, "orders").groupBy("o_custkey").agg(*[of(i) for i in (1, 2, 3, 4)]), ["o_custkey"])


# ---------------------------------------------------------------- requests, results and errors

_NUMBERED_CONFIG = '{"response_mime_type":"application/json","response_schema":{"type":"object","properties":{"translations":{"type":"array","items":{"type":"object","properties":{"bubble_number":{"type":"integer"},"original_text":{"type":"string"},"translated_text":{"type":"string"}},"required":["bubble_number","original_text","translated_text"]}}},"required":["translations"]}'


@query(f"""SELECT n_nationkey, thinking, '{{"contents":[{{"parts":[{{"inline_data":{{"mime_type":"image/png","data":"' || base64(encode(n_name)) || '"}}}},{{"text":"Translate to ' || n_name || '"}}]}}],"generationConfig":{_NUMBERED_CONFIG}' ||
CASE WHEN thinking THEN '' ELSE ',"thinkingConfig":{{"thinking_budget":0}}' END || '}}}}' AS body FROM nation, (SELECT unnest([true, false]) AS thinking)""")
def q_numbered_requests(spark, sf):
    """Request bodies with images, prompt, schema, and a budget of 0 unless thinking is on."""
    n = table(spark, sf, "nation")
    of = lambda thinking: n.select("n_nationkey", F.lit(thinking).alias("thinking"), writers.numbered_request(F.concat(F.lit("Translate to "), "n_name"), F.array(F.encode("n_name", "UTF-8")), thinking).alias("body"))
    return of(True).unionByName(of(False))


@query("""SELECT r_regionkey, 'm' AS model, 'system,user' AS roles, 'Translate each Japanese text to ' || r_name || '. Input:' || chr(10) || '[{"id":' || r_regionkey || ',"text":"' || r_name || '"}]' AS prompt, true AS strict, false AS more_fields, 65536 AS most, 'The region ID from the input' AS id_means FROM region""")
def q_structured_requests(spark, sf):
    """Bodies of text requests, read again by their paths."""
    items = F.array(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("text")))
    body = table(spark, sf, "region").select("r_regionkey", writers.structured_request("m", F.col("r_name"), items).alias("b"))
    at = lambda path: F.get_json_object("b", path)
    schema = "$.response_format.json_schema"
    return body.select(
        "r_regionkey", at("$.model").alias("model"), F.concat_ws(",", at("$.messages[0].role"), at("$.messages[1].role")).alias("roles"), at("$.messages[1].content").alias("prompt"), at(f"{schema}.strict").cast("boolean").alias("strict"),
        at(f"{schema}.schema.properties.translations.items.additionalProperties").cast("boolean").alias("more_fields"), at("$.max_completion_tokens").cast("int").alias("most"), at(f"{schema}.schema.properties.translations.items.properties.id.description").alias("id_means"),
    )


@query(f"""{DET}, p AS (SELECT page_index, count(*) AS n, max(score) AS best FROM det GROUP BY page_index),
e AS (SELECT *, CASE WHEN n < 3 THEN 'NoBubbles' WHEN best < 80 THEN 'AllKeysFailed' WHEN page_index % 11 = 0 THEN 'RateLimited' END AS error_kind FROM p)
SELECT page_index, error_kind, CASE error_kind WHEN 'NoBubbles' THEN 'No bubbles detected with confidence >= 0.3 (page ' || page_index || ')' WHEN 'AllKeysFailed' THEN 'All ' || n || ' API keys exhausted after ' || best || ' attempts'
  WHEN 'RateLimited' THEN 'Rate limit exceeded for API key (retry after ' || best || 's)' END AS error FROM e""")
def q_isolated_errors(spark, sf):
    """Pages with the first check that they fail: none is dropped."""
    p = detections(spark, sf, numbered=False).groupBy("page_index").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    checks = {
        "NoBubbles": (F.col("n") >= 3, errors.error_text("NoBubbles", threshold=F.lit(0.3), page_index=F.col("page_index"))),
        "AllKeysFailed": (F.col("best") >= 80, errors.error_text("AllKeysFailed", key_count=F.col("n"), attempts=F.col("best"))),
        "RateLimited": (F.col("page_index") % 11 != 0, errors.error_text("RateLimited", seconds=F.col("best"))),
    }
    return errors.isolated(p, checks).select("page_index", "error_kind", "error")


@query("""WITH p AS (SELECT n_nationkey AS i, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'broken' END AS error, n_nationkey * 1.5::DOUBLE AS ms FROM nation),
r AS (SELECT string_agg('{"index":' || i || ',"filename":"' || name || '","success":' || (error IS NULL) || ',"processing_time_ms":' || ms || CASE WHEN error IS NULL THEN ',"data_url":"data:image/png;base64,' || base64(encode(name)) || '"}' ELSE ',"error":"broken"}' END, ',' ORDER BY i) AS results FROM p)
SELECT '{"total":' || count(*) || ',"successful":' || count(*) FILTER (error IS NULL) || ',"failed":' || count(*) FILTER (error IS NOT NULL) || ',"processing_time_ms":' || sum(ms) || ',"average_time_per_page_ms":' || sum(ms) / count(*)
|| ',"analytics":{"total_images":' || count(*) || ',"total_regions":50,"simple_bg_count":25,"complex_bg_count":25,"label_0_count":25,"label_1_count":0,"label_2_count":25,"validation_warnings":0,"api_calls_simple":1,"api_calls_complex":25,"api_calls_banana":0,"input_tokens":250,"output_tokens":25,"cache_hits":0,"cache_misses":0,"phase1_time_ms":0.0,"phase2_time_ms":7.5,"phase3_time_ms":0.0,"phase4_time_ms":2.0,"total_time_ms":'
|| sum(ms) || ',"inference_time_ms":0.0,"api_wait_time_ms":0.0},"results":[' || (SELECT results FROM r) || ']}' AS value FROM p""")
def q_batch_response(spark, sf):
    """The response of a batch: a page for each nation, with a parent, its child and a free text each."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("page_index"), F.col("n_name").alias("filename"), F.encode("n_name", "UTF-8").alias("content"), F.when(F.col("n_regionkey") == 0, "broken").alias("error"), (F.col("n_nationkey") * F.lit(1.5)).alias("ms"))
    box = lambda i, label, x1, x2: F.struct(F.lit(i).alias("bubble_index"), F.lit(label).alias("label"), F.lit(x1).alias("x1"), F.lit(x1).alias("y1"), F.lit(x2).alias("x2"), F.lit(x2).alias("y2"), F.lit(1.0).alias("score"))
    det = n.select("page_index", F.explode(F.array(box(0, 0, 0, 100), box(1, 1, 10, 20), box(2, 2, 200, 210))).alias("b")).select("page_index", "b.*")
    readings = spark.createDataFrame([], "page_index long, region_id long, pos int, text string, confidence double")
    cache = spark.createDataFrame([], "key string, translated_text string")
    responses = spark.createDataFrame([], "page_index long, region_id long, translated_text string")
    stages = batch.process(det, readings, cache, responses, batch.Options(include_free_text=True))
    timings = n.limit(1).select(F.explode(F.array(F.struct(F.lit(2).alias("phase"), F.lit(7.5).alias("ms")), F.struct(F.lit(4).alias("phase"), F.lit(2.0).alias("ms")))).alias("t")).select("t.*")
    tokens = n.select(F.lit(10).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    return batch.batch_result(n, batch.results(n, stages), batch.batch_analytics(n, stages, timings, tokens))
