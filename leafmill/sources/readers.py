"""Image folders, cache files and vocabularies as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_hex_key
from ..operators.batching import ordinal

#: Fixed values.
IMAGE_SUFFIXES = (".webp", ".png", ".jpg", ".jpeg")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(page_index, filename, content) of the images of a folder, in the order of their paths."""
    files = spark.read.format("binaryFile").load(folder).filter(F.lower("path").rlike(r"\.(webp|png|jpe?g)$"))
    named = files.select("path", F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("")), F.lit("unknown.png")).alias("filename"), "content")
    return ordinal(named, ["path"], "page_index").select("page_index", "filename", "content")


def required(files: DataFrame) -> DataFrame:
    """files, or an error if there is none: a request without images is refused."""
    if files.isEmpty():
        raise ValueError("No images provided")
    return files


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Bitmaps decoded by Spark's image source, with `error` for files that can't be decoded: their rows are kept."""
    image = F.col("image")
    out = spark.read.format("image").option("dropInvalid", False).load(folder)
    bad = image["height"] < 0
    size = lambda name: F.when(~bad, image[name]).alias(name)
    return out.select(image["origin"].alias("origin"), size("height"), size("width"), size("nChannels"), size("data"), F.when(bad, F.lit("image can't be decoded")).alias("error"))


def cache_entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, original_text, translated_text) of a cache kept as a JSON map of hexadecimal keys; malformed parts are dropped."""
    kind = "map<string,struct<original_text:string,translated_text:string>>"
    rows = lines.select(F.explode(F.coalesce(F.from_json(value, kind), F.create_map().cast(kind))).alias("k", "v"))
    return rows.select(parse_hex_key("k").alias("key"), "v.original_text", "v.translated_text").filter("key is not null")


def vocabulary(lines: DataFrame, value: str = "value") -> DataFrame:
    """(idx, ch, is_blank) of lines `index<TAB>character`; the last line of an index wins.

    Lines are trimmed first; `<blank>` marks the blank, `<space>` is a blank character; ASCII 32 to
    96 and index 0 have defaults.
    """
    spark = lines.sparkSession
    line = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    parts = F.split(line, "\t", 2)
    given = lines.withColumn("__n", F.monotonically_increasing_id()).select("__n", F.get(parts, F.lit(0)).try_cast("int").alias("idx"), F.get(parts, F.lit(1)).alias("raw"))
    given = given.filter("idx is not null and raw is not null and raw <> ''")
    given = given.select("idx", F.when(F.col("raw") == "<space>", " ").otherwise(F.col("raw")).alias("ch"), (F.col("raw") == "<blank>").alias("is_blank"), F.col("__n"))
    basic = spark.range(32, 97).select(F.col("id").cast("int").alias("idx"), F.char("id").alias("ch"))
    zero = spark.range(1).select(F.lit(0).alias("idx"), F.lit("").alias("ch"))
    default = basic.unionByName(zero).select("idx", "ch", F.lit(False).alias("is_blank"), F.lit(-1).cast("long").alias("__n"))
    return given.unionByName(default).groupBy("idx").agg(F.max_by(F.struct("ch", "is_blank"), "__n").alias("v")).select("idx", "v.ch", "v.is_blank")
