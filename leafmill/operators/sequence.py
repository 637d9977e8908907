"""Sequences: projection profiles, runs, CTC decoding and the choice between two readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, place: str, on: Column) -> DataFrame:
    """(key, start, end): longest runs of consecutive places where `on` holds."""
    some = df.filter(on)
    run = F.col(place) - F.row_number().over(Window.partitionBy(key).orderBy(place))
    return some.withColumn("__run", run).groupBy(key, "__run").agg(F.min(place).alias("start"), F.max(place).alias("end")).drop("__run")


def profile_columns(df: DataFrame, key: str, place: str, value: str, share: float = 0.2, least: int = 15, pad: int = 2, narrow: int = 10) -> DataFrame:
    """Text columns of a projection profile, right to left (`position` from 0).

    A column is a run of values above share * mean, of max(width / 20, least) places or more, padded by `pad`
    to the left and by as much again to the right, within the width. Without any, or below `narrow` places, the whole is
    one column.
    """
    stats = df.groupBy(key).agg(F.avg(value).alias("__mean"), (F.max(place) + 1).alias("__width"))
    runs = islands(df.join(stats, key), key, place, F.col(value) > F.col("__mean") * share)
    runs = stats.join(runs, key, "left")
    width = F.col("end") - F.col("start") + 1
    fits = (width >= F.greatest(F.floor(F.col("__width") / 20), F.lit(least))) & (F.col("__width") >= narrow)
    x = F.greatest(F.col("start") - pad, F.lit(0))
    good = runs.filter(fits).select(key, x.alias("x"), F.least(width + 2 * pad, F.col("__width") - x).alias("width"))
    whole = stats.join(good.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("x"), F.col("__width").alias("width"))
    out = good.unionByName(whole)
    return out.select(key, F.col("x").cast("long").alias("x"), F.col("width").cast("long").alias("width"), (F.row_number().over(Window.partitionBy(key).orderBy(F.desc("x"))) - 1).cast("long").alias("position"))


def extent(df: DataFrame, key: str, place: str, value: str, share: float = 0.05, whole: bool = True) -> DataFrame:
    """First and last place above share * mean, padded by 2 before and 3 behind; if none is above, all places, or no row without `whole`."""
    stats = df.groupBy(key).agg(F.avg(value).alias("__mean"), (F.max(place) + 1).alias("__n"))
    hit = F.when(F.col(value) > F.col("__mean") * share, F.col(place))
    ends = df.join(stats, key).groupBy(key).agg(F.min(hit).alias("__a"), F.max(hit).alias("__b"), F.max("__n").alias("__n"))
    top, bottom = F.greatest(F.col("__a") - 2, F.lit(0)), F.least(F.col("__b") + 3, F.col("__n"))
    none = F.col("__a").isNull()
    ends = ends if whole else ends.filter(~none)
    return ends.select(key, F.when(none, 0).otherwise(top).cast("long").alias("top"), F.when(none, F.col("__n")).otherwise(bottom).cast("long").alias("bottom"))


def is_vertical(width: Column, height: Column, across: Column, down: Column) -> Column:
    """Does an image hold vertical text? By its shape, and by how often its row (`across`) and column (`down`) profiles
    cross 0.15 of their means."""
    aspect = height / width
    return F.when(width > height * 2, False).otherwise(((aspect > 1.3) & (across > down)) | (aspect > 2.0) | ((aspect > 1.0) & (across > down * 2)))


def transitions(df: DataFrame, key: str, place: str, on: Column) -> DataFrame:
    """How often `on` changes along the places."""
    before = F.lag("__on").over(Window.partitionBy(key).orderBy(place))
    return df.withColumn("__on", on).withColumn("__b", before).groupBy(key).agg(F.count_if(F.col("__b").isNotNull() & (F.col("__b") != F.col("__on"))).alias("transitions"))


def dark_threshold(total: Column, count: Column) -> Column:
    """Integer mean less 20, and 0 at least."""
    return F.greatest(F.floor(total / F.nullif(count, F.lit(0))) - 20, F.lit(0)).cast("long")


def arg_max(values: Column) -> Column:
    """Place of the first largest value of an array, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ctc_collapse(steps: Column, blank: int) -> Column:
    """Steps without repeats of the step before and without blanks."""
    return F.filter(steps, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(steps, i - 1))))


def ctc_confidence(best: Column) -> Column:
    """Mean of min(exp(logit), 1) of the steps; 0 without steps."""
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + F.least(F.exp(x.cast("double")), F.lit(1.0)))
    return F.when(F.size(best) > 0, total / F.size(best)).otherwise(F.lit(0.0))


def decode(steps: Column, vocabulary: Column) -> Column:
    """Text of collapsed steps by a map of characters; unknown places are '?'."""
    return F.array_join(F.transform(steps, lambda x: F.coalesce(F.try_element_at(vocabulary, x), F.lit("?"))), "")


def better_reading(text_a: Column, conf_a: Column, cjk_a: Column, text_b: Column, conf_b: Column, cjk_b: Column) -> Column:
    """Of two readings: the one of more CJK characters, then of no less confidence (the first on ties)."""
    first = (cjk_a > cjk_b) | ((cjk_a == cjk_b) & (conf_a >= conf_b))
    return F.when(first, text_a).otherwise(text_b)


def mean_accepted(rows: DataFrame, keys: list[str], accepted: Column, order: list[str], text: str, confidence: str) -> DataFrame:
    """Texts of the accepted columns of each key, in order and joined by line ends, and the mean of their confidences.

    Keys without an accepted column are left out: they are read as a whole instead.
    """
    entry = F.struct(*order, F.col(text).alias("__t"))
    out = rows.filter(accepted).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__l"), F.avg(confidence).alias("confidence"))
    return out.select(*keys, F.array_join(F.transform("__l", lambda x: x["__t"]), "\n").alias("text"), "confidence")
