"""Relations derived from the driver's tables that stand for detector output and service events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, table_bytes

#: Bytes of line items in a part of pages, bytes that aren't dealt out, and the most parts: beyond them parts grow, and their sorts spill.
PART_BYTES, SMALL_BYTES, MOST_PARTS = 4_000_000, 16_000_000, 20_000


def page_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """How many parts the line items are dealt to; None for a small table.

    As many as Spark writes without sorting them in memory first hold PART_BYTES each; more are taken only where a part would have twice that.
    """
    size = table_bytes(table(spark, sf_dir, "lineitem"))
    if size <= SMALL_BYTES:
        return None
    unsorted = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parts = max(min(-(-size // PART_BYTES), unsorted), -(-size // (2 * PART_BYTES)))
    return max(min(parts, MOST_PARTS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, page: str, parts: int | None) -> DataFrame:
    """df with the rows of a page together, in so many parts.

    Spark would merge shuffled partitions to one a core, or up to 64 MB compressed, and a task's sorts take many times that.
    """
    return df if parts is None else df.repartition(parts, page)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, those of an order together, so that what a task sorts doesn't grow with the table."""
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", page_parts(spark, sf_dir))


def detections(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """A box a line item: page, label 0 to 2, box, score in hundredths, and, if numbered, the place on the page."""
    label = F.col("l_linenumber") % 3
    side = F.when(label == 0, F.lit(250)).otherwise(20 + F.col("l_quantity").cast("int"))
    x, y = ((F.col("l_partkey") % 40) * 10).cast("int"), ((F.col("l_suppkey") % 40) * 10).cast("int")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = line_items(spark, sf_dir) if numbered else table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("page_index"), label.cast("int").alias("label"), x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("score"), *[rank.alias("bubble_index")][:numbered],
    )


DET_SQL = """det AS (
  SELECT page_index, label, x1, y1, x1 + side AS x2, y1 + side AS y2, score, CAST(bubble_index AS INTEGER) AS bubble_index FROM (
    SELECT l_orderkey AS page_index, CAST(l_linenumber % 3 AS INTEGER) AS label,
      CAST((l_partkey % 40) * 10 AS INTEGER) AS x1, CAST((l_suppkey % 40) * 10 AS INTEGER) AS y1,
      CAST(CASE WHEN l_linenumber % 3 = 0 THEN 250 ELSE 20 + CAST(l_quantity AS INTEGER) END AS INTEGER) AS side,
      CAST(round(l_discount * 1000) AS INTEGER) AS score,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS bubble_index
    FROM lineitem))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as service calls: second, millisecond latency, outcome, key."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.round(F.col("value") * 100).cast("long").alias("latency"), (F.col("event_type") != "error").alias("ok"),
    )


CALLS_SQL = """calls AS (
  SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(round(value * 100) AS BIGINT) AS latency, event_type <> 'error' AS ok FROM events)"""
