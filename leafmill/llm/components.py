"""Connected components over edges of any number, in Spark: large-star and small-star rounds.

Each round hangs neighbours on smallest neighbours with a partial aggregate and a join, which AQE splits
where a node has very many edges; nothing is gathered on the driver but counts. Rounds are written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, scratch, written


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on its smallest neighbour (or on itself).

    The smallest neighbours are written first: then both sides of the join are shuffled for it
    alone, and AQE may split the rows of a node with very many neighbours.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them; edges go from larger to smaller.

    One exchange serves the minimum and the join: after a large-star step a node has few smaller neighbours left,
    namely the smallest ones of its former neighbours, however many larger ones hang on it.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(F.col("u"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, u: str = "u", v: str = "v", label: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Loops and null ends are no edges; repeated edges count once; no edges give an empty table. Rounds grow
    with the logarithm of the edges (squared at most), so 100 are never needed: more mean a fault, and are an error.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, outer: bool = False) -> tuple[str, DataFrame, tuple]:
        """df as a table, its path, and its count and checksum, taken while it is written (a repeated task may spoil them: a round more)."""
        path, seen = fresh_path(spark, label, outer), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["sum"])

    at, now, state = kept(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v")).distinct())
    for _ in range(most_rounds):
        before, last = at, state
        if not last[0]:
            break
        with scratch(spark, "round"):
            at, now, state = kept(_small(_large(now)).distinct(), outer=True)
        drop_path(spark, before)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
