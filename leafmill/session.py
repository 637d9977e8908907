"""Session helpers shared by the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the query outputs rely on (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table, by Spark's own statistics; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
