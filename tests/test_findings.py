"""Queries against their SQL on tables that the driver's small ones don't hold."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.plans import batch, catalog, relations

SF = Path("/root/testdata/sf0.001")


def same_as_sql(spark, folder, name):
    """The query's rows, which are those of its SQL over the Parquet files of the folder."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(tuple, df.select(*want.columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


@pytest.mark.parametrize(("name", "n"), [("q_vertical_extent", 1), ("q_vertical_extents", 6), ("q_profile_columns", 2), ("q_transitions", 2)])
def test_profiles_of_even_keys(spark, tmp_path, name, n):
    """Key 0 has an event each minute, so none of its places is above 1.2 * mean; key 1 has all events in one minute."""
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (CASE WHEN i < 60 THEN i ELSE 30 END) AS ts, i // 60 AS user_id FROM range(120) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert len(same_as_sql(spark, tmp_path, name)) == n


@pytest.fixture
def dealt(monkeypatch):
    """The smallest line items count as large ones, of 16 parts."""
    size = (SF / "lineitem.parquet").stat().st_size
    for name, value in (("SMALL_BYTES", 0), ("PART_BYTES", -(-size // 16))):
        monkeypatch.setattr(relations, name, value, raising=False)


def most_rows(df):
    """The rows of the largest part."""
    return df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]


def test_warning_counts_in_parts(spark, dealt):
    """Parts follow the table's bytes and aren't merged, and the table is read once."""
    df = catalog.QUERIES["q_warning_counts"](spark, str(SF))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    assert most_rows(df) < df.count() / 8


def test_cleaned_or_skipped_in_parts(spark, dealt):
    """The regions stay in their parts, and the valid pages are brought to them by one shuffle, their repeats removed there."""
    df = catalog.QUERIES["q_cleaned_or_skipped"](spark, str(SF))
    assert most_rows(df) < df.count() / 8
    plain = df.sparkSession.newSession()
    plain.conf.set("spark.sql.adaptive.enabled", "false")
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = catalog.QUERIES["q_cleaned_or_skipped"](plain, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", [
    "q_cleaned_or_skipped", "q_warning_counts", "q_failover", "q_renderable_regions", "q_batch_target_sizes", "q_crops_inside", "q_containment_join", "q_partial_overlap_warnings", "q_childless_parents", "q_orphan_regions",
    "q_region_counters", "q_iou_pairs", "q_nms_boxes", "q_first_match_box", "q_reading_order",
])
def test_parts_give_the_same_rows(spark, dealt, name):
    assert same_as_sql(spark, SF, name)


@pytest.mark.parametrize("large", [False, True])
def test_warnings_of_odd_boxes(spark, tmp_path, large, monkeypatch):
    """No page, no edges, equal boxes, and a page of 300 boxes."""
    if large:
        monkeypatch.setattr(relations, "SMALL_BYTES", 0)
    duckdb.sql(f"""COPY (SELECT CASE WHEN i % 7 = 0 THEN NULL WHEN i < 300 THEN 1 ELSE i // 5 END AS l_orderkey, CASE WHEN i % 11 > 0 THEN i * 7 % 23 END AS l_partkey, CASE WHEN i % 13 > 0 THEN i * 5 % 19 END AS l_suppkey,
      CAST(CASE WHEN i % 17 > 0 THEN i END AS INTEGER) AS l_linenumber, CASE WHEN i % 19 > 0 THEN i % 50 END::DOUBLE AS l_quantity, 0.05::DOUBLE AS l_discount FROM range(900) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    got = same_as_sql(spark, tmp_path, "q_warning_counts")
    assert None in {x[0] if x[0] is None else 0 for x in got} and max(x[1] for x in got) > 300


def test_warnings_of_boxes(spark):
    """A child half in one parent and inside another is no orphan; a null edge meets nothing."""
    det = spark.createDataFrame([(0, 0, 0, 0, 0, 9, 9), (0, 1, 0, 5, 0, 20, 9), (0, 2, 1, 6, 1, 12, 5), (0, 3, 1, None, 1, 8, 8), (0, 4, 2, 0, 0, 1, 1), (None, 0, 0, 0, 0, 9, 9), (None, 1, 1, 1, 1, 2, 2)], "page_index long, bubble_index int, label int, x1 int, y1 int, x2 int, y2 int")
    got = sorted(map(tuple, batch.warnings(det).collect()), key=repr)
    assert got == sorted([(0, 0, "no child"), (0, 2, "partial overlap"), (0, 3, "orphan"), (None, 0, "no child"), (None, 1, "orphan")], key=repr)
