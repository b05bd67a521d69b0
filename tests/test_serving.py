import datetime as dt

import pytest
from pyspark.sql import functions as F

from tremorlake.plans import serving
from tremorlake.schemas import MAP_COLUMNS, SERVING_SCHEMA

ONE, TWO, THREE = (dt.date(2024, 1, d) for d in (1, 2, 3))


def events(spark, rows):
    """Rows of (day, id, magnitude, latitude, longitude)."""
    df = spark.createDataFrame(rows, "day date, id string, magnitude double, latitude double, longitude double")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in SERVING_SCHEMA if f.name not in df.columns]
    return df.select("*", *missing).select(*SERVING_SCHEMA.names)


@pytest.fixture
def sample(spark):
    nan = float("nan")
    return events(
        spark,
        [
            (ONE, "a", 1.0, 1.0, 2.0),
            (TWO, "b", 2.0, None, 2.0),
            (THREE, "c", 3.0, 5.0, nan),
            (None, "d", 4.0, 5.0, 6.0),
            (TWO, "e", None, 5.0, 6.0),
            (TWO, "f", nan, 5.0, 6.0),
        ],
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_ranges_are_inclusive_and_skip_missing(sample):
    assert ids(serving.filter_events(sample, ONE, THREE, 1.0, 3.0)) == ["a", "b", "c"]
    assert ids(serving.filter_events(sample, TWO, TWO, 0, 9)) == ["b"]
    assert serving.count_events(serving.filter_events(sample, ONE, TWO, 0, 9)).first()[0] == 2


def test_bounds_ignore_missing(sample):
    assert tuple(serving.bounds(sample).first()) == (ONE, THREE, 1.0, 4.0)


def test_map_points_have_positions(sample):
    points = serving.map_points(sample)
    assert tuple(points.columns) == MAP_COLUMNS
    assert sorted((r["lat"], r["lon"]) for r in points.collect()) == [(1.0, 2.0), (5.0, 6.0), (5.0, 6.0), (5.0, 6.0)]
    text = sample.withColumn("latitude", F.lit("x")).withColumn("longitude", F.lit("2"))
    assert serving.map_points(text).isEmpty()


def test_preview(spark, sample):
    sample.createOrReplaceTempView("sample_events")
    assert serving.preview(spark, "sample_events", 2).count() == 2
    top = serving.preview(spark, "sample_events", 2, [F.asc_nulls_last("day"), F.asc("id")])
    assert [r["id"] for r in top.collect()] == ["a", "b"]


def test_filters_and_pruning_reach_the_files(spark, tmp_path, sample, plan_of):
    sample.filter("day is not null").write.partitionBy("day").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = plan_of(serving.map_points(serving.filter_events(stored, ONE, TWO, 1.0, 2.0)))
    scan = plan.split("FileScan parquet")[-1]
    assert "day#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(magnitude,1.0)" in scan
    assert "depth_km" not in scan.split("ReadSchema")[1] and "mag_type" not in scan.split("ReadSchema")[1]
