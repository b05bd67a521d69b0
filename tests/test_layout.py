"""File layouts and what they save: incremental facts, buckets, footers, clustered files."""

import datetime as dt
import glob
import os
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tremorlake.operators.clusters import attach_assignment
from tremorlake.operators.curve import curve
from tremorlake.plans import serving
from tremorlake.plans.incremental import incremental_region_fact
from tremorlake.plans.region_fact import region_daily_fact
from tremorlake.schemas import REGION_SCHEMA
from tremorlake.sources.readers import scan_feed
from tremorlake.sources.writers import write_bucketed, write_clustered, write_parquet

EVENT = "id string, dt date, magnitude double, place string, latitude double, longitude double, depth_km double"
BOXES = [(1, "A", "a", 0.0, 10.0, 0.0, 10.0), (2, "A", "b", 10.0, 20.0, 0.0, 10.0)]


def day(n):
    return dt.date(2024, 1, n)


def append(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").partitionBy("dt").parquet(path)


def facts(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.collect())


def test_a_late_file_changes_its_days_only(spark, tmp_path):
    root = str(tmp_path)
    boxes = spark.createDataFrame(BOXES, REGION_SCHEMA)
    fact = incremental_region_fact(f"{root}/clean", boxes, f"{root}/state", f"{root}/fact")

    def stamps(n):
        return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/fact/dt={day(n)}/*.parquet")}

    def equal():
        columns = spark.read.parquet(f"{root}/fact").columns
        full = region_daily_fact(scan_feed(spark, f"{root}/clean"), boxes).select(*columns)
        return facts(spark.read.parquet(f"{root}/fact")) == facts(full)

    append(spark, f"{root}/clean", [(f"e{i}", day(1 + i % 3), i / 10, "p", float(i % 21), 5.0, float(i)) for i in range(40)])
    assert fact.update(spark) == [day(1), day(2), day(3)] and equal()
    assert fact.update(spark) == []
    before = [stamps(n) for n in (1, 2, 3)]
    # A late file: values missing, a new maximum, an edge of two boxes, one event in no box.
    late = [("late", day(2), 9.5, "q", 10.0, 5.0, None), ("none", day(2), None, "q", 1.0, 1.0, 3.0), ("out", day(2), 1.0, "q", 80.0, 1.0, 3.0)]
    append(spark, f"{root}/clean", late)
    assert fact.update(spark) == [day(2)] and equal()
    assert [stamps(1), stamps(3)] == [before[0], before[2]] and stamps(2) != before[1]
    # A replaced day and one that is gone; a day without any event in a box.
    other = spark.createDataFrame([("new", day(3), 1.0, "p", 1.0, 1.0, 1.0)], EVENT)
    write_parquet(other, f"{root}/clean", ["dt"], overwrite="partitions")
    for file in glob.glob(f"{root}/clean/dt={day(1)}/*.parquet"):
        os.remove(file)
    append(spark, f"{root}/clean", [("x", day(9), 1.0, "p", 80.0, 1.0, 1.0)])
    assert fact.update(spark) == [day(1), day(3), day(9)] and equal()
    assert {r["dt"] for r in spark.read.parquet(f"{root}/fact").select("dt").collect()} == {day(2), day(3)}


def test_bucketed_tables_join_without_a_shuffle(spark, plan_of):
    names = [f"b_{uuid.uuid4().hex}" for _ in range(2)]
    events = spark.range(1000).selectExpr("cast(id as string) id", "id * 2 as value")
    assignment = spark.range(0, 1000, 3).selectExpr("cast(id as string) id", "cast(id % 7 as int) cluster_id")
    for name, rows in zip(names, (events, assignment)):
        write_bucketed(rows, name, "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_assignment(*(spark.table(name) for name in names))
        plan = plan_of(joined).split("== Physical Plan ==")[1]
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 334
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"drop table {name}")


@pytest.fixture
def days(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(f"e{i}", day(1 + i % 4), i / 10, "p", 1.0, 1.0, 1.0) for i in range(40)]
    events = spark.createDataFrame(rows, EVENT).withColumnRenamed("dt", "day")
    write_parquet(events, path, ["day"])
    return path


def test_footers_answer_bounds_and_counts(spark, days, plan_of):
    plan = plan_of(serving.footer_days(spark, days))
    assert "PushedAggregation: [COUNT(*), MIN(magnitude), MAX(magnitude)]" in plan
    assert tuple(serving.bounds_of_files(spark, days).first()) == (day(1), day(4), 0.0, 3.9)
    assert serving.count_of_files(spark, days, day(2), day(3)).first()[0] == 20
    assert serving.count_of_files(spark, days, day(7), day(9)).first()[0] == 0
    assert "ParquetScan" not in plan_of(spark.read.parquet(days))  # the caller's session keeps its settings


def test_bounds_without_footer_ends_read_the_rows(spark, days):
    more = spark.createDataFrame([("nan", day(5), float("nan"), "p", 1.0, 1.0, 1.0)], EVENT).withColumnRenamed("dt", "day")
    more.write.mode("append").partitionBy("day").parquet(days)
    assert tuple(serving.bounds_of_files(spark, days).first()) == (day(1), day(5), 0.0, 3.9)


def test_the_curve_separates_places(spark):
    point = spark.createDataFrame([(day(1), 0.0, 0.0), (day(1), 0.0, 90.0), (day(9), 0.0, 0.0), (None, None, float("nan")), (day(1), 1e9, -1e9)], "day date, la double, lo double")
    first = (day(1) - dt.date(1970, 1, 1)).days
    got = [r[0] for r in point.select(curve(F.col("day"), F.col("la"), F.col("lo"), first, first + 8)).collect()]
    assert len(set(got)) == 5 and all(0 <= g < 1 << 30 for g in got)


def test_clustered_files_are_pruned_by_their_footers(spark, tmp_path):
    events = spark.range(20_000).selectExpr(
        "id", "date_add(date '2024-01-01', cast(id % 30 as int)) day",
        "cast((id * 7919) % 1700 as double) / 10 - 85 latitude", "cast((id * 104729) % 3500 as double) / 10 - 175 longitude",
    )
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    events.repartition(64).write.parquet(plain)
    write_clustered(events, laid, rows_per_file=20_000 // 64)

    def read(path):
        """Files whose footers do not rule the filter out."""
        n = 0
        for file in glob.glob(f"{path}/*.parquet"):
            ends = {}
            for group in range((meta := pq.ParquetFile(file).metadata).num_row_groups):
                for c in range(meta.num_columns):
                    stats = (column := meta.row_group(group).column(c)).statistics
                    ends[column.path_in_schema] = stats.min, stats.max
            wanted = {"day": (day(5), day(9)), "latitude": (10.0, 40.0), "longitude": (-60.0, 0.0)}
            n += all(ends[c][0] <= high and ends[c][1] >= low for c, (low, high) in wanted.items())
        return n

    assert read(plain) >= 4 * read(laid) > 0
    box = "day between '2024-01-05' and '2024-01-09' and latitude between 10 and 40 and longitude between -60 and 0"
    rows = [sorted(r["id"] for r in spark.read.parquet(path).where(box).collect()) for path in (plain, laid)]
    assert rows[0] == rows[1] and rows[0]
    assert spark.read.parquet(laid).count() == 20_000
