import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tremorlake.schemas import REGION_SCHEMA, SERVING_SCHEMA, TRIAL_SCHEMA
from tremorlake.session import scratch_path, scratch_root
from tremorlake.sources.readers import (
    read_csv,
    read_regions,
    read_serving,
    register_partitions,
    scan_feed,
    scan_table,
    small_rows,
)
from tremorlake.sources.writers import Staged, balanced, write_csv, write_parquet, write_table

ONE, TWO = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex}"


def days(spark, rows):
    return spark.createDataFrame(rows, "v int, dt date")


def content(df):
    return sorted((r["v"], r["dt"]) for r in df.collect())


@pytest.mark.parametrize("with_path", [False, True])
@pytest.mark.parametrize("overwrite", ["full", "partitions"])
def test_overwrite_scope(spark, tmp_path, name, with_path, overwrite):
    path = str(tmp_path / "t") if with_path else None
    write_table(days(spark, [(1, ONE), (2, TWO)]), name, ["dt"], path)
    change = days(spark, [(20, TWO)]).select("dt", "v")
    write_table(change, name, ["dt"], path, overwrite)
    expected = [(20, TWO)] if overwrite == "full" else [(1, ONE), (20, TWO)]
    assert content(scan_table(spark, name)) == expected
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    # A second round behaves the same.
    write_table(days(spark, [(21, TWO)]), name, ["dt"], path, overwrite)
    assert content(scan_table(spark, name)) == [(v + (v == 20), d) for v, d in expected]


def test_first_partition_write_creates_the_table(spark, name):
    write_table(days(spark, [(1, ONE)]), name, ["dt"], overwrite="partitions")
    assert content(scan_table(spark, name)) == [(1, ONE)]


def test_unpartitioned_table_is_replaced(spark, name):
    for value in (1, 2):
        write_table(days(spark, [(value, ONE)]), name)
    assert content(scan_table(spark, name)) == [(2, ONE)]


def test_bad_arguments(spark, name):
    with pytest.raises(ValueError):
        write_table(days(spark, [(1, ONE)]), name, ["dt"], overwrite="some")
    with pytest.raises(ValueError):
        write_table(days(spark, [(1, ONE)]), name, overwrite="partitions")


def test_parquet_directory_scopes_and_feed_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    write_parquet(days(spark, [(1, ONE), (2, TWO)]), path, ["dt"])
    write_parquet(days(spark, [(3, TWO)]), path, ["dt"], overwrite="partitions")
    assert content(scan_feed(spark, path)) == [(1, ONE), (3, TWO)]
    assert content(scan_feed(spark, path + "/", ["dt=2024-01-02"])) == [(3, TWO)]
    write_parquet(days(spark, [(4, ONE)]), path, ["dt"])
    assert content(scan_feed(spark, path)) == [(4, ONE)]


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    hot = spark.range(400_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("cold")).otherwise(F.lit("hot")).alias("kind"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        write_parquet(hot.repartition(16), str(tmp_path / "d"), ["kind"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    files = {k: len([f for f in os.listdir(tmp_path / "d" / f"kind={k}") if f.endswith("parquet")]) for k in ("hot", "cold")}
    assert files["hot"] > 2
    assert spark.read.parquet(str(tmp_path / "d")).count() == 400_000


def test_a_small_result_is_one_file(spark, tmp_path):
    write_parquet(days(spark, [(i, ONE) for i in range(100)]).repartition(8), str(tmp_path / "d"))
    assert len([f for f in os.listdir(tmp_path / "d") if f.endswith("parquet")]) == 1


def test_csv_roundtrip(spark, tmp_path):
    rows = [(1, "A", "x, y", -10.5, 10.0, 0.0, 5.0)]
    path = str(tmp_path / "r")
    write_csv(spark.createDataFrame(rows, REGION_SCHEMA), path)
    assert [tuple(r) for r in read_regions(spark, path).collect()] == rows
    inferred = read_regions(spark, path, infer=True)
    assert dict(inferred.dtypes)["lat_min"] == "double" and dict(inferred.dtypes)["region_id"] == "int"
    trials = small_rows(spark, [(2, 0, 1.0, 2.0, 0.5)], TRIAL_SCHEMA)
    write_csv(trials, str(tmp_path / "m"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "m"), TRIAL_SCHEMA).collect()] == [(2, 0, 1.0, 2.0, 0.5)]


def test_new_partitions_are_registered(spark, tmp_path, name):
    path = str(tmp_path / "raw")
    write_parquet(days(spark, [(1, ONE)]), path, ["dt"])
    spark.sql(f"create table {name} (v int, dt date) using parquet partitioned by (dt) location '{path}'")
    assert scan_table(spark, name).isEmpty()
    register_partitions(spark, name)
    assert content(scan_table(spark, name)) == [(1, ONE)]


def test_serving_projection_prunes_columns(spark, tmp_path, plan_of, name):
    wide = spark.createDataFrame([], SERVING_SCHEMA).withColumn("extra", F.lit("x"))
    wide.write.parquet(str(tmp_path / "s"))
    df = read_serving(spark, options={"path": str(tmp_path / "s")})
    assert df.columns == SERVING_SCHEMA.names and "extra" not in plan_of(df).split("ReadSchema")[1]
    write_table(wide, name)
    assert read_serving(spark, name).columns == SERVING_SCHEMA.names


def test_staged_data_cuts_the_lineage_and_can_be_dropped(spark, plan_of):
    staged = Staged(days(spark, [(1, ONE)]), "test")
    assert staged.path.startswith(scratch_root(spark))
    assert content(staged.df) == [(1, ONE)] and "FileScan parquet" in plan_of(staged.df)
    staged.drop()
    assert not os.path.exists(staged.path.removeprefix("file:"))


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark) == configured.rstrip("/")


def test_rebalance_hint_is_in_the_plan(spark, plan_of):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(balanced(days(spark, [(1, ONE)]), "dt"))


def test_threads_overwrite_partitions_side_by_side(spark):
    """Two tables written at once lose no untouched partition, and the session's setting stays."""
    from concurrent.futures import ThreadPoolExecutor

    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    names = ["side_a", "side_b"]
    rows = spark.range(4).selectExpr("id", "concat('d', id % 2) as day")

    def rounds(name):
        for turn in range(4):
            write_table(rows, name, ["day"])
            write_table(spark.sql(f"select {turn + 10}L as id, 'd1' as day"), name, ["day"], overwrite="partitions")
            found = sorted((r.day, r.id) for r in spark.table(name).collect())
            assert found == [("d0", 0), ("d0", 2), ("d1", turn + 10)]
        return True

    with ThreadPoolExecutor(2) as pool:
        assert all(pool.map(rounds, names))
    assert spark.conf.get(setting) == before
    for name in names:
        spark.sql(f"drop table {name}")
