import datetime as dt
import math

from pyspark.sql import functions as F

from tremorlake.functions.packing import pack_day_key, packed_day, packed_key
from tremorlake.operators.daily_stats import daily_stats

DAY = dt.date(2024, 1, 1)
SCHEMA = "dt date, key int, id string, place string, magnitude double, depth_km double"
BIGGEST = {"top_id": "id", "top_place": "place"}


def stats(spark, rows, schema=SCHEMA):
    return daily_stats(spark.createDataFrame(rows, schema), "key", BIGGEST)


def test_magnitude_classes_and_nulls(spark):
    values = [None, 3.99, 4.0, 5.99, 6.0, float("nan")]
    rows = [(DAY, 1, str(i), "p", m, 1.0) for i, m in enumerate(values)]
    r = stats(spark, rows).first()
    assert (r["total_events"], r["mag_count_small"], r["mag_count_medium"], r["mag_count_large"]) == (6, 1, 2, 2)
    assert math.isnan(r["max_magnitude"]) and r["top_id"] == "5"


def test_measures(spark):
    rows = [(DAY, 1, "a", "p", 2.0, 10.0), (DAY, 1, "b", "q", 3.0, None), (DAY, 1, "c", "r", None, 30.0)]
    r = stats(spark, rows).first()
    assert (r["sum_magnitude"], r["avg_magnitude"], r["max_magnitude"]) == (5.0, 2.5, 3.0)
    assert (r["depth_sum"], r["avg_depth"], r["depth_min"], r["depth_max"]) == (40.0, 20.0, 10.0, 30.0)
    assert (r["top_id"], r["top_place"]) == ("b", "q")


def test_ties_go_to_the_largest_id_and_all_null_still_names_one(spark):
    rows = [(DAY, 1, i, i.upper(), 5.0, 1.0) for i in ("a", "c", "b")]
    rows += [(DAY, 2, i, i.upper(), None, 1.0) for i in ("a", "b")]
    got = {r["key"]: (r["top_id"], r["top_place"], r["max_magnitude"]) for r in stats(spark, rows).collect()}
    assert got == {1: ("c", "C", 5.0), 2: ("b", "B", None)}


def test_groups_with_null_keys_stay_apart(spark):
    days, keys = [DAY, None, dt.date(1900, 5, 5), dt.date(9999, 12, 31)], [1, -1, None, 2**31 - 1, -(2**31)]
    rows = [(d, k, "a", "p", 1.0, 1.0) for d in days for k in keys]
    got = {(r["dt"], r["key"]) for r in stats(spark, rows).collect()}
    assert got == {(d, k) for d in days for k in keys}
    packed = spark.createDataFrame(rows, SCHEMA).select(
        "dt", "key", pack_day_key(F.col("dt"), F.col("key")).alias("p")
    )
    back = packed.select("dt", "key", packed_day(F.col("p")).alias("d"), packed_key(F.col("p")).alias("k"))
    assert all(r["dt"] == r["d"] and r["key"] == r["k"] for r in back.collect())


def test_other_key_types_take_the_plain_path(spark, plan_of):
    schema = SCHEMA.replace("key int", "key string")
    df = stats(spark, [(DAY, "x", "a", "p", 1.0, 1.0), (DAY, "y", "b", "p", 2.0, 1.0)], schema)
    assert {(r["key"], r["top_id"]) for r in df.collect()} == {("x", "a"), ("y", "b")}
    assert "_day_key" not in plan_of(df)


def test_one_shuffle_of_partial_aggregates_on_one_key(spark, plan_of):
    plan = plan_of(stats(spark, [(DAY, 1, "a", "p", 1.0, 1.0)])).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_max(struct" in plan and "SortAggregate(key=[_day_key" in plan
