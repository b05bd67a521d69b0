import datetime as dt

from pyspark.sql import functions as F

from tremorlake.functions.times import event_day, event_timestamp
from tremorlake.operators.normalize import TERRAQUAKE, USGS, normalize_feed, union_feeds
from tremorlake.schemas import UNIFIED_COLUMNS

DAY = dt.date(2024, 1, 1)
MS = 1704067200500


def usgs(spark, rows, time="bigint", coordinates="array<double>"):
    return spark.createDataFrame(
        rows,
        f"id string, properties struct<mag:double,place:string,time:{time}>, "
        f"geometry struct<coordinates:{coordinates}>, dt date",
    )


def terraquake(spark, rows, time="string"):
    return spark.createDataFrame(
        rows,
        f"properties struct<eventId:bigint,mag:string,magType:string,place:string,time:{time}>, "
        "geometry struct<coordinates:array<string>>, dt date",
    )


def test_usgs_columns_and_constants(spark):
    df = normalize_feed(usgs(spark, [("a", (4.5, "here", MS), ([10.0, 20.0, 30.0],), DAY)]), USGS)
    assert tuple(df.columns) == UNIFIED_COLUMNS
    assert df.first().asDict() == {
        "id": "a",
        "dt": DAY,
        "magnitude": 4.5,
        "mag_type": "ml",
        "place": "here",
        "time_utc": MS,
        "longitude": 10.0,
        "latitude": 20.0,
        "depth_km": 30.0,
        "source_system": "USGS",
    }


def test_short_empty_and_missing_coordinates_give_null(spark):
    rows = [
        ("two", (1.0, "p", MS), ([1.0, 2.0],), DAY),
        ("none", (1.0, "p", MS), ([],), DAY),
        ("null", (1.0, "p", MS), (None,), DAY),
    ]
    got = {r["id"]: r for r in normalize_feed(usgs(spark, rows), USGS).collect()}
    assert (got["two"]["longitude"], got["two"]["latitude"], got["two"]["depth_km"]) == (1.0, 2.0, None)
    assert got["none"]["longitude"] is None and got["null"]["latitude"] is None


def test_times_of_every_kind_become_milliseconds(spark):
    texts = [str(MS), "2024-01-01T00:00:00.500Z", "junk", "", None, "99999999999999999999"]
    rows = [((i, "5.5", "mw", "p", t), (["1", "x", "3"],), DAY) for i, t in enumerate(texts)]
    got = normalize_feed(terraquake(spark, rows), TERRAQUAKE).orderBy("id").collect()
    assert [r["time_utc"] for r in got] == [MS, MS, None, None, None, None]
    assert got[0]["id"] == "0" and got[0]["magnitude"] == 5.5
    assert (got[0]["longitude"], got[0]["latitude"], got[0]["depth_km"]) == (1.0, None, 3.0)

    stamp = dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    for kind in ("timestamp", "timestamp_ntz"):
        feed = spark.createDataFrame([(str(stamp),)], "t string").select(
            F.lit("a").alias("id"),
            F.struct(F.lit(1.0).alias("mag"), F.lit("p").alias("place"), F.col("t").cast(kind).alias("time")).alias(
                "properties"
            ),
            F.struct(F.array(F.lit(1.0)).alias("coordinates")).alias("geometry"),
            F.lit(DAY).alias("dt"),
        )
        assert normalize_feed(feed, USGS).first()["time_utc"] == MS


def test_union_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert sorted(map(tuple, union_feeds([a, b]).collect())) == [(1, "x"), (2, "y")]


def test_message_times(spark):
    texts = [str(MS), "2024-01-01T00:00:00.500Z", "junk", "", None, "9" * 30, "-5", "123\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    at = event_timestamp(F.col("t"))
    got = df.select("i", F.unix_millis(at).alias("ms"), event_day(at).alias("day")).orderBy("i").collect()
    assert [r["ms"] for r in got] == [MS, MS, None, None, None, None, None, 123]
    assert got[0]["day"] == DAY and got[2]["day"] is None
