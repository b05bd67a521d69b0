"""Quake-shaped inputs derived from the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.sphere import surface_vector
from tremorlake.schemas import UNIFIED_COLUMNS


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ratio(value: Column, by: float) -> Column:
    return value.cast("double") / F.lit(float(by))


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a seismic event in the unified schema, plus ``event_id``."""
    e = load(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    return e.select(
        event,
        event.cast("string").alias("id"),
        F.to_date("ts").alias("dt"),
        (F.col("value") / F.lit(50.0)).alias("magnitude"),
        F.lit("ml").alias("mag_type"),
        F.col("event_type").alias("place"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_utc"),
        (((user * 97) % 350 - 175).cast("double") + _ratio(event % 97, 97)).alias("longitude"),
        (((user * 37) % 170 - 85).cast("double") + _ratio(event % 100, 100)).alias("latitude"),
        _ratio((event * 31) % 7000, 10).alias("depth_km"),
        F.lit("USGS").alias("source_system"),
    )


QUAKES = """quakes as (
  select event_id, cast(event_id as varchar) as id, cast(ts as date) as dt,
         value / cast(50 as double) as magnitude, 'ml' as mag_type, event_type as place,
         epoch_us(ts) // 1000 as time_utc,
         cast((user_id * 97) % 350 - 175 as double)
           + cast(event_id % 97 as double) / cast(97 as double) as longitude,
         cast((user_id * 37) % 170 - 85 as double)
           + cast(event_id % 100 as double) / cast(100 as double) as latitude,
         cast((event_id * 31) % 7000 as double) / cast(10 as double) as depth_km,
         'USGS' as source_system
  from events)"""


def gappy_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quakes of which some lack id, time or latitude."""
    q, event = quakes(spark, sf_dir), F.col("event_id")
    return q.select(
        F.when(event % 11 != 0, F.col("id")).alias("id"),
        "dt",
        "magnitude",
        "mag_type",
        "place",
        F.when(event % 13 != 0, F.col("time_utc")).alias("time_utc"),
        "longitude",
        F.when(event % 17 != 0, F.col("latitude")).alias("latitude"),
        "depth_km",
        "source_system",
    )


GAPPY = """gappy as (
  select case when event_id % 11 <> 0 then id end as id, dt, magnitude, mag_type, place,
         case when event_id % 13 <> 0 then time_utc end as time_utc, longitude,
         case when event_id % 17 <> 0 then latitude end as latitude, depth_km, source_system
  from quakes)"""


def usgs_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sixths of the quakes as nested GeoJSON; some appear again a second later (a revision)."""
    q = quakes(spark, sf_dir).filter((F.col("event_id") % 3 != 0) | (F.col("event_id") % 6 == 3))
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1000))
    revised = q.withColumn("later", F.explode(F.when(F.col("event_id") % 10 == 1, twice).otherwise(once)))
    return revised.select(
        "id",
        F.struct(
            F.col("magnitude").alias("mag"),
            F.col("place"),
            (F.col("time_utc") + F.col("later")).alias("time"),
        ).alias("properties"),
        F.struct(F.array("longitude", "latitude", "depth_km").alias("coordinates")).alias("geometry"),
        "dt",
    )


def terraquake_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the quakes under other ids, with slightly other magnitudes and ISO text times."""
    q = quakes(spark, sf_dir).filter(F.col("event_id") % 2 == 0)
    iso = F.date_format(F.timestamp_millis("time_utc"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return q.select(
        F.struct(
            F.concat(F.lit("T"), F.col("id")).alias("eventId"),
            (F.col("magnitude") + _ratio(F.col("event_id") % 3, 10)).alias("mag"),
            F.lit("mw").alias("magType"),
            F.col("place"),
            iso.alias("time"),
        ).alias("properties"),
        F.struct(F.array("longitude", "latitude", "depth_km").alias("coordinates")).alias("geometry"),
        "dt",
    )


UNIFIED = """unified as (
  select id, dt, magnitude, mag_type, place, time_utc, longitude, latitude, depth_km, source_system
  from quakes where (event_id % 3 <> 0 or event_id % 6 = 3)
  union all
  select id, dt, magnitude, mag_type, place, time_utc + 1000, longitude, latitude, depth_km,
         source_system
  from quakes where (event_id % 3 <> 0 or event_id % 6 = 3) and event_id % 10 = 1
  union all
  select 'T' || id, dt, magnitude + cast(event_id % 3 as double) / cast(10 as double), 'mw', place,
         time_utc, longitude, latitude, depth_km, 'Terraquake'
  from quakes where event_id % 2 = 0)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 grid of boxes with shared edges, one per nation."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    row, column = F.floor(key / 5).cast("int"), key % 5
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        key.cast("int").alias("region_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("sub_region"),
        (row * 36 - 90).cast("double").alias("lat_min"),
        (row * 36 - 54).cast("double").alias("lat_max"),
        (column * 72 - 180).cast("double").alias("lon_min"),
        (column * 72 - 108).cast("double").alias("lon_max"),
    )


REGIONS = """regions as (
  select n_nationkey as region_id, r_name as region, n_name as sub_region,
         cast(-90 + 36 * (n_nationkey // 5) as double) as lat_min,
         cast(-54 + 36 * (n_nationkey // 5) as double) as lat_max,
         cast(-180 + 72 * (n_nationkey % 5) as double) as lon_min,
         cast(-108 + 72 * (n_nationkey % 5) as double) as lon_max
  from nation join region on n_regionkey = r_regionkey)"""


def small_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square box per customer, so the dimension grows with the data.

    The side shrinks with the root of their number: together the boxes always cover the same area.
    """
    customers = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    lat, lon = (key * 53) % 171 - 88, (key * 89) % 350 - 178
    side = F.lit(5.0) * F.sqrt(F.lit(150.0) / F.lit(customers.count()))
    return customers.select(
        key.cast("int").alias("region_id"),
        lat.cast("double").alias("lat_min"),
        (lat.cast("double") + side).alias("lat_max"),
        lon.cast("double").alias("lon_min"),
        (lon.cast("double") + side).alias("lon_max"),
    )


SMALL_BOXES = """regions as (
  select c_custkey as region_id,
         cast((c_custkey * 53) % 171 - 88 as double) as lat_min,
         cast((c_custkey * 53) % 171 - 88 as double)
           + cast(5 as double) * sqrt(cast(150 as double) / (select count(*) from customer)) as lat_max,
         cast((c_custkey * 89) % 350 - 178 as double) as lon_min,
         cast((c_custkey * 89) % 350 - 178 as double)
           + cast(5 as double) * sqrt(cast(150 as double) / (select count(*) from customer)) as lon_max
  from customer)"""


def _clusters(boxes: DataFrame, radius: Column) -> DataFrame:
    middle = surface_vector(
        (F.col("lat_min") + F.col("lat_max")) / 2.0, (F.col("lon_min") + F.col("lon_max")) / 2.0
    )
    return boxes.select(
        F.col("region_id").alias("cluster_id"),
        middle.x.alias("center_x"),
        middle.y.alias("center_y"),
        middle.z.alias("center_z"),
        radius.cast("double").alias("max_r_km"),
    )


def _clusters_sql(radius: str) -> str:
    lat, lon = "radians((lat_min + lat_max) / 2)", "radians((lon_min + lon_max) / 2)"
    return f"""clusters as (
  select region_id as cluster_id, cos({lat}) * cos({lon}) as center_x,
         cos({lat}) * sin({lon}) as center_y, sin({lat}) as center_z,
         cast({radius} as double) as max_r_km
  from regions)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spheres around the box middles."""
    return _clusters(regions(spark, sf_dir), F.lit(2500) + F.col("region_id") * 40)


CLUSTERS = _clusters_sql("2500 + region_id * 40")


def many_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sphere of 200 to 500 km per customer."""
    return _clusters(small_boxes(spark, sf_dir), F.lit(200) + F.col("region_id") % 300)


MANY_CLUSTERS = _clusters_sql("200 + region_id % 300")

#: First match: distance below the surface compared with the radius as a chord.
MATCHED = """points as (
  select *, (6371.0 - depth_km) / 6371.0 * cos(radians(latitude)) * cos(radians(longitude)) as px,
         (6371.0 - depth_km) / 6371.0 * cos(radians(latitude)) * sin(radians(longitude)) as py,
         (6371.0 - depth_km) / 6371.0 * sin(radians(latitude)) as pz
  from quakes),
hits as (
  select event_id, min(cluster_id) as cluster_id
  from points, clusters
  where (px - center_x) * (px - center_x) + (py - center_y) * (py - center_y)
        + (pz - center_z) * (pz - center_z) < (max_r_km / 6371.0) * (max_r_km / 6371.0)
  group by event_id),
matched as (select quakes.*, hits.cluster_id from quakes left join hits using (event_id))"""

SPHERE = """sphere as (
  select *, cos(radians(latitude)) * cos(radians(longitude)) as x,
         cos(radians(latitude)) * sin(radians(longitude)) as y, sin(radians(latitude)) as z
  from matched)"""


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def total_order_sql(first: list[str], columns: tuple[str, ...] = UNIFIED_COLUMNS) -> str:
    """The order of the dedup operators: given terms, then all other columns descending."""
    named = {term.split()[0] for term in first}
    rest = [f"{name} desc nulls last" for name in columns if name not in named]
    return ", ".join([*first, *rest])
