"""The registered queries: name -> (Spark callable, SQL text or None).

Every query reads whole test tables. A query without SQL is one whose result depends on a clustering
fit; its totals are checked by a second query that has SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.checks import views as V
from tremorlake.checks.present import shown, shown_sql
from tremorlake.functions.sphere import Vector, latitude_of, longitude_of
from tremorlake.functions.times import event_day, event_timestamp
from tremorlake.operators.clustering import sphere_dimension, zone_dimension
from tremorlake.operators.clusters import (
    attach_assignment,
    distance_to_centre,
    match_clusters,
    nearest_clusters,
)
from tremorlake.operators.dedup import dedup_both, dedup_latest
from tremorlake.operators.features import feature_moments, sphere_features
from tremorlake.operators.normalize import TERRAQUAKE, USGS, normalize_feed, union_feeds
from tremorlake.operators.regions import BoxPlan, locate
from tremorlake.plans import serving
from tremorlake.plans.clean import clean_events
from tremorlake.plans.cluster_facts import (
    cluster_spheres,
    cluster_zones,
    sphere_daily_fact,
    zone_daily_fact,
)
from tremorlake.plans.incremental import incremental_region_fact
from tremorlake.plans.region_fact import region_daily_fact
from tremorlake.schemas import REGION_SCHEMA, SPHERE_DIMENSION_SCHEMA
from tremorlake.session import scratch_path
from tremorlake.sources.readers import (
    read_csv,
    read_regions,
    read_serving,
    register_partitions,
    scan_feed,
    scan_table,
)
from tremorlake.sources.versions import Snapshots
from tremorlake.sources.writers import write_bucketed, write_clustered, write_csv, write_parquet, write_table
from tremorlake.streaming.ingest import (
    ParquetServing,
    enrich,
    latest_per_key,
    start_ingest,
    stream_source,
)
from tremorlake.streaming.parse import parse_json

Query = Callable[[SparkSession, str], DataFrame]


class Check(NamedTuple):
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        CHECKS[name] = Check(run, sql)
        return run

    return add


# --- columns as shown --------------------------------------------------------------------------

UNIFIED = {
    "id": "text",
    "dt": "day",
    "magnitude": "num",
    "mag_type": "text",
    "place": "text",
    "time_utc": "int",
    "longitude": "num",
    "latitude": "num",
    "depth_km": "num",
    "source_system": "text",
}
_COUNTS = {
    "total_events": "int",
    "mag_count_small": "int",
    "mag_count_medium": "int",
    "mag_count_large": "int",
}
_MEASURES = {
    "sum_magnitude": "r6",
    "avg_magnitude": "r10",
    "max_magnitude": "num",
    "depth_sum": "r6",
    "avg_depth": "r9",
    "depth_min": "num",
    "depth_max": "num",
}
REGION_FACT = {
    "dt": "day",
    "region_id": "int",
    **_COUNTS,
    **_MEASURES,
    "max_mag_event_id": "text",
    "max_mag_event_place": "text",
}
SPHERE_FACT = {
    "cluster_id": "int",
    **_COUNTS,
    **_MEASURES,
    "max_mag_event_id": "text",
    "max_mag_event_longitude": "num",
    "max_mag_event_latitude": "num",
    "max_mag_event_depth_km": "num",
    "max_mag_event_place": "text",
    "dt": "day",
}
ZONE_FACT = {
    "cluster_id": "int",
    "total_events": "int",
    "avg_magnitude": "r10",
    "max_magnitude": "num",
    "mag_count_large": "int",
    "avg_depth": "r9",
    "depth_min": "num",
    "depth_max": "num",
    "max_mag_event_id": "text",
    "dt": "day",
}
ENRICHED = {
    "day": "day",
    "id": "text",
    "time_ms": "int",
    "magnitude": "num",
    "mag_type": "text",
    "place": "text",
    "latitude": "num",
    "longitude": "num",
    "depth_km": "num",
    "source": "text",
    "region_id": "int",
    "region": "text",
    "sub_region": "text",
    "cluster_id": "int",
}
LOCATED = {"event_id": "int", "region_id": "int", "region": "text", "sub_region": "text"}
TOTALS = {"dt": "day", **_COUNTS, "sum_magnitude": "r6", "max_magnitude": "num", "depth_min": "num"}

INSIDE = (
    "latitude >= lat_min and latitude <= lat_max and longitude >= lon_min and longitude <= lon_max"
)


def _fact_sql(source: str, key: str, biggest: dict[str, str]) -> str:
    """Daily statistics per (dt, key) of a CTE, with the biggest event by row_number."""
    payload = ", ".join(f"max(case when best = 1 then {col} end) as {name}" for name, col in biggest.items())
    return f"""ranked as (
  select *, row_number() over (partition by dt, {key}
                               order by magnitude desc nulls last, id desc) as best
  from {source}),
fact as (
  select dt, {key}, count(*) as total_events,
         sum(case when magnitude < 4 then 1 else 0 end) as mag_count_small,
         sum(case when magnitude >= 4 and magnitude < 6 then 1 else 0 end) as mag_count_medium,
         sum(case when magnitude >= 6 then 1 else 0 end) as mag_count_large,
         sum(magnitude) as sum_magnitude, avg(magnitude) as avg_magnitude,
         max(magnitude) as max_magnitude, sum(depth_km) as depth_sum, avg(depth_km) as avg_depth,
         min(depth_km) as depth_min, max(depth_km) as depth_max, {payload}
  from ranked group by dt, {key})"""


# --- cleaning ----------------------------------------------------------------------------------


def _feeds(spark: SparkSession, sf_dir: str) -> list:
    return [(V.usgs_feed(spark, sf_dir), USGS), (V.terraquake_feed(spark, sf_dir), TERRAQUAKE)]


@_register("quake_unify", V.with_sql(V.QUAKES, V.UNIFIED) + shown_sql(UNIFIED, "unified"))
def quake_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = [normalize_feed(feed, layout) for feed, layout in _feeds(spark, sf_dir)]
    return shown(union_feeds(feeds), UNIFIED)


@_register("feed_scan", V.with_sql(V.QUAKES, V.UNIFIED) + shown_sql(UNIFIED, "unified"))
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested feeds written as Parquet by day, scanned whole and partition by partition."""
    usgs, terraquake = scratch_path(spark, "usgs"), scratch_path(spark, "terraquake")
    write_parquet(V.usgs_feed(spark, sf_dir), usgs, ["dt"])
    write_parquet(V.terraquake_feed(spark, sf_dir), terraquake, ["dt"])
    halves = ["dt=????-??-[01]?", "dt=????-??-[23]?", "dt=[!0-9]*"]  # the last: no day
    present = [glob for glob in halves if _matches(spark, f"{terraquake}/{glob}")]
    feeds = [
        normalize_feed(scan_feed(spark, usgs), USGS),
        normalize_feed(scan_feed(spark, terraquake, present), TERRAQUAKE),
    ]
    return shown(union_feeds(feeds), UNIFIED)


def _matches(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


_LATEST = f"""latest as (
  select * exclude (rn) from (
    select *, row_number() over (partition by id order by {V.total_order_sql(["time_utc desc nulls last"])}) as rn
    from {{source}}) where rn = 1 or {{kept}})"""

_FUZZY_FIRST = [
    "case source_system when 'USGS' then 1 when 'Terraquake' then 2 else 3 end asc",
    "source_system desc nulls last",
    "magnitude desc nulls last",
    "id desc nulls last",
]
_BUCKETS = "floor(time_utc / 60000.0), floor(latitude * 10), floor(longitude * 10)"
_CLEAN = f"""clean as (
  select * exclude (rn) from (
    select *, row_number() over (partition by {_BUCKETS} order by {V.total_order_sql(_FUZZY_FIRST)}) as rn
    from latest) where rn = 1 or {{kept}})"""


def _clean_sql(source: str, keep: bool) -> list[str]:
    no_id = "id is null" if keep else "false"
    no_bucket = "time_utc is null or latitude is null or longitude is null" if keep else "false"
    return [_LATEST.format(source=source, kept=no_id), _CLEAN.format(kept=no_bucket)]


@_register(
    "quake_dedup_exact",
    V.with_sql(V.QUAKES, V.UNIFIED, _clean_sql("unified", True)[0]) + shown_sql(UNIFIED, "latest"),
)
def quake_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = [normalize_feed(feed, layout) for feed, layout in _feeds(spark, sf_dir)]
    return shown(dedup_latest(union_feeds(feeds)), UNIFIED)


@_register(
    "quake_clean",
    V.with_sql(V.QUAKES, V.UNIFIED, *_clean_sql("unified", True)) + shown_sql(UNIFIED, "clean"),
)
def quake_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(clean_events(_feeds(spark, sf_dir)), UNIFIED)


@_register(
    "quake_clean_gaps_kept",
    V.with_sql(V.QUAKES, V.GAPPY, *_clean_sql("gappy", True)) + shown_sql(UNIFIED, "clean"),
)
def quake_clean_gaps_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dedup_both(V.gappy_quakes(spark, sf_dir), null_keys="keep"), UNIFIED)


@_register(
    "quake_clean_gaps_collapsed",
    V.with_sql(V.QUAKES, V.GAPPY, *_clean_sql("gappy", False)) + shown_sql(UNIFIED, "clean"),
)
def quake_clean_gaps_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(dedup_both(V.gappy_quakes(spark, sf_dir), null_keys="collapse"), UNIFIED)


# --- regions -----------------------------------------------------------------------------------

_LOCATED = f"located as (select * from quakes join regions on {INSIDE})"
_REGION_SQL = _fact_sql(
    "located", "region_id", {"max_mag_event_id": "id", "max_mag_event_place": "place"}
)


@_register(
    "region_daily_stats",
    V.with_sql(V.QUAKES, V.REGIONS, _LOCATED, _REGION_SQL) + shown_sql(REGION_FACT, "fact"),
)
def region_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = region_daily_fact(V.quakes(spark, sf_dir), V.regions(spark, sf_dir))
    return shown(fact, REGION_FACT)


@_register(
    "region_daily_stats_many_boxes",
    V.with_sql(V.QUAKES, V.SMALL_BOXES, _LOCATED, _REGION_SQL) + shown_sql(REGION_FACT, "fact"),
)
def region_daily_stats_many_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = region_daily_fact(V.quakes(spark, sf_dir), V.small_boxes(spark, sf_dir))
    return shown(fact, REGION_FACT)


@_register(
    "region_daily_stats_incremental",
    V.with_sql(V.QUAKES, V.REGIONS, _LOCATED, _REGION_SQL) + shown_sql(REGION_FACT, "fact"),
)
def region_daily_stats_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact kept up to date over three deliveries: most events, late ones for all days, a replaced day."""
    root, quakes = scratch_path(spark, "incremental"), V.quakes(spark, sf_dir)
    fact = incremental_region_fact(f"{root}/clean", V.regions(spark, sf_dir), f"{root}/state", f"{root}/fact")
    late = F.col("event_id") % 5 == 0
    for delivery in (quakes.where(~late), quakes.where(late)):
        delivery.write.mode("append").partitionBy("dt").parquet(f"{root}/clean")
        fact.update(spark)
    day = quakes.agg(F.min("dt")).first()[0]
    write_parquet(quakes.where(F.col("dt") == F.lit(day)), f"{root}/clean", ["dt"], overwrite="partitions")
    fact.update(spark)
    return shown(spark.read.parquet(f"{root}/fact"), REGION_FACT)


_LEFT_SQL = V.with_sql(
    V.QUAKES, V.REGIONS, f"located as (select * from quakes left join regions on {INSIDE})"
) + shown_sql(LOCATED, "located")
_INNER_SQL = V.with_sql(V.QUAKES, V.REGIONS, _LOCATED) + shown_sql(LOCATED, "located")


def _located(spark: SparkSession, sf_dir: str, how: str, plan: BoxPlan | None) -> DataFrame:
    located = locate(V.quakes(spark, sf_dir), V.regions(spark, sf_dir), how, plan)
    return shown(located, LOCATED)


@_register("region_enrich_left", _LEFT_SQL)
def region_enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, "left", None)


@_register("region_enrich_grid", _INNER_SQL)
def region_enrich_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, "inner", BoxPlan("broadcast_cells", 5.0))


@_register("region_enrich_grid_shuffled", _LEFT_SQL)
def region_enrich_grid_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, "left", BoxPlan("shuffle_cells", 5.0, salts=8))


_FIRST_SQL = V.with_sql(
    V.QUAKES,
    V.REGIONS,
    f"""firsts as (select event_id, min(region_id) as region_id from quakes join regions on {INSIDE} group by event_id),
located as (select quakes.*, regions.* from quakes left join firsts using (event_id)
            left join regions on regions.region_id = firsts.region_id)""",
) + shown_sql(LOCATED, "located")


def _first_located(spark: SparkSession, sf_dir: str, plan: BoxPlan | None) -> DataFrame:
    found = locate(V.quakes(spark, sf_dir), V.regions(spark, sf_dir), "left", plan, resolve="first")
    return shown(found, LOCATED)


@_register("region_enrich_first", _FIRST_SQL)
def region_enrich_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once: on an edge that boxes share, the box with the lowest id."""
    return _first_located(spark, sf_dir, None)


@_register("region_enrich_first_shuffled", _FIRST_SQL)
def region_enrich_first_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_located(spark, sf_dir, BoxPlan("shuffle_cells", 5.0))


# --- geometry and clusters ---------------------------------------------------------------------

_ALL_POINTS = V.SPHERE.replace("from matched", "from quakes")


@_register(
    "unit_sphere",
    V.with_sql(V.QUAKES, _ALL_POINTS)
    + shown_sql({"event_id": "int", "x": "r9", "y": "r9", "z": "r9"}, "sphere"),
)
def unit_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sphere_features(V.quakes(spark, sf_dir))
    return shown(points, {"event_id": "int", "x": "r9", "y": "r9", "z": "r9"})


_MOMENTS = {"count": "int", "mean_x": "r9", "mean_y": "r9", "mean_z": "r9", "total_ss": "r6"}


@_register(
    "feature_moments",
    V.with_sql(
        V.QUAKES,
        _ALL_POINTS,
        "means as (select avg(x) as mx, avg(y) as my, avg(z) as mz from sphere)",
        """moments as (
  select count(*) as "count", any_value(mx) as mean_x, any_value(my) as mean_y, any_value(mz) as mean_z,
         sum((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) as total_ss
  from sphere, means)""",
    )
    + shown_sql({'"count"': "int", **{k: v for k, v in _MOMENTS.items() if k != "count"}}, "moments"),
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(feature_moments(sphere_features(V.quakes(spark, sf_dir))), _MOMENTS)


@_register(
    "position_roundtrip",
    V.with_sql(
        V.QUAKES,
        _ALL_POINTS,
        """back as (
  select event_id, degrees(asin(z / sqrt(x * x + y * y + z * z))) as lat,
         degrees(atan2(y, x)) as lon from sphere)""",
    )
    + shown_sql({"event_id": "int", "lat": "r6", "lon": "r6"}, "back"),
)
def position_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sphere_features(V.quakes(spark, sf_dir))
    axis = Vector(F.col("x"), F.col("y"), F.col("z"))
    back = points.select(
        "event_id", latitude_of(axis).alias("lat"), longitude_of(axis).alias("lon")
    )
    return shown(back, {"event_id": "int", "lat": "r6", "lon": "r6"})


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quakes inside a given sphere, with its id."""
    matched = match_clusters(V.quakes(spark, sf_dir), V.clusters(spark, sf_dir))
    return matched.filter(F.col("cluster_id").isNotNull())


_MATCH = [V.QUAKES, V.REGIONS, V.CLUSTERS, V.MATCHED]
_MATCH_COLUMNS = {"event_id": "int", "cluster_id": "int"}
_MEMBERS = "members as (select * from matched where cluster_id is not null)"


@_register("cluster_first_match", V.with_sql(*_MATCH) + shown_sql(_MATCH_COLUMNS, "matched"))
def cluster_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_clusters(V.quakes(spark, sf_dir), V.clusters(spark, sf_dir))
    return shown(matched, _MATCH_COLUMNS)


_MANY_SQL = V.with_sql(V.QUAKES, V.SMALL_BOXES, V.MANY_CLUSTERS, V.MATCHED) + shown_sql(
    _MATCH_COLUMNS, "matched"
)


@_register("cluster_first_match_many", _MANY_SQL)
def cluster_first_match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_clusters(V.quakes(spark, sf_dir), V.many_clusters(spark, sf_dir))
    return shown(matched, _MATCH_COLUMNS)


@_register("cluster_first_match_passes", _MANY_SQL)
def cluster_first_match_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same match with a dimension beyond the broadcast bound: one shuffle by cube."""
    clusters = V.many_clusters(spark, sf_dir)
    per_pass = max(1, clusters.count() // 3)
    return shown(match_clusters(V.quakes(spark, sf_dir), clusters, per_pass=per_pass), _MATCH_COLUMNS)


@_register("cluster_first_match_hot", V.with_sql(*_MATCH) + shown_sql(_MATCH_COLUMNS, "matched"))
def cluster_first_match_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled match with so low a bound that most cubes are hot and dealt by salt."""
    matched = match_clusters(V.quakes(spark, sf_dir), V.clusters(spark, sf_dir), per_pass=1, hot_events=2)
    return shown(matched, _MATCH_COLUMNS)


_NEAREST_COLUMNS = {"event_id": "int", "cluster_id": "int", "is_nearest": "bool"}
_NEAREST_SQL = """ranked as (
  select event_id, arg_min(cluster_id, struct_pack(d := power(px - center_x, 2) + power(py - center_y, 2)
         + power(pz - center_z, 2), c := cluster_id)) as near_id
  from points, clusters group by event_id),
nearest as (
  select matched.event_id, coalesce(cluster_id, near_id) as cluster_id, cluster_id is null as is_nearest
  from matched join ranked using (event_id))"""


@_register("cluster_nearest", V.with_sql(*_MATCH, _NEAREST_SQL) + shown_sql(_NEAREST_COLUMNS, "nearest"))
def cluster_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in no sphere get the cluster with the nearest centre, by ring search."""
    return shown(nearest_clusters(V.quakes(spark, sf_dir), V.clusters(spark, sf_dir)), _NEAREST_COLUMNS)


_MANY_NEAREST_SQL = V.with_sql(V.QUAKES, V.SMALL_BOXES, V.MANY_CLUSTERS, V.MATCHED, _NEAREST_SQL)


@_register("cluster_nearest_many", _MANY_NEAREST_SQL + shown_sql(_NEAREST_COLUMNS, "nearest"))
def cluster_nearest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring search beyond the broadcast bound."""
    found = nearest_clusters(V.quakes(spark, sf_dir), V.many_clusters(spark, sf_dir), per_pass=10)
    return shown(found, _NEAREST_COLUMNS)


_DISTANCE = """distances as (
  select event_id, s.cluster_id,
         case when c.cluster_id is null then 0 else
           acos(greatest(-1, least(1, (x * center_x + y * center_y + z * center_z)
                / sqrt(center_x * center_x + center_y * center_y + center_z * center_z)))) * 6371.0
         end as dist_km
  from sphere s left join clusters c on s.cluster_id = c.cluster_id)"""
_DISTANCE_COLUMNS = {"event_id": "int", "cluster_id": "int", "dist_km": "r6"}


@_register(
    "great_circle_to_centres",
    V.with_sql(*_MATCH, V.SPHERE, _DISTANCE) + shown_sql(_DISTANCE_COLUMNS, "distances"),
)
def great_circle_to_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched events stay, at distance 0."""
    centres = V.clusters(spark, sf_dir)
    matched = match_clusters(V.quakes(spark, sf_dir), centres)
    return shown(distance_to_centre(sphere_features(matched), centres), _DISTANCE_COLUMNS)


_SPHERE_DIM_SQL = """dim as (
  select c.cluster_id, center_x, center_y, center_z, degrees(asin(center_z)) as center_lat,
         degrees(atan2(center_y, center_x)) as center_lon, coalesce(far, 0) as max_r_km
  from clusters c left join (
    select cluster_id, max(dist_km) as far from distances group by cluster_id) f
  on c.cluster_id = f.cluster_id)"""
_SPHERE_DIM = {
    "cluster_id": "int",
    "center_x": "r9",
    "center_y": "r9",
    "center_z": "r9",
    "center_lat": "r6",
    "center_lon": "r6",
    "max_r_km": "r6",
}


@_register(
    "cluster_dim_centres",
    V.with_sql(*_MATCH, V.SPHERE, _DISTANCE, _SPHERE_DIM_SQL) + shown_sql(_SPHERE_DIM, "dim"),
)
def cluster_dim_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = V.clusters(spark, sf_dir).drop("max_r_km")
    return shown(sphere_dimension(centres, sphere_features(_assigned(spark, sf_dir))), _SPHERE_DIM)


_ZONE_DIM = {
    "cluster_id": "int",
    "centroid_lat": "r9",
    "centroid_lon": "r9",
    "cluster_radius_km": "r6",
    "event_count_in_cluster": "int",
}


@_register(
    "cluster_dim_members",
    V.with_sql(
        *_MATCH,
        _MEMBERS,
        """dim as (
  select cluster_id, avg(latitude) as centroid_lat, avg(longitude) as centroid_lon,
         (stddev_samp(latitude) + stddev_samp(longitude)) * 111.0 as cluster_radius_km,
         count(*) as event_count_in_cluster
  from members group by cluster_id)""",
    )
    + shown_sql(_ZONE_DIM, "dim"),
)
def cluster_dim_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the creation date, which is today's."""
    return shown(zone_dimension(_assigned(spark, sf_dir)), _ZONE_DIM)


_SPHERE_FACT_SQL = _fact_sql(
    "members",
    "cluster_id",
    {
        "max_mag_event_id": "id",
        "max_mag_event_longitude": "longitude",
        "max_mag_event_latitude": "latitude",
        "max_mag_event_depth_km": "depth_km",
        "max_mag_event_place": "place",
    },
)


@_register(
    "cluster_daily_stats",
    V.with_sql(*_MATCH, _MEMBERS, _SPHERE_FACT_SQL) + shown_sql(SPHERE_FACT, "fact"),
)
def cluster_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sphere_daily_fact(_assigned(spark, sf_dir)), SPHERE_FACT)


@_register(
    "cluster_daily_stats_joined",
    V.with_sql(*_MATCH, _MEMBERS, _SPHERE_FACT_SQL) + shown_sql(SPHERE_FACT, "fact"),
)
def cluster_daily_stats_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment comes from a table of its own and is joined by id."""
    assignment = _assigned(spark, sf_dir).select("id", "cluster_id")
    return shown(
        sphere_daily_fact(attach_assignment(V.quakes(spark, sf_dir), assignment)), SPHERE_FACT
    )


@_register(
    "cluster_daily_stats_bucketed",
    V.with_sql(*_MATCH, _MEMBERS, _SPHERE_FACT_SQL) + shown_sql(SPHERE_FACT, "fact"),
)
def cluster_daily_stats_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and assignment as tables bucketed by id: their join needs no shuffle."""
    names = [f"bucketed_{side}_{uuid.uuid4().hex}" for side in ("events", "assignment")]
    write_bucketed(V.quakes(spark, sf_dir), names[0], "id", 8)
    write_bucketed(_assigned(spark, sf_dir).select("id", "cluster_id"), names[1], "id", 8)
    joined = attach_assignment(spark.table(names[0]), spark.table(names[1]))
    return shown(sphere_daily_fact(joined), SPHERE_FACT)


@_register(
    "cluster_daily_stats_short",
    V.with_sql(*_MATCH, _MEMBERS, _fact_sql("members", "cluster_id", {"max_mag_event_id": "id"}))
    + shown_sql(ZONE_FACT, "fact"),
)
def cluster_daily_stats_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(zone_daily_fact(_assigned(spark, sf_dir)), ZONE_FACT)


# --- clustering fits ---------------------------------------------------------------------------

_KS, _ZONES = (4, 8, 12), 12

_TOTALS_SQL = V.with_sql(
    V.QUAKES,
    """totals as (
  select dt, count(*) as total_events,
         sum(case when magnitude < 4 then 1 else 0 end) as mag_count_small,
         sum(case when magnitude >= 4 and magnitude < 6 then 1 else 0 end) as mag_count_medium,
         sum(case when magnitude >= 6 then 1 else 0 end) as mag_count_large,
         sum(magnitude) as sum_magnitude, max(magnitude) as max_magnitude,
         min(depth_km) as depth_min
  from quakes group by dt)""",
)


def _per_day(fact: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A cluster fact summed over its clusters: what the events of the day must give."""
    how = {"max_magnitude": F.max, "depth_min": F.min}
    return fact.groupBy("dt").agg(
        *(how.get(name, F.sum)(name).alias(name) for name in columns if name != "dt")
    )


@_register("kmeans_sweep_metrics")
def kmeans_sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spheres(V.quakes(spark, sf_dir), _KS, trials=1).metrics


@_register("kmeans_cluster_dim")
def kmeans_cluster_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_spheres(V.quakes(spark, sf_dir), _KS, trials=1).dimension


@_register("kmeans_fact_totals", _TOTALS_SQL + shown_sql(TOTALS, "totals"))
def kmeans_fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = cluster_spheres(V.quakes(spark, sf_dir), _KS[:1], trials=1).fact
    return shown(_per_day(fact, TOTALS), TOTALS)


@_register("bisecting_cluster_dim")
def bisecting_cluster_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_zones(V.quakes(spark, sf_dir), k=_ZONES).dimension


_ZONE_TOTALS = {
    name: kind
    for name, kind in TOTALS.items()
    if name in ("dt", "total_events", "mag_count_large", "max_magnitude", "depth_min")
}


@_register("bisecting_fact_totals", _TOTALS_SQL + shown_sql(_ZONE_TOTALS, "totals"))
def bisecting_fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = cluster_zones(V.quakes(spark, sf_dir), k=_ZONES).fact
    return shown(_per_day(fact, _ZONE_TOTALS), _ZONE_TOTALS)


# --- parsing and streaming ---------------------------------------------------------------------

_TIME_COLUMNS = {"event_id": "int", "time_ms": "int", "day": "day"}


@_register(
    "time_parse",
    V.with_sql(
        V.QUAKES,
        """parsed as (
  select event_id, case when event_id % 7 <> 0 then time_utc end as time_ms,
         case when event_id % 7 <> 0 then dt end as day
  from quakes)""",
    )
    + shown_sql(_TIME_COLUMNS, "parsed"),
)
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as digits, as ISO text, and unreadable."""
    iso = F.date_format(F.timestamp_millis("time_utc"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = (
        F.when(F.col("event_id") % 7 == 0, F.lit("junk"))
        .when(F.col("event_id") % 2 == 0, iso)
        .otherwise(F.col("time_utc").cast("string"))
    )
    parsed = V.quakes(spark, sf_dir).select("event_id", event_timestamp(text).alias("at"))
    timed = parsed.select(
        "event_id", F.unix_millis("at").alias("time_ms"), event_day(F.col("at")).alias("day")
    )
    return shown(timed, _TIME_COLUMNS)


@_register(
    "json_parse",
    "with parsed as (select cast(json_extract(props, '$.k') as integer) as k from events), "
    "counts as (select k, count(*) as n from parsed group by k) "
    + shown_sql({"k": "int", "n": "int"}, "counts"),
)
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    parsed = parse_json(V.load(spark, sf_dir, "events"), schema, "props")
    return shown(parsed.groupBy("k").agg(F.count("*").alias("n")), {"k": "int", "n": "int"})


_SERVED = f"""served as (
  select m.dt as day, m.id, m.time_utc as time_ms, m.magnitude, m.mag_type, m.place, m.latitude,
         m.longitude, m.depth_km, m.source_system as source, r.region_id, r.region, r.sub_region,
         m.cluster_id
  from matched m left join regions r on {INSIDE})"""


def _as_stream(events: DataFrame) -> DataFrame:
    """Unified events with the column names and types of parsed messages."""
    return events.select(
        F.col("dt").alias("day"),
        "id",
        F.timestamp_millis("time_utc").alias("time_utc"),
        "magnitude",
        "mag_type",
        "place",
        "latitude",
        "longitude",
        "depth_km",
        F.col("source_system").alias("source"),
    )


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _as_stream(V.quakes(spark, sf_dir))
    return enrich(events, V.regions(spark, sf_dir), V.clusters(spark, sf_dir))


def _with_millis(served: DataFrame) -> DataFrame:
    return served.withColumn("time_ms", F.unix_millis("time_utc"))


@_register("batch_enrich", V.with_sql(*_MATCH, _SERVED) + shown_sql(ENRICHED, "served"))
def batch_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_with_millis(_served(spark, sf_dir)), ENRICHED)


_KEYED = """keyed as (
  select * exclude (rn) from (
    select *, row_number() over (
      partition by day, id order by region_id desc nulls last) as rn from served)
  where rn = 1)"""


def write_messages(spark: SparkSession, sf_dir: str, path: str, files: int) -> None:
    """Quakes as JSON messages, half of them with an ISO time and half with epoch milliseconds."""
    iso = F.date_format(F.timestamp_millis("time_utc"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    clock = F.when(F.col("event_id") % 2 == 0, iso).otherwise(F.col("time_utc").cast("string"))
    fields = ("magnitude", "mag_type", "place", "latitude", "longitude", "depth_km")
    message = F.to_json(
        F.struct("id", clock.alias("time_utc"), *fields, F.col("source_system").alias("source"))
    )
    quakes = V.quakes(spark, sf_dir).repartition(files, "event_id")
    quakes.select(message.alias("value")).write.text(path)


@_register("stream_enrich", V.with_sql(*_MATCH, _SERVED, _KEYED) + shown_sql(ENRICHED, "keyed"))
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole streaming job over a file source, in several micro-batches."""
    root = scratch_path(spark, "stream")
    write_messages(spark, sf_dir, f"{root}/messages", files=6)
    serving_table = ParquetServing(f"{root}/serving")
    query = start_ingest(
        stream_source(spark, "text", {"path": f"{root}/messages", "maxFilesPerTrigger": "3"}),
        V.regions(spark, sf_dir),
        V.clusters(spark, sf_dir),
        serving_table,
        f"{root}/checkpoint",
        {"availableNow": True},
    )
    query.awaitTermination()
    served = latest_per_key(serving_table.read(spark))
    return shown(_with_millis(served), ENRICHED)


@_register("stream_compacted", V.with_sql(*_MATCH, _SERVED, _KEYED) + shown_sql(ENRICHED, "keyed"))
def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published dimensions, two compactions, and a batch of a compacted range that is delivered once more.

    The repeated batch has other values, which must not come back.
    """
    root = scratch_path(spark, "stream")
    write_messages(spark, sf_dir, f"{root}/messages", files=6)
    serving_table = ParquetServing(f"{root}/serving")
    sides = [Snapshots(f"{root}/regions"), Snapshots(f"{root}/clusters")]
    for side, rows in zip(sides, (V.regions(spark, sf_dir), V.clusters(spark, sf_dir))):
        side.publish(rows)
    query = start_ingest(
        stream_source(spark, "text", {"path": f"{root}/messages", "maxFilesPerTrigger": "1"}),
        *sides,
        serving_table,
        f"{root}/checkpoint",
        {"availableNow": True},
    )
    query.awaitTermination()
    serving_table.compact(spark, through=1)
    serving_table.compact(spark)
    again = serving_table.read(spark).where("batch_id = 1").withColumn("magnitude", F.lit(99.0).cast("float"))
    serving_table.write_batch(again.drop("batch_id"), 1)
    return shown(_with_millis(latest_per_key(serving_table.read(spark))), ENRICHED)


# --- serving -----------------------------------------------------------------------------------

_DAYS = (dt.date(2024, 1, 5), dt.date(2024, 1, 20))
_MAGNITUDES = (1.5, 4.5)
_FILTER = (
    f"day between date '{_DAYS[0]}' and date '{_DAYS[1]}' "
    f"and magnitude between cast({_MAGNITUDES[0]} as double) and cast({_MAGNITUDES[1]} as double)"
)


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.filter_events(_served(spark, sf_dir), *_DAYS, *_MAGNITUDES)


@_register(
    "serving_filter",
    V.with_sql(*_MATCH, _SERVED, f"chosen as (select * from served where {_FILTER})")
    + shown_sql(ENRICHED, "chosen"),
)
def serving_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_with_millis(_filtered(spark, sf_dir)), ENRICHED)


@_register(
    "serving_count",
    V.with_sql(*_MATCH, _SERVED, f"n as (select count(*) as event_count from served where {_FILTER})")
    + shown_sql({"event_count": "int"}, "n"),
)
def serving_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(serving.count_events(_filtered(spark, sf_dir)), {"event_count": "int"})


_BOUNDS = {"min_day": "day", "max_day": "day", "min_magnitude": "num", "max_magnitude": "num"}


@_register(
    "serving_bounds",
    V.with_sql(
        V.QUAKES,
        """ends as (
  select min(dt) as min_day, max(dt) as max_day, min(magnitude) as min_magnitude,
         max(magnitude) as max_magnitude from quakes)""",
    )
    + shown_sql(_BOUNDS, "ends"),
)
def serving_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(serving.bounds(_served(spark, sf_dir)), _BOUNDS)


def _day_folders(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "days")
    events = V.quakes(spark, sf_dir).select(F.col("dt").alias("day"), "id", "magnitude")
    write_parquet(events, path, ["day"])
    return path


@_register(
    "serving_bounds_footers",
    V.with_sql(
        V.QUAKES,
        """ends as (
  select min(dt) as min_day, max(dt) as max_day, min(magnitude) as min_magnitude,
         max(magnitude) as max_magnitude from quakes)""",
    )
    + shown_sql(_BOUNDS, "ends"),
)
def serving_bounds_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ends from the footers of the files alone."""
    return shown(serving.bounds_of_files(spark, _day_folders(spark, sf_dir)), _BOUNDS)


@_register(
    "serving_count_footers",
    V.with_sql(V.QUAKES, f"n as (select count(*) as event_count from quakes where dt between date '{_DAYS[0]}' and date '{_DAYS[1]}')")
    + shown_sql({"event_count": "int"}, "n"),
)
def serving_count_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(serving.count_of_files(spark, _day_folders(spark, sf_dir), *_DAYS), {"event_count": "int"})


_BOX = "latitude between 10 and 40 and longitude between -60 and 0"


@_register(
    "serving_filter_clustered",
    V.with_sql(
        V.QUAKES,
        f"""chosen as (select event_id, latitude, longitude from quakes
  where dt between date '{_DAYS[0]}' and date '{_DAYS[1]}' and {_BOX})""",
    )
    + shown_sql({"event_id": "int", "latitude": "r9", "longitude": "r9"}, "chosen"),
)
def serving_filter_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on days and a box over files laid out along a curve of both."""
    path = scratch_path(spark, "clustered")
    quakes = V.quakes(spark, sf_dir)
    write_clustered(quakes, path, rows_per_file=max(1, quakes.count() // 64), day="dt")
    days = F.col("dt").between(F.lit(_DAYS[0]), F.lit(_DAYS[1]))
    chosen = spark.read.parquet(path).where(days).where(_BOX)
    return shown(chosen, {"event_id": "int", "latitude": "r9", "longitude": "r9"})


_MAP = {"lat": "num", "lon": "num", "magnitude": "num", "place": "text", "region": "text"}


@_register(
    "serving_map_points",
    V.with_sql(
        *_MATCH,
        _SERVED,
        f"""dots as (
  select latitude as lat, longitude as lon, magnitude, place, region from served where {_FILTER})""",
    )
    + shown_sql(_MAP, "dots"),
)
def serving_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(serving.map_points(_filtered(spark, sf_dir)), _MAP)


_PREVIEW = {"id": "text", "dt": "day", "magnitude": "num", "place": "text"}


@_register(
    "serving_preview",
    V.with_sql(V.QUAKES, "top as (select * from quakes order by magnitude desc, id limit 10)")
    + shown_sql(_PREVIEW, "top"),
)
def serving_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a table under an order."""
    V.quakes(spark, sf_dir).createOrReplaceTempView("tremorlake_quakes")
    order = [F.desc("magnitude"), F.asc("id")]
    return shown(serving.preview(spark, "tremorlake_quakes", 10, order), _PREVIEW)


# --- sources and sinks -------------------------------------------------------------------------


def _scratch_database(spark: SparkSession) -> str:
    """A database whose managed tables live in the shared scratch folder."""
    name = f"tremorlake_{uuid.uuid4().hex}"
    spark.sql(f"create database {name} location '{scratch_path(spark, 'database')}'")
    return name


_STORED = {"id": "text", "magnitude": "num", "dt": "day", "kind": "text"}
_REPLACED = """changed as (
  select id, magnitude + 10 as magnitude, dt from quakes where event_id % 2 = 0 and day(dt) % 2 = 0),
stored as (
  select * from changed
  union all
  select id, magnitude, dt from quakes where dt not in (select dt from changed))"""


@_register(
    "partition_overwrite",
    V.with_sql(
        V.QUAKES,
        _REPLACED,
        """tables as (
  select *, 'managed' as kind from stored
  union all select *, 'external' as kind from stored
  union all select id, magnitude, dt, 'full' as kind from changed)""",
    )
    + shown_sql(_STORED, "tables"),
)
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even days are replaced in a managed table, in one with a path, and as a full overwrite."""
    database = _scratch_database(spark)
    q = V.quakes(spark, sf_dir)
    before = q.select("id", "magnitude", "dt")
    changed = q.filter((F.col("event_id") % 2 == 0) & (F.dayofmonth("dt") % 2 == 0)).select(
        "dt", "id", (F.col("magnitude") + 10).alias("magnitude")
    )
    results = []
    for kind, overwrite in (("managed", "partitions"), ("external", "partitions"), ("full", "full")):
        table = f"{database}.{kind}"
        path = None if kind == "managed" else scratch_path(spark, kind)
        write_table(before, table, ["dt"], path)
        write_table(changed, table, ["dt"], path, overwrite)
        results.append(scan_table(spark, table).withColumn("kind", F.lit(kind)))
    return shown(union_feeds(results), _STORED)


@_register(
    "partition_recovery",
    V.with_sql(V.QUAKES, "days as (select dt, count(*) as n from quakes group by dt)")
    + shown_sql({"dt": "day", "n": "int"}, "days"),
)
def partition_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories written behind the catalog's back become visible."""
    table, path = f"{_scratch_database(spark)}.raw", scratch_path(spark, "raw")
    write_parquet(V.quakes(spark, sf_dir).select("id", "magnitude", "dt"), path, ["dt"])
    spark.sql(
        f"create table {table} (id string, magnitude double, dt date) using parquet "
        f"partitioned by (dt) location '{path}'"
    )
    register_partitions(spark, table)
    days = scan_table(spark, table).groupBy("dt").agg(F.count("*").alias("n"))
    return shown(days, {"dt": "day", "n": "int"})


@_register(
    "file_roundtrip",
    V.with_sql(V.QUAKES, V.REGIONS, _LOCATED, _REGION_SQL) + shown_sql(REGION_FACT, "fact"),
)
def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions through CSV, events and the fact through Parquet directories."""
    events, boxes, fact = (scratch_path(spark, name) for name in ("events", "regions", "fact"))
    write_parquet(V.quakes(spark, sf_dir), events, ["dt"])
    write_csv(V.regions(spark, sf_dir).select(*REGION_SCHEMA.names), boxes)
    result = region_daily_fact(scan_feed(spark, events), read_regions(spark, boxes, infer=True))
    write_parquet(result, fact)
    return shown(spark.read.parquet(fact), REGION_FACT)


@_register(
    "dimension_roundtrip",
    V.with_sql(*_MATCH) + shown_sql(_MATCH_COLUMNS, "matched"),
)
def dimension_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster dimension through CSV and back, used for matching."""
    path = scratch_path(spark, "dimension")
    zero = F.lit(0.0)
    dimension = V.clusters(spark, sf_dir).withColumns({"center_lat": zero, "center_lon": zero})
    write_csv(dimension.select(*SPHERE_DIMENSION_SCHEMA.names), path)
    clusters = read_csv(spark, path, SPHERE_DIMENSION_SCHEMA)
    return shown(match_clusters(V.quakes(spark, sf_dir), clusters), _MATCH_COLUMNS)


@_register("serving_table", V.with_sql(*_MATCH, _SERVED) + shown_sql(ENRICHED, "served"))
def serving_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched events through a day-partitioned table and its serving projection."""
    table = f"{_scratch_database(spark)}.events"
    write_table(_served(spark, sf_dir), table, ["day"])
    return shown(_with_millis(read_serving(spark, table)), ENRICHED)
