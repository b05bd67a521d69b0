"""Column contracts and explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names and their order are part of the output contract.
# ---------------------------------------------------------------------------
UNIFIED_COLUMNS = (
    "id",
    "dt",
    "magnitude",
    "mag_type",
    "place",
    "time_utc",
    "longitude",
    "latitude",
    "depth_km",
    "source_system",
)

REGION_FACT_COLUMNS = (
    "dt",
    "region_id",
    "total_events",
    "mag_count_small",
    "mag_count_medium",
    "mag_count_large",
    "sum_magnitude",
    "avg_magnitude",
    "max_magnitude",
    "depth_sum",
    "avg_depth",
    "depth_min",
    "depth_max",
    "max_mag_event_id",
    "max_mag_event_place",
)

SPHERE_FACT_COLUMNS = (
    "cluster_id",
    "total_events",
    "mag_count_small",
    "mag_count_medium",
    "mag_count_large",
    "sum_magnitude",
    "avg_magnitude",
    "max_magnitude",
    "depth_sum",
    "avg_depth",
    "depth_min",
    "depth_max",
    "max_mag_event_id",
    "max_mag_event_longitude",
    "max_mag_event_latitude",
    "max_mag_event_depth_km",
    "max_mag_event_place",
    "dt",
)

ZONE_FACT_COLUMNS = (
    "cluster_id",
    "total_events",
    "avg_magnitude",
    "max_magnitude",
    "mag_count_large",
    "avg_depth",
    "depth_min",
    "depth_max",
    "max_mag_event_id",
    "dt",
)

ZONE_DIMENSION_COLUMNS = (
    "cluster_id",
    "centroid_lat",
    "centroid_lon",
    "cluster_radius_km",
    "event_count_in_cluster",
    "creation_date",
)

STREAM_COLUMNS = (
    "day",
    "id",
    "time_utc",
    "magnitude",
    "mag_type",
    "place",
    "latitude",
    "longitude",
    "depth_km",
    "source",
)

SERVING_COLUMNS = STREAM_COLUMNS + ("region_id", "region", "sub_region", "cluster_id")

MAP_COLUMNS = ("lat", "lon", "magnitude", "place", "region")

# ---------------------------------------------------------------------------
# Explicit schemas.
# ---------------------------------------------------------------------------


_TYPES = {
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _fields(spec: str, nullable: bool = True) -> T.StructType:
    pairs = (item.split() for item in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], nullable) for name, kind in pairs])


REGION_SCHEMA = _fields(
    "region_id int, region string, sub_region string, "
    "lat_min double, lat_max double, lon_min double, lon_max double"
)

MESSAGE_SCHEMA = _fields(
    "id string, time_utc string, magnitude double, mag_type string, place string, "
    "latitude double, longitude double, depth_km double, source string"
)

TRIAL_SCHEMA = _fields(
    "k int, trial int, wcss double, ch_index double, execution_time_sec double", nullable=False
)

SPHERE_DIMENSION_SCHEMA = _fields(
    "cluster_id int, center_x double, center_y double, center_z double, "
    "center_lat double, center_lon double, max_r_km double"
)

CENTER_SCHEMA = _fields("cluster_id int, center_x double, center_y double, center_z double")

SERVING_SCHEMA = _fields(
    "day date, id string, time_utc timestamp, magnitude double, mag_type string, place string, "
    "latitude double, longitude double, depth_km double, source string, "
    "region_id int, region string, sub_region string, cluster_id int"
)
