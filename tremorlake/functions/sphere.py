"""Geometry of events on and below the Earth's surface, as native column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


class Vector(NamedTuple):
    """Three Cartesian columns."""

    x: Column
    y: Column
    z: Column


def surface_vector(latitude: Column, longitude: Column) -> Vector:
    """Unit-sphere point of a position given in degrees."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    return Vector(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def hypocentre_vector(latitude: Column, longitude: Column, depth_km: Column) -> Vector:
    """Point below the surface on a sphere of radius 1; a NULL depth counts as the surface."""
    lat, lon = F.radians(latitude), F.radians(longitude)
    shrink = (EARTH_RADIUS_KM - F.coalesce(depth_km, F.lit(0.0))) / EARTH_RADIUS_KM
    return Vector(
        shrink * F.cos(lat) * F.cos(lon),
        shrink * F.cos(lat) * F.sin(lon),
        shrink * F.sin(lat),
    )


def dot(a: Vector, b: Vector) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def squared_distance(a: Vector, b: Vector) -> Column:
    dx, dy, dz = a.x - b.x, a.y - b.y, a.z - b.z
    return dx * dx + dy * dy + dz * dz


def norm(v: Vector) -> Column:
    return F.sqrt(v.x * v.x + v.y * v.y + v.z * v.z)


def direction(v: Vector) -> Vector:
    """The vector scaled to length 1; the zero vector stays zero."""
    length = norm(v)
    length = F.when(length == 0.0, 1.0).otherwise(length)
    return Vector(v.x / length, v.y / length, v.z / length)


def arc_km(cosine: Column) -> Column:
    """Great-circle length of the angle with this cosine, which rounding may push past +-1.

    NULL where the cosine is NULL or NaN; ``least`` and ``greatest`` alone would skip a NULL.
    """
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when(cosine.isNotNull() & ~F.isnan(cosine), F.acos(bounded) * EARTH_RADIUS_KM)


def great_circle_km(point: Vector, centre: Vector) -> Column:
    """Great-circle distance of a unit-sphere point from the direction of a centre."""
    return arc_km(dot(point, direction(centre)))


def latitude_of(v: Vector) -> Column:
    length = norm(v)
    return F.when(length == 0.0, 0.0).otherwise(F.degrees(F.asin(v.z / F.nullif(length, F.lit(0.0)))))


def longitude_of(v: Vector) -> Column:
    return F.when(norm(v) == 0.0, 0.0).otherwise(F.degrees(F.atan2(v.y, v.x)))


def squared_reach(max_r_km: Column) -> Column:
    """Square of a radius in km on the sphere of radius 1."""
    share = max_r_km / EARTH_RADIUS_KM
    return share * share
