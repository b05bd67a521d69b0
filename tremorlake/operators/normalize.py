"""Raw GeoJSON-shaped feeds to the unified event schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.functions.times import epoch_millis
from tremorlake.schemas import UNIFIED_COLUMNS


@dataclass(frozen=True)
class FeedLayout:
    """Where a provider keeps each unified column.

    ``mag_type`` is a path, or a constant in ``mag_type_constant`` for a provider without one.
    Coordinates are a GeoJSON array: longitude, latitude, depth.
    """

    source_system: str
    id: str
    mag_type: str | None = None
    mag_type_constant: str | None = None
    magnitude: str = "properties.mag"
    place: str = "properties.place"
    time: str = "properties.time"
    coordinates: str = "geometry.coordinates"
    dt: str = "dt"


# The two provider layouts.
USGS = FeedLayout(source_system="USGS", id="id", mag_type_constant="ml")
TERRAQUAKE = FeedLayout(
    source_system="Terraquake", id="properties.eventId", mag_type="properties.magType"
)

#: Providers from most to least trusted.
SOURCE_PRIORITY = ("USGS", "Terraquake")


def _type_at(schema: T.StructType, path: str) -> T.DataType:
    """Type of a possibly nested field; names match as Spark resolves them, ignoring case."""
    found: T.DataType = schema
    for part in path.split("."):
        named = {field.name.lower(): field.dataType for field in found.fields}
        found = named[part.lower()]
    return found


def _typed(schema: T.StructType, path: str, target: str) -> Column:
    """The field at ``path`` as ``target``; left alone when it has the type, so filters push down."""
    if _type_at(schema, path).simpleString() == target:
        return F.col(path)
    return F.col(path).try_cast(target)


def _position(schema: T.StructType, path: str, index: int) -> Column:
    """Array element as double, NULL when the array is too short."""
    element = F.get(F.col(path), F.lit(index))
    if _type_at(schema, path).elementType == T.DoubleType():
        return element
    return element.try_cast("double")


def normalize_feed(feed: DataFrame, layout: FeedLayout) -> DataFrame:
    """One projection of a raw feed onto the unified columns; malformed values become NULL."""
    schema = feed.schema
    if layout.mag_type is not None:
        mag_type = _typed(schema, layout.mag_type, "string")
    else:
        mag_type = F.lit(layout.mag_type_constant)
    unified = {
        "id": _typed(schema, layout.id, "string"),
        "dt": F.col(layout.dt),
        "magnitude": _typed(schema, layout.magnitude, "double"),
        "mag_type": mag_type,
        "place": _typed(schema, layout.place, "string"),
        "time_utc": epoch_millis(F.col(layout.time), _type_at(schema, layout.time)),
        "longitude": _position(schema, layout.coordinates, 0),
        "latitude": _position(schema, layout.coordinates, 1),
        "depth_km": _position(schema, layout.coordinates, 2),
        "source_system": F.lit(layout.source_system),
    }
    return feed.select(*(unified[name].alias(name) for name in UNIFIED_COLUMNS))


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """All rows of all feeds, matched by column name."""
    return reduce(DataFrame.unionByName, feeds)
