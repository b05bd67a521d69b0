"""Queries over enriched events for a dashboard: preview, bounds, filters, map points."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.schemas import MAP_COLUMNS


def preview(spark: SparkSession, table: str, limit: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows of a table; an order makes the choice reproducible (a distributed top-k)."""
    rows = spark.table(table)
    if order_by:
        rows = rows.orderBy(*order_by)
    return rows.limit(limit)


def bounds(events: DataFrame) -> DataFrame:
    """Smallest and largest day and magnitude, the ends of the filter controls. NaN is ignored."""
    magnitude = F.when(~F.isnan("magnitude"), F.col("magnitude"))
    return events.agg(
        F.min("day").alias("min_day"),
        F.max("day").alias("max_day"),
        F.min(magnitude).alias("min_magnitude"),
        F.max(magnitude).alias("max_magnitude"),
    )


def filter_events(
    events: DataFrame,
    first_day: dt.date,
    last_day: dt.date,
    min_magnitude: float,
    max_magnitude: float,
) -> DataFrame:
    """Events in a day range and a magnitude range, both inclusive; both reach the scan."""
    return events.filter(
        F.col("day").between(F.lit(first_day), F.lit(last_day))
        & F.col("magnitude").between(F.lit(float(min_magnitude)), F.lit(float(max_magnitude)))
    )


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("event_count"))


def footer_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, n, low, high): events and ends of the magnitude of every day folder, from the file footers.

    Spark pushes these aggregates into the Parquet reader of its second source interface. A session of its own
    has the two settings that ask for it, so that others keep theirs.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    days = session.read.parquet(path).groupBy("day")
    return days.agg(F.count("*").alias("n"), F.min("magnitude").alias("low"), F.max("magnitude").alias("high"))


def bounds_of_files(spark: SparkSession, path: str) -> DataFrame:
    """``bounds`` of a table with a folder for each day, without reading a row.

    Where a footer has no ends for the magnitude (a file that holds NaN), the rows are read after all.
    """
    whole = footer_days(spark, path).agg(F.min("day"), F.max("day"), F.min("low"), F.max("high"))
    try:
        row = whole.first()
    except Exception as error:  # raised inside a task as a plain Spark error
        if "aggregatePushdown" not in str(error):
            raise
        return bounds(spark.read.parquet(path))
    return spark.createDataFrame([tuple(row)], "min_day date, max_day date, min_magnitude double, max_magnitude double")


def count_of_files(spark: SparkSession, path: str, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """``count_events`` of a range of days, from the file footers of their folders.

    A filter on any other column needs the rows: ``count_events(filter_events(...))``.
    """
    days = footer_days(spark, path).where(F.col("day").between(F.lit(first_day), F.lit(last_day)))
    found = days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_count")).first()
    return spark.createDataFrame([tuple(found)], "event_count bigint")


def map_points(events: DataFrame) -> DataFrame:
    """Position, magnitude and labels of the events that have a position."""
    renamed = {"latitude": "lat", "longitude": "lon"}
    points = events.select("latitude", "longitude", "magnitude", "place", "region")
    numeric = points.withColumns({name: F.col(name).try_cast("double") for name in renamed})
    return numeric.na.drop(subset=list(renamed)).withColumnsRenamed(renamed).select(*MAP_COLUMNS)
