"""Training features and their global moments."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.sphere import surface_vector


class Moments(NamedTuple):
    """Row count, mean point and total sum of squares around it."""

    count: int
    mean_x: float | None
    mean_y: float | None
    mean_z: float | None
    total_ss: float


def located_events(events: DataFrame) -> DataFrame:
    """Events with both coordinates; NULL and NaN cannot be clustered."""
    return events.na.drop(subset=["latitude", "longitude"])


def sphere_features(events: DataFrame) -> DataFrame:
    """Located events with their unit-sphere point as columns ``x, y, z``."""
    point = surface_vector(F.col("latitude"), F.col("longitude"))
    return located_events(events).withColumns({"x": point.x, "y": point.y, "z": point.z})


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the ML vector column ``features``."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def feature_moments(features: DataFrame) -> DataFrame:
    """Count, means and total sum of squares of ``x, y, z`` in one pass over the features."""
    spread = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    return features.agg(
        F.count("*").alias("count"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.avg("z").alias("mean_z"),
        F.coalesce(spread * F.count("*"), F.lit(0.0)).alias("total_ss"),
    )


def collect_moments(features: DataFrame) -> Moments:
    return Moments(*feature_moments(features).first())
