"""Daily statistics per group: counts, magnitude and depth aggregates, the biggest event."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.packing import pack_day_key, packed_day, packed_key

# Small below the first edge, large from the second edge on.
MAGNITUDE_EDGES = (4.0, 6.0)

_PACKED = "_day_key"


def magnitude_counts(edges: tuple[float, float] = MAGNITUDE_EDGES) -> list[Column]:
    """Events per magnitude class. A NULL magnitude belongs to no class."""
    low, high = edges
    magnitude = F.col("magnitude")
    return [
        F.count_if(magnitude < low).alias("mag_count_small"),
        F.count_if((magnitude >= low) & (magnitude < high)).alias("mag_count_medium"),
        F.count_if(magnitude >= high).alias("mag_count_large"),
    ]


def measures() -> list[Column]:
    magnitude, depth = F.col("magnitude"), F.col("depth_km")
    return [
        F.sum(magnitude).alias("sum_magnitude"),
        F.avg(magnitude).alias("avg_magnitude"),
        F.max(magnitude).alias("max_magnitude"),
        F.sum(depth).alias("depth_sum"),
        F.avg(depth).alias("avg_depth"),
        F.min(depth).alias("depth_min"),
        F.max(depth).alias("depth_max"),
    ]


def daily_stats(
    df: DataFrame,
    key: str,
    biggest: Mapping[str, str],
    day: str = "dt",
    edges: tuple[float, float] = MAGNITUDE_EDGES,
) -> DataFrame:
    """All statistics per (day, key) in one pass and one shuffle of partial aggregates.

    ``biggest`` maps output names to columns of the event with the largest magnitude, in tie-break
    order: equal magnitudes go to the largest first payload column. A group without any magnitude
    still names an event.
    """
    fields = dict.fromkeys(["magnitude", *biggest.values()])
    types = dict(df.dtypes)
    packed = types[day] == "date" and types[key] in ("int", "smallint", "tinyint")
    if packed:
        grouped = df.withColumn(_PACKED, pack_day_key(F.col(day), F.col(key))).groupBy(_PACKED)
        day_out, key_out = packed_day(F.col(_PACKED)), packed_key(F.col(_PACKED)).cast(types[key])
    else:
        grouped = df.groupBy(day, key)
        day_out, key_out = F.col(day), F.col(key)
    stats = grouped.agg(
        F.count("*").alias("total_events"),
        *magnitude_counts(edges),
        *measures(),
        F.max(F.struct(*fields)).alias("_biggest"),
    )
    names = [name for name in stats.columns if name not in (_PACKED, day, key, "_biggest")]
    return stats.select(
        day_out.alias(day),
        key_out.alias(key),
        *names,
        *(F.col(f"_biggest.{field}").alias(name) for name, field in biggest.items()),
    )


def daily_partials(
    df: DataFrame,
    key: str,
    biggest: Mapping[str, str],
    day: str = "dt",
    edges: tuple[float, float] = MAGNITUDE_EDGES,
) -> DataFrame:
    """What ``daily_stats`` needs of some of the rows, in a form that can be merged with that of others."""
    fields = dict.fromkeys(["magnitude", *biggest.values()])
    magnitude, depth = F.col("magnitude"), F.col("depth_km")
    return df.groupBy(day, key).agg(
        F.count("*").alias("total_events"),
        *magnitude_counts(edges),
        F.sum(magnitude).alias("sum_magnitude"),
        F.count(magnitude).alias("n_magnitude"),
        F.max(magnitude).alias("max_magnitude"),
        F.sum(depth).alias("depth_sum"),
        F.count(depth).alias("n_depth"),
        F.min(depth).alias("depth_min"),
        F.max(depth).alias("depth_max"),
        F.max(F.struct(*fields)).alias("_biggest"),
    )


def merge_partials(partials: DataFrame, key: str, biggest: Mapping[str, str], day: str = "dt") -> DataFrame:
    """The columns of ``daily_stats`` from any number of partials of a group."""
    added = ["total_events", "mag_count_small", "mag_count_medium", "mag_count_large"]
    added += ["sum_magnitude", "n_magnitude", "depth_sum", "n_depth"]
    most = ["max_magnitude", "depth_max", "_biggest"]
    merged = partials.groupBy(day, key).agg(
        *(F.sum(name).alias(name) for name in added),
        *(F.max(name).alias(name) for name in most),
        F.min("depth_min").alias("depth_min"),
    )
    merged = merged.withColumns(
        {
            "avg_magnitude": F.try_divide("sum_magnitude", "n_magnitude"),
            "avg_depth": F.try_divide("depth_sum", "n_depth"),
            **{name: F.col(f"_biggest.{field}") for name, field in biggest.items()},
        }
    )
    return merged.drop("n_magnitude", "n_depth", "_biggest")
