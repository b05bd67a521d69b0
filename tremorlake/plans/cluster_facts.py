"""Cluster dimensions and daily facts: the KMeans sweep on the sphere and bisecting zones."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import closing
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.clustering import (
    SWEEP_KS,
    SWEEP_TRIALS,
    ZONE_COUNT,
    ZONE_SEED,
    Sweep,
    centre_rows,
    fit_zones,
    sphere_dimension,
    stable_layout,
    sweep_kmeans,
    zone_dimension,
)
from tremorlake.operators.daily_stats import daily_stats
from tremorlake.operators.features import (
    assemble,
    collect_moments,
    located_events,
    sphere_features,
)
from tremorlake.schemas import (
    CENTER_SCHEMA,
    SPHERE_FACT_COLUMNS,
    TRIAL_SCHEMA,
    ZONE_FACT_COLUMNS,
)
from tremorlake.sources.readers import scan_table, small_rows
from tremorlake.sources.writers import Staged, write_csv, write_parquet, write_table

_SPHERE_BIGGEST = {
    "max_mag_event_id": "id",
    "max_mag_event_longitude": "longitude",
    "max_mag_event_latitude": "latitude",
    "max_mag_event_depth_km": "depth_km",
    "max_mag_event_place": "place",
}
_ZONE_BIGGEST = {"max_mag_event_id": "id"}


def sphere_daily_fact(assigned: DataFrame) -> DataFrame:
    """18-column daily fact of events that carry a ``cluster_id``."""
    return daily_stats(assigned, "cluster_id", _SPHERE_BIGGEST).select(*SPHERE_FACT_COLUMNS)


def zone_daily_fact(assigned: DataFrame) -> DataFrame:
    """10-column daily fact of events that carry a ``cluster_id``."""
    return daily_stats(assigned, "cluster_id", _ZONE_BIGGEST).select(*ZONE_FACT_COLUMNS)


def assign_spheres(events: DataFrame, model: KMeansModel | None) -> DataFrame:
    """Events that have an id and a position, with their nearest cluster.

    The prediction is added to the row itself. For the unique ids of the clean table that equals
    joining events with predictions by id, without shuffling either side.
    """
    usable = events.filter(F.col("id").isNotNull())
    if model is None:
        return usable.limit(0).withColumn("cluster_id", F.lit(None).cast("int"))
    features = assemble(sphere_features(usable), ["x", "y", "z"])
    predicted = model.transform(features).withColumnRenamed("prediction", "cluster_id")
    return predicted.select(*events.columns, "cluster_id")


class SphereClusters(NamedTuple):
    """Result of the sweep. ``close()`` deletes the staged training data when all is written."""

    metrics: DataFrame
    dimension: DataFrame
    fact: DataFrame
    sweep: Sweep
    staged: Staged

    def close(self) -> None:
        self.staged.drop()


def cluster_spheres(
    events: DataFrame,
    ks: Iterable[int] = SWEEP_KS,
    trials: int = SWEEP_TRIALS,
    parallelism: int = 1,
    partitions: int | None = None,
) -> SphereClusters:
    """Sweep KMeans over ``ks``, then derive metrics, dimension and daily fact from the best model.

    Points are staged once as an id and three doubles per event; the fits read a cached, laid-out
    copy of them and the dimension reads the stage. Empty input gives empty results.
    """
    spark = events.sparkSession
    points = sphere_features(events.select("id", "latitude", "longitude")).select("id", "x", "y", "z")
    staged = Staged(points, "sphere-features")
    features = assemble(stable_layout(staged.df, partitions), ["x", "y", "z"])
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sweep = sweep_kmeans(features, collect_moments(features), ks, trials, parallelism)
    except BaseException:
        staged.drop()
        raise
    finally:
        features.unpersist()

    metrics = small_rows(
        spark, [trial[: len(TRIAL_SCHEMA.names)] for trial in sweep.trials], TRIAL_SCHEMA
    )
    if sweep.model is None:
        centres = small_rows(spark, [], CENTER_SCHEMA)
        members = staged.df.withColumn("cluster_id", F.lit(None).cast("int"))
    else:
        centres = centre_rows(spark, sweep.model)
        members = sweep.model.transform(assemble(staged.df, ["x", "y", "z"])).withColumnRenamed(
            "prediction", "cluster_id"
        )
    # All events train the model, but a radius spans the members that can be named.
    dimension = sphere_dimension(centres, members.where("id is not null"))
    fact = sphere_daily_fact(assign_spheres(events, sweep.model))
    return SphereClusters(metrics, dimension, fact, sweep, staged)


def run_cluster_spheres(
    spark: SparkSession,
    metrics_path: str,
    dimension_path: str,
    fact_path: str,
    source: str = "earthquake_clean",
    ks: Iterable[int] = SWEEP_KS,
    trials: int = SWEEP_TRIALS,
    parallelism: int = 1,
) -> None:
    """Metrics and dimension as CSV directories, the fact as a Parquet directory."""
    result = cluster_spheres(scan_table(spark, source), ks, trials, parallelism)
    with closing(result):
        write_csv(result.metrics, metrics_path)
        write_csv(result.dimension, dimension_path)
        write_parquet(result.fact, fact_path)


class Zones(NamedTuple):
    dimension: DataFrame
    fact: DataFrame
    staged: Staged

    def close(self) -> None:
        self.staged.drop()


def cluster_zones(
    events: DataFrame, k: int = ZONE_COUNT, seed: int = ZONE_SEED, partitions: int | None = None
) -> Zones:
    """Bisecting KMeans on degrees, with dimension and daily fact from its members.

    Empty input gives empty results.
    """
    needed = located_events(events).select(
        "id", "dt", "latitude", "longitude", "magnitude", "depth_km"
    )
    staged = Staged(needed, "zone-events")
    axes = ["latitude", "longitude"]
    if staged.df.isEmpty():
        members = staged.df.withColumn("cluster_id", F.lit(None).cast("int"))
    else:
        training = assemble(stable_layout(staged.df.select("id", *axes), partitions), axes)
        training = training.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = fit_zones(training, k, seed)
            members = model.transform(assemble(staged.df, axes)).drop("features")
        except BaseException:
            staged.drop()
            raise
        finally:
            training.unpersist()
    return Zones(zone_dimension(members), zone_daily_fact(members), staged)


def run_cluster_zones(
    spark: SparkSession,
    source: str = "earthquake_clean",
    dimension_table: str = "dim_cluster_metadata",
    fact_table: str = "fact_cluster_daily_stats",
    k: int = ZONE_COUNT,
    seed: int = ZONE_SEED,
    overwrite: str = "full",
) -> None:
    result = cluster_zones(scan_table(spark, source), k, seed)
    with closing(result):
        write_table(result.dimension, dimension_table)
        write_table(result.fact, fact_table, ["dt"], overwrite=overwrite)
