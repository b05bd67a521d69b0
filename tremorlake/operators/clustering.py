"""Clustering: KMeans sweep by Calinski-Harabasz index, bisecting KMeans, cluster dimensions."""

from __future__ import annotations

import time
from collections.abc import Iterable
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel, KMeans, KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tremorlake.functions.sphere import (
    KM_PER_DEGREE,
    Vector,
    arc_km,
    direction,
    dot,
    latitude_of,
    longitude_of,
)
from tremorlake.functions.times import today_text
from tremorlake.operators.features import Moments
from tremorlake.operators.sizing import broadcast_when_small
from tremorlake.schemas import CENTER_SCHEMA, SPHERE_DIMENSION_SCHEMA, ZONE_DIMENSION_COLUMNS
from tremorlake.sources.readers import small_rows

# Fixed values of the two clusterings.
SWEEP_KS = tuple(range(300, 601, 20))
SWEEP_TRIALS = 3
ZONE_COUNT = 50
ZONE_SEED = 1


#: Copies of one identical row that may share a partition.
_COPIES_TOGETHER = 100_000


def trial_seed(k: int, trial: int) -> int:
    return 42 + trial + 10 * k


class Trial(NamedTuple):
    """One fit. ``clusters_found`` may be below ``k`` on few distinct points."""

    k: int
    trial: int
    wcss: float
    ch_index: float
    execution_time_sec: float
    clusters_found: int


class Sweep(NamedTuple):
    trials: list[Trial]
    best: Trial | None
    model: KMeansModel | None


def calinski_harabasz(total_ss: float, wcss: float, k: int, count: int) -> float:
    """Between-cluster over within-cluster variance; 0 where it is undefined."""
    if wcss == 0 or count <= k or k <= 1:
        return 0.0
    return ((total_ss - wcss) / (k - 1)) / (wcss / (count - k))


def stable_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row layout that depends on the rows only, because KMeans depends on the layout.

    Rows are hashed by all their columns. Copies of one row would meet in one partition, so they are
    counted first and spread again in portions of ``_COPIES_TOGETHER``.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, copies, portion = df.columns, F.col("_copies"), F.col("_portion")
    first = portion * _COPIES_TOGETHER
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("_copies"))
        .withColumn("_portion", F.explode(F.sequence(F.lit(0), F.floor((copies - 1) / _COPIES_TOGETHER))))
        .repartition(partitions, *columns, "_portion")
        .sortWithinPartitions(*columns, "_portion")
        .withColumn("_copy", F.explode(F.sequence(first + 1, F.least(copies, first + _COPIES_TOGETHER))))
        .select(*columns)
    )


def sweep_kmeans(
    features: DataFrame,
    moments: Moments,
    ks: Iterable[int] = SWEEP_KS,
    trials: int = SWEEP_TRIALS,
    parallelism: int = 1,
) -> Sweep:
    """One KMeans fit per k and trial; the best model has the strictly highest index, first wins.

    ``features`` should be cached, each fit reads it many times. ``parallelism`` fits are submitted
    at once; the outcome does not depend on it.
    """
    if moments.count == 0:
        return Sweep([], None, None)

    def fit(setting: tuple[int, int]) -> tuple[Trial, KMeansModel]:
        k, number = setting
        started = time.monotonic()
        model = KMeans(
            k=k, seed=trial_seed(k, number), featuresCol="features", initMode="k-means||"
        ).fit(features)
        wcss = float(model.summary.trainingCost)
        index = calinski_harabasz(moments.total_ss, wcss, k, moments.count)
        found = len(model.clusterCenters())
        return Trial(k, number, wcss, index, time.monotonic() - started, found), model

    settings = [(k, number) for k in ks for number in range(trials)]
    results: list[Trial] = []
    best: Trial | None = None
    best_model: KMeansModel | None = None
    target = inheritable_thread_target(features.sparkSession)(fit)
    with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
        for trial, model in pool.imap(target, settings):
            results.append(trial)
            if best is None or trial.ch_index > best.ch_index:
                best, best_model = trial, model
    return Sweep(results, best, best_model)


def fit_zones(features: DataFrame, k: int = ZONE_COUNT, seed: int = ZONE_SEED) -> BisectingKMeansModel:
    """Bisecting KMeans on degrees; predicts ``cluster_id``."""
    return BisectingKMeans(
        k=k, seed=seed, featuresCol="features", predictionCol="cluster_id"
    ).fit(features)


def centre_rows(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """The model's centres, one row per cluster. The model itself lives on the driver."""
    rows = [(i, *(float(axis) for axis in centre)) for i, centre in enumerate(model.clusterCenters())]
    return small_rows(spark, rows, CENTER_SCHEMA)


def sphere_dimension(centres: DataFrame, members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Cluster dimension from centres: position in degrees and radius to the farthest member.

    The farthest member is the one with the smallest cosine, so a hash aggregate keeps one double
    per cluster and the arc is taken once per cluster. A centre without members has radius 0.
    """
    own = broadcast_when_small(centres)
    axis = Vector(F.col("center_x"), F.col("center_y"), F.col("center_z"))
    cosine = dot(Vector(F.col("x"), F.col("y"), F.col("z")), direction(axis))
    farthest = (
        members.select(F.col(cluster).alias("_member_of"), "x", "y", "z")
        .join(own, F.col("_member_of") == F.col("cluster_id"))
        .groupBy("cluster_id")
        .agg(F.min(cosine).alias("_cosine"))
    )
    dimension = centres.join(farthest, "cluster_id", "left").select(
        "cluster_id",
        *axis,
        latitude_of(axis).alias("center_lat"),
        longitude_of(axis).alias("center_lon"),
        F.coalesce(arc_km(F.col("_cosine")), F.lit(0.0)).alias("max_r_km"),
    )
    return dimension.select(*SPHERE_DIMENSION_SCHEMA.names)


def zone_dimension(members: DataFrame) -> DataFrame:
    """Cluster dimension from members: centroid, spread as a radius, size, creation date.

    A cluster of one event has no spread, its radius is NULL.
    """
    spread = F.stddev_samp("latitude") + F.stddev_samp("longitude")
    return (
        members.groupBy("cluster_id")
        .agg(
            F.avg("latitude").alias("centroid_lat"),
            F.avg("longitude").alias("centroid_lon"),
            (spread * KM_PER_DEGREE).alias("cluster_radius_km"),
            F.count("*").alias("event_count_in_cluster"),
        )
        .withColumn("creation_date", today_text())
        .select(*ZONE_DIMENSION_COLUMNS)
    )
