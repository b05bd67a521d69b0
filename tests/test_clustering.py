import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlake.operators.clustering import (
    calinski_harabasz,
    centre_rows,
    sphere_dimension,
    stable_layout,
    sweep_kmeans,
    trial_seed,
    zone_dimension,
)
from tremorlake.operators.features import (
    Moments,
    assemble,
    collect_moments,
    located_events,
    sphere_features,
)
from tremorlake.plans.cluster_facts import assign_spheres, cluster_spheres, cluster_zones
from tremorlake.schemas import (
    SPHERE_DIMENSION_SCHEMA,
    SPHERE_FACT_COLUMNS,
    TRIAL_SCHEMA,
    ZONE_DIMENSION_COLUMNS,
    ZONE_FACT_COLUMNS,
)

SCHEMA = "id string, dt date, latitude double, longitude double, magnitude double, depth_km double, place string"
DAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def rows(n=240, seed=4):
    rnd = random.Random(seed)
    centres = [(10, 10), (-40, 120), (60, -100), (0, -20)]
    out = []
    for i in range(n):
        lat, lon = centres[i % 4]
        out.append(
            (f"e{i:04}", DAYS[i % 2], lat + rnd.gauss(0, 2), lon + rnd.gauss(0, 2), rnd.uniform(0, 8), 10.0, "p")
        )
    return out


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def result(events):
    return cluster_spheres(events, ks=(2, 4, 6), trials=2, parallelism=3)


def test_index_formula():
    assert calinski_harabasz(100.0, 20.0, 5, 25) == (80.0 / 4) / (20.0 / 20)
    assert calinski_harabasz(100.0, 0.0, 5, 25) == 0.0
    assert calinski_harabasz(100.0, 20.0, 25, 25) == 0.0
    assert trial_seed(300, 2) == 3044


def test_moments_equal_the_two_pass_form(events):
    features = sphere_features(events)
    m = collect_moments(features)
    xyz = [(r["x"], r["y"], r["z"]) for r in features.collect()]
    means = [sum(c) / len(xyz) for c in zip(*xyz)]
    total = sum((v - mean) ** 2 for p in xyz for v, mean in zip(p, means))
    assert m.count == len(xyz)
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(m[1:4], means))
    assert math.isclose(m.total_ss, total, rel_tol=1e-9)


def test_sweep_metrics_and_best_model(result):
    trials = result.sweep.trials
    assert [(t.k, t.trial) for t in trials] == [(k, n) for k in (2, 4, 6) for n in (0, 1)]
    best = max(t.ch_index for t in trials)
    assert result.sweep.best == next(t for t in trials if t.ch_index == best)
    assert result.metrics.schema == TRIAL_SCHEMA
    stored = [tuple(r) for r in result.metrics.collect()]
    assert stored == [tuple(t[:5]) for t in trials]


def test_dimension_covers_its_members(spark, events, result):
    dim = {r["cluster_id"]: r for r in result.dimension.collect()}
    assert result.dimension.columns == SPHERE_DIMENSION_SCHEMA.names
    assert len(dim) == len(result.sweep.model.clusterCenters())
    farthest = {}
    for r in sphere_features(assign_spheres(events, result.sweep.model)).collect():
        c = dim[r["cluster_id"]]
        length = math.sqrt(c["center_x"] ** 2 + c["center_y"] ** 2 + c["center_z"] ** 2)
        cosine = (r["x"] * c["center_x"] + r["y"] * c["center_y"] + r["z"] * c["center_z"]) / length
        arc = math.acos(max(-1.0, min(1.0, cosine))) * 6371.0
        farthest[r["cluster_id"]] = max(arc, farthest.get(r["cluster_id"], 0.0))
    assert all(math.isclose(dim[k]["max_r_km"], v, rel_tol=1e-9) for k, v in farthest.items())
    assert all(abs(r["center_lat"]) <= 90 and abs(r["center_lon"]) <= 180 for r in dim.values())


def test_fact_counts_every_event_once(events, result):
    assert tuple(result.fact.columns) == SPHERE_FACT_COLUMNS
    got = result.fact.groupBy("dt").agg(F.sum("total_events").alias("n")).collect()
    assert {r["dt"]: r["n"] for r in got} == dict.fromkeys(DAYS, 120)


def test_parallel_and_layout_do_not_change_the_result(spark, events, result):
    again = cluster_spheres(events.repartition(3).orderBy(F.desc("magnitude")), ks=(2, 4, 6), trials=2)
    for a, b in zip(result.sweep.trials, again.sweep.trials):
        assert math.isclose(a.wcss, b.wcss, rel_tol=1e-6)
    # Equally good trials may swap: MLlib adds partial sums as they arrive, so last digits vary.
    assert again.sweep.best.k == result.sweep.best.k
    assert math.isclose(again.sweep.best.ch_index, result.sweep.best.ch_index, rel_tol=1e-6)
    again.close()


def test_centre_without_members_and_single_member(spark):
    centres = spark.createDataFrame(
        [(0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)], "cluster_id int, center_x double, center_y double, center_z double"
    )
    members = spark.createDataFrame([(0, 1.0, 0.0, 0.0)], "cluster_id int, x double, y double, z double")
    got = {r["cluster_id"]: tuple(r)[4:] for r in sphere_dimension(centres, members).collect()}
    assert got == {0: (0.0, 0.0, 0.0), 1: (0.0, 0.0, 0.0)}

    one = spark.createDataFrame([(5, 1.0, 2.0)], "cluster_id int, latitude double, longitude double")
    row = zone_dimension(one).first()
    assert (row["cluster_radius_km"], row["event_count_in_cluster"]) == (None, 1)
    today = one.select(F.current_date().cast("string")).first()[0]
    assert row["creation_date"] == today


def test_more_clusters_than_points(spark):
    few = spark.createDataFrame(rows(3), SCHEMA)
    result = cluster_spheres(few, ks=(10,), trials=1)
    (trial,) = result.sweep.trials
    assert trial.k == 10 and trial.ch_index == 0.0 and trial.clusters_found <= 3
    assert result.fact.agg(F.sum("total_events")).first()[0] == 3
    result.close()


def test_empty_input_gives_empty_results(spark):
    nowhere = spark.createDataFrame([("a", DAYS[0], None, 1.0, 1.0, 1.0, "p")], SCHEMA)
    spheres = cluster_spheres(nowhere, ks=(2,), trials=1)
    assert spheres.metrics.isEmpty() and spheres.dimension.isEmpty() and spheres.fact.isEmpty()
    assert tuple(spheres.fact.columns) == SPHERE_FACT_COLUMNS
    zones = cluster_zones(nowhere)
    assert zones.dimension.isEmpty() and zones.fact.isEmpty()
    assert tuple(zones.fact.columns) == ZONE_FACT_COLUMNS
    assert sweep_kmeans(nowhere, Moments(0, None, None, None, 0.0)).model is None


def test_zones(events):
    zones = cluster_zones(events, k=4)
    dim = zones.dimension.collect()
    assert tuple(zones.dimension.columns) == ZONE_DIMENSION_COLUMNS
    assert len(dim) == 4 and sum(r["event_count_in_cluster"] for r in dim) == 240
    assert all(r["cluster_radius_km"] < 10 * 111 for r in dim)
    assert zones.fact.agg(F.sum("total_events")).first()[0] == 240
    zones.close()


def test_features_drop_null_and_nan(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("b", None, 1.0), ("c", 1.0, float("nan"))], "id string, latitude double, longitude double"
    )
    assert [r["id"] for r in located_events(df).collect()] == ["a"]
    (row,) = assemble(sphere_features(df), ["x", "y", "z"]).collect()
    assert list(row["features"]) == [row["x"], row["y"], row["z"]]


def test_layout_keeps_all_copies_and_spreads_them(spark, monkeypatch):
    monkeypatch.setattr("tremorlake.operators.clustering._COPIES_TOGETHER", 100)
    df = spark.createDataFrame([("hot", 1.0)] * 1000 + [(str(i), float(i)) for i in range(500)], "id string, x double")
    laid = stable_layout(df, 8)
    counts = laid.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in counts) == 1500
    assert laid.filter("id = 'hot'").count() == 1000
    assert max(r["count"] for r in counts) < 700


def test_members_without_model_keep_their_columns(spark, events):
    assert assign_spheres(events, None).columns == [*events.columns, "cluster_id"]


def test_centres_table(spark, result):
    centres = centre_rows(spark, result.sweep.model)
    assert centres.count() == len(result.sweep.model.clusterCenters())
