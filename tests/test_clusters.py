import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import sphere as S
from tremorlake.operators import clusters as clusters_module
from tremorlake.operators.clusters import (
    _ring,
    attach_assignment,
    distance_to_centre,
    cluster_lookup,
    hot_cubes,
    match_clusters,
    nearest_clusters,
    usable_clusters,
)
from tremorlake.operators.features import sphere_features

R = 6371.0
CLUSTER = "cluster_id int, center_x double, center_y double, center_z double, max_r_km double"
EVENT = "id string, latitude double, longitude double, depth_km double"


def unit(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)


def first_match(event, clusters):
    _, lat, lon, depth = event
    if lat is None or lon is None:
        return None
    shrink = (R - (depth or 0.0)) / R
    a, b = math.radians(lat), math.radians(lon)
    q = (shrink * math.cos(a) * math.cos(b), shrink * math.cos(a) * math.sin(b), shrink * math.sin(a))
    for ident, *centre, radius in sorted(c for c in clusters if None not in c):
        if sum((x - y) ** 2 for x, y in zip(q, centre)) < (radius / R) ** 2:
            return ident
    return None


def random_clusters(n, radius, seed):
    rnd = random.Random(seed)
    return [
        (i, *(0.98 * x for x in unit(rnd.uniform(-90, 90), rnd.uniform(-180, 180))), radius(rnd))
        for i in range(n)
    ]


def random_events(n, seed):
    rnd = random.Random(seed)
    rows = [
        (f"e{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.choice([None, 0.0, rnd.uniform(0, 700)]))
        for i in range(n)
    ]
    return rows + [
        ("no lat", None, 1.0, 5.0),
        ("no lon", 1.0, None, 5.0),
        ("above", 10.0, 10.0, -50_000.0),
        ("through", 10.0, 10.0, 20_000.0),
        ("nan", float("nan"), 10.0, 0.0),
    ]


SETS = {
    "small": random_clusters(60, lambda r: r.uniform(100, 2000), 1),
    "many": random_clusters(700, lambda r: r.uniform(50, 600), 2),
    "mixed": random_clusters(40, lambda r: r.choice([10.0, 500.0, 9000.0, 70_000.0]), 3),
}


@pytest.mark.parametrize("name", list(SETS))
@pytest.mark.parametrize("options", [{}, {"cube_limit": 2000}, {"per_pass": 25}, {"per_pass": 1, "hot_events": 3}])
def test_equals_the_plain_loop(spark, name, options):
    clusters, events = SETS[name], random_events(400, 9)
    df = match_clusters(spark.createDataFrame(events, EVENT), spark.createDataFrame(clusters, CLUSTER), **options)
    assert df.columns == ["id", "latitude", "longitude", "depth_km", "cluster_id"]
    got = {r["id"]: r["cluster_id"] for r in df.collect()}
    assert got == {e[0]: first_match(e, clusters) for e in events}


def test_every_event_stays_once(spark):
    events = [("same", 1.0, 1.0, None)] * 50
    df = match_clusters(spark.createDataFrame(events, EVENT), spark.createDataFrame(SETS["mixed"], CLUSTER))
    assert df.count() == 50


def test_strict_distance_lowest_id_and_depth(spark):
    centre = (1.0, 0.0, 0.0)
    events = spark.createDataFrame(
        [("at centre", 0.0, 0.0, None), ("deep", 0.0, 0.0, 700.0), ("edge", 0.0, 0.0, 637.1)], EVENT
    )

    def match(*clusters):
        df = match_clusters(events, spark.createDataFrame(list(clusters), CLUSTER))
        return {r["id"]: r["cluster_id"] for r in df.collect()}

    assert match((7, *centre, 650.0)) == {"at centre": 7, "deep": None, "edge": 7}
    assert match((9, *centre, 1000.0), (2, *centre, 1000.0)) == dict.fromkeys(("at centre", "deep", "edge"), 2)
    # At a distance equal to the radius there is no match.
    assert match((1, *centre, 0.0))["at centre"] is None


def test_unusable_dimension_rows_are_skipped(spark):
    rows = [("1", "x", "0", "0", "500"), ("2", "1", "0", "0", None), ("3", "1.0", "0", "0", "500"), (None, "1", "0", "0", "9")]
    text = spark.createDataFrame(rows, "cluster_id string, center_x string, center_y string, center_z string, max_r_km string")
    assert [r["cluster_id"] for r in usable_clusters(text).collect()] == [3]
    events = spark.createDataFrame([("a", 0.0, 0.0, None)], EVENT)
    assert match_clusters(events, text).first()["cluster_id"] == 3
    assert match_clusters(events, text.limit(0)).first()["cluster_id"] is None


def test_events_are_not_shuffled_and_no_python_runs(spark, plan_of):
    events = spark.createDataFrame(random_events(5, 1), EVENT)
    plan = plan_of(match_clusters(events, spark.createDataFrame(SETS["small"], CLUSTER)))
    physical = plan.split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in physical and "Python" not in physical
    # The only exchange by key builds the broadcast table.
    assert physical.count("Exchange hashpartitioning") == 1


def test_distance_to_own_centre(spark):
    centres = spark.createDataFrame(
        [(1, 2.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)],
        "cluster_id int, center_x double, center_y double, center_z double",
    )
    rows = [("same", 0.0, 0.0, 1), ("antipode", 0.0, 0.0, 2), ("quarter", 0.0, 90.0, 1), ("zero centre", 0.0, 0.0, 3)]
    rows += [("unknown", 5.0, 5.0, 99), ("none", 5.0, 5.0, None)]
    members = sphere_features(spark.createDataFrame(rows, "id string, latitude double, longitude double, cluster_id int"))
    got = {r["id"]: r["dist_km"] for r in distance_to_centre(members, centres).collect()}
    assert got["same"] == 0.0 and got["unknown"] == 0.0 and got["none"] == 0.0
    assert math.isclose(got["antipode"], math.pi * R)
    assert math.isclose(got["quarter"], math.pi / 2 * R)
    assert math.isclose(got["zero centre"], math.pi / 2 * R)


def test_positions(spark):
    vectors = [(0.0, 0.0, 0.0), (0.0, 0.0, 2.0), (-1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]
    df = spark.createDataFrame(vectors, "x double, y double, z double")
    v = S.Vector(F.col("x"), F.col("y"), F.col("z"))
    got = df.select(S.latitude_of(v).alias("lat"), S.longitude_of(v).alias("lon")).collect()
    assert [(round(r["lat"], 9), round(r["lon"], 9)) for r in got] == [(0, 0), (90, 0), (0, 180), (0, 45)]


def test_assignment_join_drops_unassigned_and_idless(spark):
    events = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assignment = spark.createDataFrame([("a", 1), (None, 2)], "id string, cluster_id int")
    assert [tuple(r) for r in attach_assignment(events, assignment).collect()] == [("a", 1)]


@pytest.mark.parametrize("times", [2, 100])
def test_one_join_whatever_the_number_of_clusters(spark, times, plan_of):
    clusters = spark.createDataFrame(random_clusters(5 * times, lambda r: r.uniform(100, 900), 4), CLUSTER)
    df = match_clusters(spark.createDataFrame(random_events(100, 5), EVENT), clusters, per_pass=5)
    plan = plan_of(df).split("== Physical Plan ==")[1]
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1
    # Events are shuffled once: the aggregate stays where the join has put the rows.
    after_join = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in after_join and "Aggregate" in after_join


def test_hot_cubes_are_counted_and_dealt(spark):
    events = spark.createDataFrame([("hot", 1.0, 1.0, None)] * 300 + random_events(60, 6), EVENT).repartition(4)
    rows = random_clusters(50, lambda r: r.uniform(300, 2500), 7)
    clusters = spark.createDataFrame(rows, CLUSTER)
    placed = spark.createDataFrame([(1, 1, 1)] * 90 + [(2, 2, 2)] * 10 + [(None, None, None)] * 99, "_cube_x int, _cube_y int, _cube_z int")
    assert hot_cubes(placed, 20) == [(1, 1, 1, 5)]
    got = match_clusters(events, clusters, per_pass=1, hot_events=50)
    assert got.count() == 365
    assert {r[0] for r in got.where("id = 'hot'").select("cluster_id").distinct().collect()} == {first_match(("hot", 1.0, 1.0, None), rows)}


def test_long_lists_and_repeated_ids_come_in_bounded_pieces(spark):
    rows = [(i % 3 + 5, 1.0, 0.0, 0.0, 1.0 + i % 7) for i in range(1000)]
    lookup = cluster_lookup(spark.createDataFrame(rows, CLUSTER), per_pass=2)
    assert not lookup.broadcast
    assert lookup.table.agg(F.max(F.size("_candidates"))).first()[0] <= 64
    events = spark.createDataFrame([("a", 0.0, 0.0, None), ("b", 0.0, 0.04, None), ("c", 0.0, 9.0, None)], EVENT)
    got = {r["id"]: r["cluster_id"] for r in match_clusters(events, lookup).collect()}
    assert got == {e: first_match((e, 0.0, lon, None), rows) for e, lon in (("a", 0.0), ("b", 0.04), ("c", 9.0))}


def nearest(event, clusters):
    held = first_match(event, clusters)
    _, lat, lon, depth = event
    if held is not None or None in (lat, lon) or math.isnan(lat):
        return held
    shrink = (R - (depth or 0.0)) / R
    point = [shrink * x for x in unit(lat, lon)]
    return min((sum((x - y) ** 2 for x, y in zip(point, c[1:4])), c[0]) for c in clusters)[1]


@pytest.mark.parametrize("rows", [SETS["small"], SETS["many"], random_clusters(3, lambda r: 50.0, 8), SETS["mixed"][:1]])
@pytest.mark.parametrize("per_pass", [10_000, 2])
def test_nearest_equals_all_pairs(spark, rows, per_pass):
    events = random_events(150, 10)
    df = nearest_clusters(spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, CLUSTER), per_pass)
    assert df.columns == ["id", "latitude", "longitude", "depth_km", "cluster_id", "is_nearest"]
    got = {r["id"]: r["cluster_id"] for r in df.collect()}
    assert got == {e[0]: nearest(e, rows) for e in events}


def test_nearest_ties_and_no_clusters(spark):
    events = spark.createDataFrame([("a", 0.0, 0.0, None)], EVENT)
    rows = [(9, *unit(0, 10), 1.0), (4, *unit(0, -10), 1.0)]
    assert nearest_clusters(events, spark.createDataFrame(rows, CLUSTER)).first()["cluster_id"] == 4
    row = nearest_clusters(events, spark.createDataFrame([], CLUSTER)).first()
    assert (row["cluster_id"], row["is_nearest"]) == (None, False)


def derived_clusters(spark, n=40):
    """A dimension whose expected size Spark knows to be small, as that of a small file."""
    ids = spark.range(n)
    where = S.surface_vector(F.col("id") * 37 % 170 - 85, F.col("id") * 97 % 350 - 175)
    centre = [axis.alias(name) for name, axis in zip(("center_x", "center_y", "center_z"), where)]
    return ids.select(F.col("id").cast("int").alias("cluster_id"), *centre, (F.col("id") * 10 + 200.0).alias("max_r_km"))


def test_long_lists_of_a_small_dimension_are_not_broadcast(spark, plan_of):
    events, clusters = random_events(100, 11), derived_clusters(spark)
    df = match_clusters(spark.createDataFrame(events, EVENT), clusters, per_pass=5)
    plan = plan_of(df).split("== Physical Plan ==")[1]
    assert plan.count("SortMergeJoin") == 1
    rows = [tuple(row) for row in clusters.collect()]
    assert {r["id"]: r["cluster_id"] for r in df.collect()} == {e[0]: first_match(e, rows) for e in events}


def test_nearest_shuffles_cells_and_compares_few_centres(spark, plan_of):
    events, clusters = random_events(60, 12), derived_clusters(spark, 400)
    df = nearest_clusters(spark.createDataFrame(events, EVENT), clusters, per_pass=5)
    rows = [tuple(row) for row in clusters.collect()]
    assert {r["id"]: r["cluster_id"] for r in df.collect()} == {e[0]: nearest(e, rows) for e in events}
    # Neither the cells nor the centres are broadcast, whatever size Spark expects of them, and no list holds them.
    asks = spark.range(3).select(F.col("id").alias("_row"), *((F.col("id") / 10).alias(f"_point_{axis}") for axis in "xyz"))
    plan = plan_of(_ring(asks, usable_clusters(clusters), 0.25, 2.0)).split("== Physical Plan ==")[1]
    assert plan.count("SortMergeJoin") == 3 and "collect_list" not in plan


def test_nearest_beyond_the_broadcast_bound_of_points_and_centres_far_outside(spark):
    rows = [(i, *(3.0 * x for x in unit(i * 7 % 90, i * 31 % 180)), 5.0) for i in range(60)] + random_clusters(60, lambda r: 20.0, 13)
    events = random_events(80, 14)
    df = nearest_clusters(spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, CLUSTER), per_pass=2)
    assert {r["id"]: r["cluster_id"] for r in df.collect()} == {e[0]: nearest(e, rows) for e in events}


def test_pieces_leave_out_spheres_that_no_first_match_needs(spark):
    rows = [(i, *unit(math.degrees(0.001 + 0.00001 * (i % 5)), 0.0), 500.0 - i % 20) for i in range(400)]  # a crowd in one place
    lookup = cluster_lookup(spark.createDataFrame(rows, CLUSTER), per_pass=1)
    listed = lookup.table.select(F.explode("_candidates").alias("c")).select("c.cluster_id").distinct()
    assert listed.count() < 100  # most lie inside the first
    events = [(f"e{i}", 4.6 * (i % 7) / 6, -4.6 * (i // 7) / 6, 30.0 * (i % 4)) for i in range(49)]
    got = match_clusters(spark.createDataFrame(events, EVENT), lookup)
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == {e[0]: first_match(e, rows) for e in events}


def test_pieces_list_a_sphere_only_where_it_reaches(spark):
    rows = [(i, *unit(7.0 * i, 29.0 * i), 400.0) for i in range(12)]
    lookup = cluster_lookup(spark.createDataFrame(rows, CLUSTER), per_pass=1)
    pieces = lookup.table.select("_cube_x", "_cube_y", "_cube_z", F.explode("_candidates").alias("c")).collect()
    assert {r.c.cluster_id for r in pieces} == set(range(12))
    for r in pieces:
        lows = [place * lookup.edge for place in r[:3]]
        gaps = [max(low - at, at - low - lookup.edge, 0.0) for low, at in zip(lows, (r.c.center_x, r.c.center_y, r.c.center_z))]
        assert sum(g * g for g in gaps) <= (400.0 / R * (1 + 1e-6)) ** 2


def test_nearest_beyond_a_broadcast_keeps_one_table_of_askers(spark):
    rows = [(i, *unit(0.0, 0.05 * i), 10.0) for i in range(1000)]
    events = [(f"e{i}", 89.0 - 30 * i, 180.0, 0.0) for i in range(6)]
    made = []

    class Seen(clusters_module.Staged):
        def __init__(self, df, label):
            super().__init__(df, label)
            made.append(self)

    original, clusters_module.Staged = clusters_module.Staged, Seen
    try:
        got = nearest_clusters(spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, CLUSTER), per_pass=10).collect()
    finally:
        clusters_module.Staged = original
    assert len(got) == 6 and all(r.is_nearest for r in got)
    asks = [t.path for t in made if "/asks-" in t.path]
    assert asks and not any(os.path.exists(path) for path in asks)
