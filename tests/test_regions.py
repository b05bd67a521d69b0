import random

import pytest
from pyspark.sql import functions as F

from tremorlake.operators.regions import BoxPlan, _boxes_in_leaves, dense_cells, locate, plan_box_join
from tremorlake.schemas import REGION_SCHEMA

PLANS = [
    None,
    BoxPlan("broadcast_cells", 0.25),
    BoxPlan("broadcast_cells", 30.0),
    BoxPlan("shuffle_cells", 5.0, salts=1),
    BoxPlan("shuffle_cells", 5.0, salts=7),
]
BOXES = [
    (1, "A", "a", 0.0, 10.0, 0.0, 10.0),
    (2, "A", "b", 10.0, 20.0, 0.0, 10.0),
    (3, "B", "c", -90.0, 90.0, -180.0, -170.0),
    (4, "B", "turned", 5.0, -5.0, 0.0, 1.0),
    (5, "B", "gap", None, 5.0, 0.0, 1.0),
    (6, "C", "beyond", -1e9, 1e9, 170.0, float("inf")),
]


def boxes(spark, rows=BOXES):
    return spark.createDataFrame(rows, REGION_SCHEMA)


def points(spark, rows):
    return spark.createDataFrame(rows, "id string, latitude double, longitude double")


def hits(df):
    return sorted((r["id"], r["region_id"] or 0) for r in df.collect())


def brute_force(rows, how):
    out = []
    for ident, lat, lon in rows:
        found = [
            b[0]
            for b in BOXES
            if None not in (lat, lon, b[3])
            and b[3] <= lat <= b[4]
            and b[5] <= lon <= b[6]
        ]
        out += [(ident, f) for f in found] or ([(ident, 0)] if how == "left" else [])
    return sorted(out)


EDGE_ROWS = [
    ("inside", 5.0, 5.0),
    ("shared edge", 10.0, 5.0),
    ("corner", 0.0, 0.0),
    ("outside", 50.0, 50.0),
    ("no position", None, 5.0),
    ("no longitude", 5.0, None),
    ("date line", 12.0, -180.0),
    ("far beyond", 500.0, 1000.0),
]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("plan", PLANS)
def test_all_plans_equal_brute_force(spark, plan, how):
    rnd = random.Random(5)
    rows = EDGE_ROWS + [(f"r{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)]
    rows += [("hot", 7.0, 7.0)] * 300
    df = locate(points(spark, rows), boxes(spark), how, plan)
    assert df.columns == ["id", "latitude", "longitude", *REGION_SCHEMA.names]
    assert hits(df) == brute_force(rows, how)


def test_shared_edge_counts_twice(spark):
    assert hits(locate(points(spark, [("e", 10.0, 3.0)]), boxes(spark))) == [("e", 1), ("e", 2)]


def test_empty_dimension(spark):
    empty = boxes(spark, [])
    assert hits(locate(points(spark, EDGE_ROWS[:1]), empty)) == []
    assert hits(locate(points(spark, EDGE_ROWS[:1]), empty, "left")) == [("inside", 0)]


def test_the_measured_size_chooses_the_plan(spark):
    assert plan_box_join(boxes(spark)).kind == "nested_loop"
    many = spark.range(5000).selectExpr(
        "cast(id as int) region_id", "'x' region", "'y' sub_region",
        "cast(id % 170 - 85 as double) lat_min", "cast(id % 170 - 83 as double) lat_max",
        "cast(id % 350 - 175 as double) lon_min", "cast(id % 350 - 173 as double) lon_max",
    )
    by_cells = plan_box_join(many)
    assert by_cells.kind == "broadcast_cells" and by_cells.cell_degrees <= 2.0
    assert plan_box_join(many, broadcast_cells=1000).kind == "shuffle_cells"


def test_plan_shapes(spark, plan_of):
    events = points(spark, EDGE_ROWS)
    assert "BroadcastNestedLoopJoin BuildRight, Inner" in plan_of(locate(events, boxes(spark)))
    cells = plan_of(locate(events, boxes(spark), "inner", BoxPlan("broadcast_cells", 5.0)))
    assert "BroadcastHashJoin" in cells and "hashpartitioning" not in cells
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = plan_of(locate(events, boxes(spark), "left", BoxPlan("shuffle_cells", 5.0, 4)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in shuffled and "_salt" in shuffled


def test_a_hot_cell_is_spread_over_several_reducers(spark):
    """A third of the rows are copies of one point; plain hashing would put them on one reducer."""
    hot = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) id",
        "if(id % 3 = 0, 5.0d, cast(id % 90 as double)) latitude",
        "if(id % 3 = 0, 5.0d, cast(id % 170 as double)) longitude",
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = locate(hot.repartition(8), boxes(spark), "left", BoxPlan("shuffle_cells", 5.0, 32))
        found = joined.filter("id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in found) == 3000
    assert len(found) >= 4 and max(r["count"] for r in found) < 2000


def test_unknown_join_type(spark):
    with pytest.raises(ValueError):
        locate(points(spark, EDGE_ROWS), boxes(spark), "cross")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("plan", PLANS)
def test_first_box_equals_brute_force(spark, plan, how):
    rnd = random.Random(6)
    rows = EDGE_ROWS + [(f"r{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(100)]
    rows += [("hot", 10.0, 7.0)] * 200
    df = locate(points(spark, rows), boxes(spark), how, plan, resolve="first")
    assert df.columns == ["id", "latitude", "longitude", *REGION_SCHEMA.names]
    expected = []
    for row in rows:
        expected += brute_force([row], how)[:1]
    assert hits(df) == sorted(expected)


def test_first_box_among_many_in_one_cell(spark):
    rows = [(i, "r", "s", 0.0, 1.0 + i % 3, 0.0, 1.0) for i in range(300, 0, -1)]
    got = locate(points(spark, [("a", 2.5, 0.5), ("b", 0.5, 0.5)]), boxes(spark, rows), "left", BoxPlan("shuffle_cells", 30.0), "first")
    assert hits(got) == [("a", 2), ("b", 1)]


def test_only_dense_cells_are_split_and_salted(spark):
    """A third of the events on one point, a third in one city, the rest everywhere."""
    rnd = random.Random(1)
    rows = [("hot", 7.0, 7.0)] * 1000 + [("city", 41 + rnd.random(), 29 + rnd.random()) for _ in range(1000)]
    rows += [("far", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(1000)]
    events = points(spark, rows)
    tree = dense_cells(events, 10.0)
    assert set(tree.split[0]) >= {(0, 0), (4, 2)} and len(tree.split[0]) < 40
    salts = {cell[:2]: cell[2] for cell in tree.salts}
    assert salts.pop((44, 44)) == 32  # edge 10 / 64: the point
    assert all(41 <= lat * 10 / 64 + 1 and n <= 8 for (lat, _), n in salts.items())  # blocks of the city
    small = [(i, "r", "s", float(lat), lat + 2.0, float(lon), lon + 2.0) for i, (lat, lon) in enumerate((a, b) for a in range(-88, 88, 8) for b in range(-178, 178, 8))]
    small += [(9999, "r", "around the hot point", 6.5, 7.5, 6.5, 7.5)]
    assert _boxes_in_leaves(boxes(spark, small), tree).count() < 20 * len(small)
    joined = locate(events.repartition(8), boxes(spark, small), "left", BoxPlan("shuffle_cells", 10.0))
    got = joined.where("region_id is not null").groupBy("id").count()
    expected = {}
    for name, lat, lon in rows:
        n = sum(b[3] <= lat <= b[4] and b[5] <= lon <= b[6] for b in small)
        expected[name] = expected.get(name, 0) + n
    assert {r["id"]: r["count"] for r in got.collect()} == {k: v for k, v in expected.items() if v}


def test_unknown_resolution(spark):
    with pytest.raises(ValueError):
        locate(points(spark, EDGE_ROWS), boxes(spark), resolve="last")
