"""The composite jobs end to end, from raw directories to stored facts."""

import uuid

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from tremorlake.checks import views as V
from tremorlake.operators.normalize import TERRAQUAKE, USGS
from tremorlake.plans.clean import clean_events, run_clean
from tremorlake.plans.cluster_facts import run_cluster_spheres, run_cluster_zones
from tremorlake.plans.region_fact import region_daily_fact, run_region_fact
from tremorlake.schemas import (
    REGION_FACT_COLUMNS,
    REGION_SCHEMA,
    SPHERE_DIMENSION_SCHEMA,
    SPHERE_FACT_COLUMNS,
    TRIAL_SCHEMA,
    UNIFIED_COLUMNS,
    ZONE_DIMENSION_COLUMNS,
    ZONE_FACT_COLUMNS,
)
from tremorlake.sources.readers import read_csv, scan_feed
from tremorlake.sources.writers import write_csv, write_parquet


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Raw feeds and regions on disk, and the clean table made from them."""
    root = str(tmp_path_factory.mktemp("jobs"))
    write_parquet(V.usgs_feed(spark, SMALL), f"{root}/usgs", ["dt"])
    write_parquet(V.terraquake_feed(spark, SMALL), f"{root}/terraquake", ["dt"])
    write_csv(V.regions(spark, SMALL).select(*REGION_SCHEMA.names), f"{root}/regions")
    clean = f"clean_{uuid.uuid4().hex}"
    feeds = {f"{root}/usgs": USGS, f"{root}/terraquake": TERRAQUAKE}
    run_clean(spark, feeds, clean, f"{root}/clean")
    return root, clean


def test_clean_table(spark, base):
    root, clean = base
    table = spark.table(clean)
    assert set(table.columns) == set(UNIFIED_COLUMNS)
    feeds = [(scan_feed(spark, f"{root}/usgs"), USGS), (scan_feed(spark, f"{root}/terraquake"), TERRAQUAKE)]
    expected = clean_events(feeds)
    stored = table.select(*UNIFIED_COLUMNS)
    assert stored.exceptAll(expected).isEmpty() and expected.exceptAll(stored).isEmpty()
    assert table.select("id").distinct().count() == table.count()


def test_region_fact_table(spark, base):
    root, clean = base
    name = f"regions_{uuid.uuid4().hex}"
    run_region_fact(spark, f"{root}/regions", clean, name)
    fact = spark.table(name)
    assert set(fact.columns) == set(REGION_FACT_COLUMNS)
    classes = F.col("mag_count_small") + F.col("mag_count_medium") + F.col("mag_count_large")
    assert fact.filter(classes != F.col("total_events")).isEmpty()
    assert fact.agg(F.sum("total_events")).first()[0] >= spark.table(clean).count()


def test_one_day_of_the_region_fact_can_be_replaced(spark, base):
    root, clean = base
    name = f"regions_{uuid.uuid4().hex}"
    run_region_fact(spark, f"{root}/regions", clean, name)
    before = spark.table(name).count()
    day = spark.table(name).agg(F.min("dt")).first()[0]
    view = f"one_day_{uuid.uuid4().hex}"
    spark.table(clean).filter(F.col("dt") == F.lit(day)).createOrReplaceTempView(view)
    run_region_fact(spark, f"{root}/regions", view, name, overwrite="partitions")
    assert spark.table(name).count() == before


def test_cluster_sphere_outputs(spark, base):
    root, clean = base
    run_cluster_spheres(spark, f"{root}/metrics", f"{root}/dim", f"{root}/fact", clean, ks=(3, 5), trials=1)
    assert read_csv(spark, f"{root}/metrics", TRIAL_SCHEMA).count() == 2
    dimension = read_csv(spark, f"{root}/dim", SPHERE_DIMENSION_SCHEMA)
    assert dimension.count() in (3, 5) and dimension.filter("max_r_km > 0").count() == dimension.count()
    fact = spark.read.parquet(f"{root}/fact")
    assert tuple(fact.columns) == SPHERE_FACT_COLUMNS
    assert fact.agg(F.sum("total_events")).first()[0] == spark.table(clean).count()


def test_cluster_zone_tables(spark, base):
    _, clean = base
    dim, fact = (f"{kind}_{uuid.uuid4().hex}" for kind in ("dim", "fact"))
    run_cluster_zones(spark, clean, dim, fact, k=4)
    assert tuple(spark.table(dim).columns) == ZONE_DIMENSION_COLUMNS
    assert set(spark.table(fact).columns) == set(ZONE_FACT_COLUMNS)
    total = spark.table(clean).count()
    assert spark.table(dim).agg(F.sum("event_count_in_cluster")).first()[0] == total
    assert spark.table(fact).agg(F.sum("total_events")).first()[0] == total


def test_the_fact_reads_only_what_it_needs(spark, base, plan_of):
    _, clean = base
    plan = plan_of(region_daily_fact(spark.table(clean), V.regions(spark, SMALL)))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "mag_type" not in schema and "source_system" not in schema and "time_utc" not in schema
    assert "IsNotNull(latitude)" in plan and "Python" not in plan.split("== Physical Plan ==")[1]


def test_rows_without_id_are_looked_up_by_a_pushed_filter(spark, base, plan_of):
    root, _ = base
    feeds = [(scan_feed(spark, f"{root}/usgs"), USGS), (scan_feed(spark, f"{root}/terraquake"), TERRAQUAKE)]
    plan = plan_of(clean_events(feeds)).split("== Physical Plan ==")[1]
    assert "PushedFilters: [IsNull(id)" in plan and "IsNull(properties.eventId)" in plan
    assert plan.count("Exchange hashpartitioning") == 2
