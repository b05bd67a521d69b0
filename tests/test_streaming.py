import datetime as dt
import json
from collections import Counter

import pytest
from paths import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tremorlake.checks import views as V
from tremorlake.checks.catalog import write_messages
from tremorlake.plans.serving import filter_events
from tremorlake.schemas import REGION_SCHEMA, SERVING_COLUMNS, SERVING_SCHEMA, STREAM_COLUMNS
from tremorlake.sources.versions import Snapshots, path_exists
from tremorlake.streaming.ingest import (
    ConnectorServing,
    ParquetServing,
    StaticSides,
    enrich,
    kafka_source,
    latest_per_key,
    start_ingest,
    stream_source,
)
from tremorlake.streaming.parse import parse_json, parse_quakes

CLUSTER = "cluster_id int, center_x double, center_y double, center_z double, max_r_km double"


def messages(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string").select(F.col("value").cast("binary"))


def test_parse_keeps_only_usable_messages(spark):
    good = {"id": "a", "time_utc": "1704067200500", "magnitude": 4.1, "latitude": 1.0, "depth_km": "deep"}
    texts = [
        json.dumps(good),
        json.dumps({**good, "id": "b", "time_utc": 1704067200500}),
        json.dumps({**good, "id": "c", "time_utc": "2024-01-01T00:00:00.500Z"}),
        json.dumps({**good, "id": "d", "time_utc": "junk"}),
        json.dumps({**good, "id": None}),
        "{broken",
        "",
        None,
    ]
    df = parse_quakes(messages(spark, texts))
    assert tuple(df.columns) == STREAM_COLUMNS
    got = {r["id"]: r for r in df.withColumn("ms", F.unix_millis("time_utc")).collect()}
    assert set(got) == {"a", "b", "c"} and {r["ms"] for r in got.values()} == {1704067200500}
    assert got["a"]["magnitude"] == 4.1 and got["a"]["depth_km"] is None and got["a"]["longitude"] is None


def test_malformed_json_gives_null_fields(spark):
    df = parse_json(messages(spark, ["{bad", None, '{"id": "x"}']), REGION_SCHEMA)
    assert df.columns == REGION_SCHEMA.names and df.count() == 3


@pytest.fixture
def sides(spark):
    return V.regions(spark, SMALL).cache(), V.clusters(spark, SMALL).cache()


def ingest(spark, root, sides, serving):
    source = stream_source(spark, "text", {"path": f"{root}/in", "maxFilesPerTrigger": "2"})
    query = start_ingest(source, *sides, serving, f"{root}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    return query


def rows(df):
    return Counter(tuple(r) for r in df.select(*SERVING_COLUMNS).collect())


def test_stream_equals_batch_and_resumes(spark, tmp_path, sides):
    root = str(tmp_path)
    write_messages(spark, SMALL, f"{root}/in", files=5)
    serving = ParquetServing(f"{root}/out")
    query = ingest(spark, root, sides, serving)
    assert len(query.recentProgress) > 1
    assert all(not p["stateOperators"] for p in query.recentProgress)
    batch = enrich(parse_quakes(spark.read.text(f"{root}/in")), *sides)
    assert rows(serving.read(spark)) == rows(batch)

    # Starting again from the checkpoint reads only what is new.
    line = json.dumps({"id": "late", "time_utc": "1704067200500", "latitude": 0.0, "longitude": 0.0})
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(f"{root}/in")
    ingest(spark, root, sides, serving)
    added = rows(serving.read(spark)) - rows(batch)
    assert {r[1] for r in added} == {"late"}


def test_a_batch_delivered_twice_adds_nothing(spark, tmp_path, sides):
    serving = ParquetServing(str(tmp_path / "out"))
    events = enrich(parse_quakes(messages(spark, [json.dumps({"id": "a", "time_utc": "1704067200500"})])), *sides)
    for batch_id in (0, 0, 1):
        serving.write_batch(events, batch_id)
    assert serving.read(spark).count() == 2
    assert latest_per_key(serving.read(spark)).count() == 1


def test_latest_per_key_prefers_the_later_batch(spark):
    base = spark.createDataFrame([], SERVING_SCHEMA).columns
    values = {c: None for c in base} | {"id": "a"}
    schema = SERVING_SCHEMA.simpleString()[7:-1].replace(":", " ")
    rows = [(*{**values, "place": p}.values(), b) for p, b in (("new", 2), ("old", 1))]
    day = spark.createDataFrame(rows, schema.replace(",", ", ") + ", batch_id bigint").withColumn("day", F.to_date(F.lit("2024-01-01")))
    assert [r["place"] for r in latest_per_key(day).collect()] == ["new"]


def test_a_day_filter_prunes_the_keyed_view(spark, tmp_path, sides, plan_of):
    serving = ParquetServing(str(tmp_path / "out"))
    event = json.dumps({"id": "a", "time_utc": "1704067200500", "magnitude": 2.0})
    serving.write_batch(enrich(parse_quakes(messages(spark, [event])), *sides), 0)
    day = dt.date(2024, 1, 1)
    df = filter_events(latest_per_key(serving.read(spark)), day, day, 0, 9)
    assert df.count() == 1
    partition_filters = plan_of(df).split("PartitionFilters: [")[1].split("]")[0]
    assert "day#" in partition_filters


def test_default_trigger(spark, tmp_path, sides):
    root = str(tmp_path)
    write_messages(spark, SMALL, f"{root}/in", files=1)
    serving = ParquetServing(f"{root}/out")
    query = start_ingest(stream_source(spark, "text", {"path": f"{root}/in"}), *sides, serving, f"{root}/ck")
    query.processAllAvailable()
    query.stop()
    assert serving.read(spark).select("id").distinct().count() == 1000


def test_kafka_options_need_the_connector(spark):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        kafka_source(spark, "localhost:9092", "quakes")


def test_connector_sink(spark, tmp_path, sides):
    root = str(tmp_path)
    write_messages(spark, SMALL, f"{root}/in", files=1)
    ingest(spark, root, sides, ConnectorServing("parquet", {"path": f"{root}/out"}))
    assert spark.read.parquet(f"{root}/out").select("id").distinct().count() == 1000


def test_unmatched_events_keep_nulls(spark):
    boxes = spark.createDataFrame([(1, "r", "s", 50.0, 60.0, 50.0, 60.0)], REGION_SCHEMA)
    clusters = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 10.0)], CLUSTER)
    event = parse_quakes(messages(spark, [json.dumps({"id": "a", "time_utc": "0", "latitude": -5.0, "longitude": -5.0})]))
    row = enrich(event, boxes, clusters).first()
    assert (row["id"], row["region_id"], row["region"], row["cluster_id"]) == ("a", None, None, None)


BOX = (50.0, 60.0, 50.0, 60.0)


def quake(ident, day=1, **values):
    time = f"2024-01-0{day}T00:00:00Z"
    return json.dumps({"id": ident, "time_utc": time, "latitude": 55.0, "longitude": 55.0, **values})


def test_a_dimension_published_while_the_query_runs(spark, tmp_path):
    root = str(tmp_path)
    regions, clusters = Snapshots(f"{root}/regions"), Snapshots(f"{root}/clusters")
    clusters.publish(spark.createDataFrame([(1, 1.0, 0.0, 0.0, 10.0)], CLUSTER))
    assert regions.version(spark) is None
    regions.publish(spark.createDataFrame([(1, "old", "s", *BOX)], REGION_SCHEMA))
    serving = ParquetServing(f"{root}/out")

    def send(ident):
        spark.createDataFrame([(quake(ident),)], "value string").write.mode("append").text(f"{root}/in")

    send("a")
    source = stream_source(spark, "text", {"path": f"{root}/in"})
    query = start_ingest(source, regions, clusters, serving, f"{root}/ck", {"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        assert regions.publish(spark.createDataFrame([(2, "new", "s", *BOX)], REGION_SCHEMA)) == 2
        regions.vacuum(spark, keep=1)
        send("b")
        query.processAllAvailable()
        assert query.isActive and query.exception() is None
    finally:
        query.stop()
    assert {r["id"]: r["region"] for r in serving.read(spark).collect()} == {"a": "old", "b": "new"}


def test_a_side_overwritten_in_place_does_not_stop_the_stream(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "r", "s", *BOX)], REGION_SCHEMA).write.parquet(f"{root}/regions")
    clusters = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 10.0)], CLUSTER)
    sides = StaticSides(spark.read.parquet(f"{root}/regions"), clusters)
    events = parse_quakes(messages(spark, [quake("a")]))
    assert sides.enrich(events).first()["region_id"] == 1
    spark.createDataFrame([(2, "r", "s", *BOX)], REGION_SCHEMA).write.mode("overwrite").parquet(f"{root}/regions")
    assert sides.enrich(events).first()["region_id"] == 1
    sides.close()


def test_a_micro_batch_neither_aggregates_nor_shuffles_a_side(spark, sides, plan_of):
    static = StaticSides(*sides)
    plan = plan_of(static.enrich(parse_quakes(messages(spark, [quake("a")])))).split("== Physical Plan ==")[1]
    assert "Aggregate" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    static.close()


def served(batches, spark, serving):
    sides = spark.createDataFrame([(1, "r", "s", *BOX)], REGION_SCHEMA), spark.createDataFrame([(1, 1.0, 0.0, 0.0, 10.0)], CLUSTER)
    for batch_id, texts in batches:
        serving.write_batch(enrich(parse_quakes(messages(spark, texts)), *sides), batch_id)


def places(spark, serving):
    return {(r["day"].day, r["id"]): r["place"] for r in latest_per_key(serving.read(spark)).collect()}


def test_a_replayed_batch_of_a_compacted_range_stays_away(spark, tmp_path):
    serving = ParquetServing(str(tmp_path / "out"))
    served([(0, [quake("a", place="0"), quake("b", 2, place="0")]), (1, [quake("a", place="1")]), (2, [quake("c", place="2")])], spark, serving)
    before = places(spark, serving)
    assert serving.compact(spark) == 1  # the newest batch may still be written
    assert serving.read(spark).count() == 3 and places(spark, serving) == before
    # Delivered again with other rows, as if the source had lost its order.
    served([(0, [quake("a", place="again"), quake("z", 3, place="again")])], spark, serving)
    assert places(spark, serving) == before
    # The batch beyond the range is still replaced by its replay.
    served([(2, [quake("c", place="2 again")])], spark, serving)
    assert places(spark, serving)[1, "c"] == "2 again"


def test_compactions_merge_and_old_files_go(spark, tmp_path):
    root = str(tmp_path / "out")
    serving = ParquetServing(root)
    assert not path_exists(spark, f"{root}/_state")
    served([(i, [quake("a", place=str(i)), quake(f"n{i}", 2, place=str(i))]) for i in range(4)], spark, serving)
    assert [serving.compact(spark, through=n) for n in (0, 0, 2)] == [1, None, 2]
    before = places(spark, serving)
    assert serving.compact(spark, through=3, merge=True) == 3
    entries = serving.log.entries(spark).orderBy("generation").collect()
    assert [(e["low"], e["high"]) for e in entries] == [(0, 0), (1, 2), (0, 3)]
    assert places(spark, serving) == before and serving.read(spark).count() == 5
    serving.vacuum(spark)
    assert places(spark, serving) == before
    served([(4, [quake("a", place="4")])], spark, serving)
    assert places(spark, serving) == before | {(1, "a"): "4"}


def test_snapshots_keep_what_is_asked(spark, tmp_path):
    table = Snapshots(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="nothing has been published"):
        table.latest(spark)
    for n in (1, 2, 3):
        assert table.publish(spark.range(n)) == n
    held = table.latest(spark)[1]
    table.publish(spark.range(9))
    table.vacuum(spark, keep=2)
    assert held.count() == 3 and table.latest(spark)[1].count() == 9
