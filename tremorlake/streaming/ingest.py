"""Enrichment and the streaming job."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tremorlake.operators.clusters import ClusterLookup, cluster_lookup, match_clusters
from tremorlake.operators.dedup import keep_first
from tremorlake.operators.regions import BoxPlan, locate, plan_box_join
from tremorlake.schemas import SERVING_COLUMNS, SERVING_SCHEMA
from tremorlake.sources.versions import CommitLog, Snapshots, delete_path, matching_paths
from tremorlake.sources.writers import Staged, write_parquet
from tremorlake.streaming.parse import parse_quakes

# Source options and the trigger interval.
KAFKA_DEFAULTS = {"startingOffsets": "latest", "failOnDataLoss": "false"}
TRIGGER_INTERVAL = "5 seconds"

BATCH_COLUMN = "batch_id"


def kafka_source(
    spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A Kafka topic as a stream (needs the Kafka connector on the class path)."""
    settings = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        **KAFKA_DEFAULTS,
        **(options or {}),
    }
    return stream_source(spark, "kafka", settings)


def stream_source(spark: SparkSession, format: str, options: Mapping[str, str]) -> DataFrame:
    """Any streaming source that delivers messages in a ``value`` column."""
    options = dict(options)
    path = options.pop("path", None)
    return spark.readStream.format(format).options(**options).load(path)


def enrich(
    events: DataFrame, regions: DataFrame, clusters: DataFrame | ClusterLookup, plan: BoxPlan | None = None
) -> DataFrame:
    """Events with region and cluster; an event without either keeps NULLs.

    Both lookups join against static sides, so a stream needs no state.
    """
    boxes = regions.select(
        "region_id", "region", "sub_region", "lat_min", "lat_max", "lon_min", "lon_max"
    )
    return match_clusters(locate(events, boxes, "left", plan), clusters).select(*SERVING_COLUMNS)


class StaticSides:
    """The sides of the enrichment, laid out once for each version of them and not for each micro-batch.

    A side is a DataFrame, read once, or ``Snapshots``, whose latest version is looked up at every batch
    border. What the lookups need is measured, computed and written when a version is first seen, so a
    micro-batch only reads it: it neither aggregates nor shuffles a static side, and files that are
    overwritten meanwhile cannot stop the stream.
    """

    def __init__(self, regions: DataFrame | Snapshots, clusters: DataFrame | Snapshots) -> None:
        self._sources = {"regions": regions, "clusters": clusters}
        self._versions: dict[str, int | None] = {}
        self._staged: dict[str, Staged] = {}
        self._plan: BoxPlan | None = None
        self._lookup: ClusterLookup | None = None

    def _changed(self, spark: SparkSession, side: str) -> DataFrame | None:
        """The side if it has a version not seen yet."""
        source = self._sources[side]
        if isinstance(source, DataFrame):
            known = side in self._versions
            self._versions[side] = None
            return None if known else source
        if self._versions.get(side) == source.version(spark):
            return None
        self._versions[side], df = source.latest(spark)
        return df

    def _keep(self, side: str, df: DataFrame) -> DataFrame:
        """``df`` written; the version before goes, as the batch that read it has ended."""
        before, self._staged[side] = self._staged.get(side), Staged(df, side)
        if before is not None:
            before.drop()
        return self._staged[side].df

    def refresh(self, spark: SparkSession) -> None:
        regions = self._changed(spark, "regions")
        if regions is not None:
            self._plan = plan_box_join(self._keep("regions", regions))
        clusters = self._changed(spark, "clusters")
        if clusters is not None:
            lookup = cluster_lookup(clusters)
            self._lookup = lookup._replace(table=self._keep("clusters", lookup.table))

    def enrich(self, events: DataFrame) -> DataFrame:
        """Events of one micro-batch with the latest regions and clusters."""
        self.refresh(events.sparkSession)
        return enrich(events, self._staged["regions"].df, self._lookup, self._plan)

    def close(self) -> None:
        for staged in self._staged.values():
            staged.drop()
        self._staged.clear()
        self._versions.clear()


_COMPACTIONS = "generation bigint, low bigint, high bigint, name string"


@dataclass(frozen=True)
class ParquetServing:
    """Serving table as Parquet files, partitioned by day and micro-batch.

    A micro-batch overwrites its own partitions. One that is delivered again after a failure
    therefore replaces its earlier rows instead of adding to them.

    ``compact`` merges the batches of a range into one folder and says so in a log. A reader takes the
    batches beyond the last range as they are and everything before from the compacted folders alone,
    so a batch of a compacted range that is delivered once more is written but never read.
    """

    path: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(f"{self.path}/_state/compactions", _COMPACTIONS)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        write_parquet(
            batch.withColumn(BATCH_COLUMN, F.lit(batch_id).cast("bigint")),
            self.path,
            ["day", BATCH_COLUMN],
            overwrite="partitions",
        )

    def _live(self, spark: SparkSession) -> tuple[list, int]:
        """Compactions that no later one covers, and the last batch they reach (-1: none)."""
        entries = self.log.entries(spark)
        later = entries.select(F.col("generation").alias("g"), F.col("low").alias("l"), F.col("high").alias("h"))
        covered = (F.col("g") > F.col("generation")) & (F.col("l") <= F.col("low")) & (F.col("h") >= F.col("high"))
        live = entries.join(F.broadcast(later), covered, "left_anti").collect()
        return live, max((entry["high"] for entry in live), default=-1)

    def _parquet(self, spark: SparkSession, *paths: str) -> DataFrame:
        batch = T.StructField(BATCH_COLUMN, T.LongType())
        schema = T.StructType([*SERVING_SCHEMA.fields, batch])
        return spark.read.schema(schema).parquet(*paths).select(*schema.names)

    def _compacted(self, spark: SparkSession, entries: list) -> list[DataFrame]:
        return [self._parquet(spark, f"{self.path}/_state/{entry['name']}") for entry in entries]

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of all batches: one per delivery, and of compacted ranges the last of each key."""
        live, done = self._live(spark)
        rows = self._parquet(spark, self.path).where(F.col(BATCH_COLUMN) > done)
        for part in self._compacted(spark, live):
            rows = rows.union(part)
        return rows

    def compact(self, spark: SparkSession, through: int | None = None, merge: bool = False) -> int | None:
        """Merge the batches after the last compaction, up to ``through``; the generation made, or None.

        The newest batch may still be written, so by default it is left out. ``merge`` takes the earlier
        compactions in as well. One process compacts at a time; the stream need not stop.
        """
        live, done = self._live(spark)
        rows = self._parquet(spark, self.path).where(F.col(BATCH_COLUMN) > done)
        low, high = rows.agg(F.min(BATCH_COLUMN), F.max(BATCH_COLUMN)).first()
        if low is None:
            return None
        high = high - 1 if through is None else min(high, through)
        if high < low:
            return None
        rows = rows.where(F.col(BATCH_COLUMN) <= high)
        if merge:
            for part in self._compacted(spark, live):
                rows = rows.union(part)
            low = min([low, *(entry["low"] for entry in live)])
        name = f"range-{low}-{high}-{uuid.uuid4().hex}"
        write_parquet(last_written(rows), f"{self.path}/_state/{name}", ["day"])
        generation = self.log.entries(spark).count() + 1
        self.log.append(spark, generation, low, high, name)
        return generation

    def vacuum(self, spark: SparkSession) -> None:
        """Delete what no new reader takes: batches of compacted ranges and compactions covered by later ones."""
        live, done = self._live(spark)
        for folder in matching_paths(spark, f"{self.path}/day=*/{BATCH_COLUMN}=*"):
            if int(folder.rstrip("/").rsplit("=", 1)[-1]) <= done:
                delete_path(spark, folder)
        names = {entry["name"] for entry in live}
        for folder in matching_paths(spark, f"{self.path}/_state/range-*"):
            if folder.rstrip("/").rsplit("/", 1)[-1] not in names:
                delete_path(spark, folder)


@dataclass(frozen=True)
class ConnectorServing:
    """Serving table behind a connector, for example a keyed store that upserts.

    A micro-batch delivered again after a failure is written again, so the store must replace rows by key.
    """

    format: str
    options: Mapping[str, str] = field(default_factory=dict)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.format(self.format).options(**self.options).mode("append").save()


def last_written(serving: DataFrame, keys: tuple[str, ...] = ("day", "id")) -> DataFrame:
    """The last written row per key, with its batch."""
    order = [BATCH_COLUMN, *(name for name in SERVING_COLUMNS if name not in keys)]
    columns = [F.col(key) for key in keys]
    return keep_first(serving, columns, [F.desc(name) for name in order], null_keys="collapse")


def latest_per_key(serving: DataFrame, keys: tuple[str, ...] = ("day", "id")) -> DataFrame:
    """The keyed view of an append-only serving table: the last written row per key.

    Keys are never NULL here, so one scan does; a filter on a key column reaches that scan.
    """
    return last_written(serving, keys).select(*SERVING_COLUMNS)


def start_ingest(
    messages: DataFrame,
    regions: DataFrame | Snapshots,
    clusters: DataFrame | Snapshots,
    serving: ParquetServing | ConnectorServing,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Parse, enrich and append messages to the serving table; recovers from ``checkpoint``.

    A side given as ``Snapshots`` may be published anew while the query runs; the next batch uses it.
    """
    sides = StaticSides(regions, clusters)

    def write(batch: DataFrame, batch_id: int) -> None:
        serving.write_batch(sides.enrich(parse_quakes(batch)), batch_id)

    writer = (
        messages.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER_INTERVAL}))
    )
    return writer.foreachBatch(write).start()
