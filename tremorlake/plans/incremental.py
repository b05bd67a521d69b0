"""Daily facts kept up to date file by file.

The clean table is a directory with a folder for each day. What each file adds to the fact is kept as mergeable
partials (counts, sums, extremes, the biggest event). An update lists the files, reads those that are new,
and merges the partials of the days they belong to. A day that has lost a file, or has one of another size or
time, is computed anew from all its files. Other days are not touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.daily_stats import daily_partials, merge_partials
from tremorlake.operators.regions import locate
from tremorlake.plans.region_fact import BIGGEST
from tremorlake.schemas import REGION_FACT_COLUMNS
from tremorlake.sources.readers import scan_feed
from tremorlake.sources.versions import Snapshots, delete_path, path_exists
from tremorlake.sources.writers import Staged, write_parquet


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """(dt, file, length, changed) of every Parquet file below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("dt").cast("date").alias("dt"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))


@dataclass(frozen=True)
class IncrementalFact:
    """A daily fact below ``fact`` made from ``source``, with its state below ``state``.

    ``prepare`` turns events into rows with ``key`` (a join with regions, an assignment of clusters); it must
    give the same for an event whatever else is read with it. ``columns`` are those of the fact.
    """

    source: str
    state: str
    fact: str
    prepare: Callable[[DataFrame], DataFrame]
    key: str
    biggest: Mapping[str, str]
    columns: tuple[str, ...]

    @property
    def _known(self) -> Snapshots:
        """(dt, file, length, changed, part): every file of the last update and the partials it went into."""
        return Snapshots(f"{self.state}/files")

    def update(self, spark: SparkSession) -> list:
        """Bring the fact up to date; the days that changed, ascending.

        The fact is written before the list of files, so an update that dies is simply done again. One
        update runs at a time.
        """
        listed = Staged(day_files(spark, self.source), "files")
        try:
            return self._update(spark, listed.df)
        finally:
            listed.drop()

    def _update(self, spark: SparkSession, now: DataFrame) -> list:
        same = ["dt", "file", "length", "changed"]
        if self._known.version(spark) is None:
            known = now.limit(0).withColumn("part", F.lit(""))
        else:
            known = self._known.latest(spark)[1]
        gone = known.join(now, same, "left_anti").select("dt").distinct()
        stay = known.join(F.broadcast(gone), "dt", "left_anti")  # whose partials remain good
        fresh = now.join(stay, same, "left_anti")
        part = uuid.uuid4().hex
        # As many rows as files have changed, and days.
        todo = fresh.select("dt", "file").collect()
        days = sorted({row["dt"] for row in todo} | {row["dt"] for row in gone.collect()})
        if not days:
            return []
        if todo:
            whole = len(todo) == now.count()
            base = spark.read.option("basePath", self.source)
            events = scan_feed(spark, self.source) if whole else base.parquet(*(row["file"] for row in todo))
            partials = daily_partials(self.prepare(events), self.key, self.biggest)
            write_parquet(partials, f"{self.state}/partials/part={part}", ["dt"])
        files = stay.unionByName(fresh.withColumn("part", F.lit(part)))
        files = Staged(files, "files")
        try:
            self._write_days(spark, files.df, days)
            self._known.publish(files.df)
        finally:
            files.drop()
        return days

    def _write_days(self, spark: SparkSession, files: DataFrame, days: list) -> None:
        mine = F.col("dt").isin(days)
        live = files.where(mine).select("dt", "part").distinct().collect()
        folders = [f"{self.state}/partials/part={row['part']}/dt={row['dt']}" for row in live]
        folders = [folder for folder in folders if path_exists(spark, folder)]  # none where no event has a group
        if folders:
            partials = spark.read.option("basePath", f"{self.state}/partials").parquet(*folders)
            fact = merge_partials(partials, self.key, self.biggest).select(*self.columns)
            write_parquet(fact, self.fact, ["dt"], overwrite="partitions")
        # Days without any row left, as their files or all groups are gone.
        left = {row["dt"] for row in live if f"{self.state}/partials/part={row['part']}/dt={row['dt']}" in folders}
        for day in set(days) - left:
            delete_path(spark, f"{self.fact}/dt={day}")


def incremental_region_fact(source: str, regions: DataFrame, state: str, fact: str) -> IncrementalFact:
    """The region daily fact, kept up to date. A change of ``regions`` needs a new ``state``."""
    boxes = regions.select("region_id", "lat_min", "lat_max", "lon_min", "lon_max")

    def prepare(events: DataFrame) -> DataFrame:
        return locate(events, boxes, "inner")

    return IncrementalFact(source, state, fact, prepare, "region_id", BIGGEST, tuple(REGION_FACT_COLUMNS))
