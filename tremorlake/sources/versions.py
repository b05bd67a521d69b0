"""Versioned tables: immutable folders, and an append-only log that says which of them count.

A log entry is a small Parquet file, added by Spark's committer in one step after the data it points to
is complete. A reader sees an entry whole or not at all, and a writer that dies leaves a folder that no
entry names. One writer at a time appends to a log.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tremorlake.sources.writers import write_parquet


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Names of files and folders that match a glob pattern."""
    system, where = _file_system(spark, pattern)
    return [status.getPath().toString() for status in system.globStatus(where) or []]


@dataclass(frozen=True)
class CommitLog:
    """Entries of one schema below ``path``."""

    path: str
    schema: str

    def append(self, spark: SparkSession, *values: object) -> None:
        spark.createDataFrame([values], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def entries(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)


@dataclass(frozen=True)
class Snapshots:
    """A table that is replaced as a whole, version by version; old versions stay readable.

    ``publish`` never touches files that a reader may hold, so a running query goes on with the version
    it has read and picks up the next one when it asks for the latest again.
    """

    path: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(f"{self.path}/log", "version bigint, name string")

    def _last(self, spark: SparkSession) -> Row | None:
        return self.log.entries(spark).orderBy(F.desc("version"), F.desc("name")).first()

    def publish(self, df: DataFrame) -> int:
        """Write ``df`` as the next version and return its number, counted from 1."""
        spark = df.sparkSession
        last = self._last(spark)
        version = 1 if last is None else last["version"] + 1
        name = f"{version}-{uuid.uuid4().hex}"
        write_parquet(df, f"{self.path}/data/{name}")
        self.log.append(spark, version, name)
        return version

    def version(self, spark: SparkSession) -> int | None:
        """Number of the latest version; None before the first."""
        last = self._last(spark)
        return None if last is None else last["version"]

    def latest(self, spark: SparkSession) -> tuple[int, DataFrame]:
        last = self._last(spark)
        if last is None:
            raise ValueError(f"nothing has been published below {self.path}")
        return last["version"], spark.read.parquet(f"{self.path}/data/{last['name']}")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Delete the folders of all but the last ``keep`` versions, and of publishes that never finished."""
        newest = self.log.entries(spark).orderBy(F.desc("version"), F.desc("name")).limit(keep)
        kept = {row["name"] for row in newest.collect()}
        for folder in matching_paths(spark, f"{self.path}/data/*"):
            if folder.rstrip("/").rsplit("/", 1)[-1] not in kept:
                delete_path(spark, folder)
