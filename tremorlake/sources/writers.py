"""Sinks: tables, Parquet and CSV directories, with an explicit overwrite scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tremorlake.operators.curve import clustered
from tremorlake.session import scratch_path

_OVERWRITE_MODE = "partitionOverwriteMode"
#: Deletes the shuffle files of a query when it ends; without it they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Few, evenly sized output files.

    The rebalance hint lets AQE merge small partitions and split an over-full one, so a day that
    holds a third of all rows is written by many tasks and a tiny result by one.
    """
    return df.hint("rebalance", *columns)


def write_table(
    df: DataFrame,
    table: str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
    overwrite: str = "full",
) -> None:
    """Overwrite a Parquet table, managed or at an explicit path.

    ``overwrite="full"`` leaves exactly the rows of ``df``. ``overwrite="partitions"`` replaces
    only the partitions that ``df`` contains and keeps the others, for both kinds of table.
    """
    if overwrite not in ("full", "partitions"):
        raise ValueError(f"unknown overwrite scope: {overwrite!r}")
    spark = df.sparkSession
    data = balanced(df, *partition_by)
    if overwrite == "partitions" and not partition_by:
        raise ValueError("overwriting partitions needs partition columns")
    # The scope is an option of this one write, never a setting of the session, which other threads
    # share. An insert into the table would ignore the option, so partitions go to its location.
    if overwrite == "partitions" and spark.catalog.tableExists(table):
        facts = spark.sql(f"describe extended {table}")
        location = facts.where("col_name = 'Location'").first()["data_type"]
        write_parquet(df.select(*spark.table(table).columns), location, partition_by, "partitions")
        spark.catalog.recoverPartitions(table)
        spark.catalog.refreshTable(table)
        return
    writer = data.write.mode("overwrite").format("parquet").option(_OVERWRITE_MODE, "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: str = "full"
) -> None:
    """Overwrite a Parquet directory, whole or only the partitions that ``df`` contains."""
    scope = {"full": "static", "partitions": "dynamic"}[overwrite]
    writer = balanced(df, *partition_by).write.mode("overwrite").option(_OVERWRITE_MODE, scope)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_clustered(df: DataFrame, path: str, rows_per_file: int = 1_000_000, day: str = "day") -> None:
    """Overwrite a Parquet directory with files that each hold few days and a small area.

    A filter on day and position is then answered from the footers for most files.
    """
    clustered(df, rows_per_file, day).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Overwrite a managed table, dealt into ``buckets`` by ``key`` and sorted by it.

    Two tables with the same key and number of buckets join without a shuffle. The rows are dealt before they
    are written, so that each bucket is one file.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV directory with a header line in every file."""
    balanced(df).write.mode("overwrite").option("header", True).csv(path)


class Scratch:
    """A new path below the shared scratch folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark = spark
        self.path = scratch_path(spark, label)

    def drop(self) -> None:
        jvm_path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self._spark._jsc.hadoopConfiguration()
        jvm_path.getFileSystem(conf).delete(jvm_path, True)


class Staged(Scratch):
    """A DataFrame written once to the shared scratch folder and read back.

    Later jobs start from those files: the lineage ends there, so a lost executor costs a re-read
    and not a recomputation from the sources. ``drop()`` deletes the files when they are used up.
    """

    def __init__(self, df: DataFrame, label: str, codec: str | None = None) -> None:
        super().__init__(df.sparkSession, label)
        conf = df.sparkSession.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")  # nothing reads the shuffles of a finished write
        try:
            df.write.parquet(self.path, compression=codec)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
