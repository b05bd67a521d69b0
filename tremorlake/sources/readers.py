"""Scans. All are lazy except schema inference and partition recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tremorlake.schemas import REGION_SCHEMA, SERVING_COLUMNS


def scan_feed(spark: SparkSession, path: str, partitions: Sequence[str] = ()) -> DataFrame:
    """A raw feed directory with its ``dt`` partition column.

    ``partitions`` (for example ``["dt=2024-01-01"]``) narrows the scan to some sub-directories; the
    base path keeps ``dt`` in the result in both cases.
    """
    root = path.rstrip("/")
    paths = [f"{root}/{part}" for part in partitions] or [root]
    return spark.read.option("basePath", root).parquet(*paths)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def register_partitions(spark: SparkSession, *tables: str) -> None:
    """Add directories that appeared below partitioned tables to the catalog."""
    for table in tables:
        spark.catalog.recoverPartitions(table)


def read_regions(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Region boxes from CSV with a header; the explicit schema saves the inference pass."""
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if infer else reader.schema(REGION_SCHEMA)
    return reader.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def small_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A DataFrame of per-model results (one row per trial or per centre), never of event data."""
    return spark.createDataFrame(list(rows), schema)


def read_serving(
    spark: SparkSession,
    table: str | None = None,
    format: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The serving projection of enriched events from a catalog table or any connector."""
    if table is not None:
        events = spark.table(table)
    else:
        events = spark.read.format(format or "parquet").options(**(options or {})).load()
    return events.select(*SERVING_COLUMNS)
