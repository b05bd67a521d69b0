"""Measured size checks in front of every broadcast."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Size(NamedTuple):
    rows: int
    bytes: int


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: its text lengths and eight bytes for every other column."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif not isinstance(df.schema[name].dataType, T.AtomicType):
            size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return size


def measure(df: DataFrame, *extra: Column) -> tuple[Size, tuple]:
    """Size of a dimension and any ``extra`` aggregates: one pass, one row to the driver."""
    total = F.coalesce(F.sum(row_bytes(df)), F.lit(0))
    rows, size, *values = df.agg(F.count("*"), total, *extra).first()
    return Size(rows, size), tuple(values)


def broadcast_when_small(
    df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 128 << 20
) -> DataFrame:
    """``df`` with a broadcast hint if it measures small; otherwise unchanged.

    Without the hint an equi join shuffles both sides, and AQE splits skewed partitions.
    """
    size, _ = measure(df)
    if size.rows <= max_rows and size.bytes <= max_bytes:
        return F.broadcast(df)
    return df
