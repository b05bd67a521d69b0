"""How a result column is shown so that two SQL engines print the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> decimals
_ROUNDED = {"r6": 6, "r9": 9, "r10": 10}

#: Added before rounding in both engines. An average such as 1.00619296875 lies exactly between two
#: ten-digit values, and the order of a sum would decide which one is shown.
_OFF_TIE = 1.7e-12


def _spark(name: str, kind: str) -> Column:
    """NULL stays NULL; whole numbers and days get one width in both engines."""
    column = F.col(name)
    if kind == "day":
        column = column.cast("string")
    elif kind == "int":
        column = column.cast("bigint")
    elif kind in _ROUNDED:
        # The added zero turns a rounded -0.0 into 0.0.
        column = F.round(column + _OFF_TIE, _ROUNDED[kind]) + 0.0
    return column.alias(name)


def _sql(name: str, kind: str) -> str:
    if kind == "day":
        return f"cast({name} as varchar) as {name}"
    if kind == "int":
        return f"cast({name} as bigint) as {name}"
    if kind in _ROUNDED:
        return f"round({name} + {_OFF_TIE}, {_ROUNDED[kind]}) + cast(0 as double) as {name}"
    return name


def shown(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(_spark(name, kind) for name, kind in columns.items()))


def shown_sql(columns: dict[str, str], source: str) -> str:
    return f"select {', '.join(_sql(name, kind) for name, kind in columns.items())} from {source}"
