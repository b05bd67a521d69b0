"""Time parsing and calendar expressions. None of them fails on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that holds an epoch in milliseconds (fixed value).
EPOCH_TEXT = r"^\d+$"

_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

#: The last epoch millisecond of a microsecond timestamp, which is a 64-bit integer.
_MAX_MILLIS = (2**63 - 1) // 1000


def event_timestamp(text: Column) -> Column:
    """Timestamp of a message time: all digits are epoch milliseconds, anything else is ISO text."""
    millis = text.try_cast("bigint")
    return F.when(
        text.rlike(EPOCH_TEXT),
        F.when(millis <= F.lit(_MAX_MILLIS), F.timestamp_millis(millis)),
    ).otherwise(F.try_to_timestamp(text))


def epoch_millis(value: Column, dtype: T.DataType) -> Column:
    """Epoch milliseconds of a feed time, whichever way the feed stores it.

    Timestamps convert directly, numbers are taken as milliseconds, text is read as digits first
    and as an ISO time second; what parses as neither is NULL.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(value)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_millis(value.cast("timestamp"))
    if isinstance(dtype, T.StringType):
        # The pattern in front saves a failing cast, which is slow, for every ISO text.
        return F.when(value.rlike(_INTEGER_TEXT), value.try_cast("bigint")).otherwise(
            F.unix_millis(F.try_to_timestamp(value))
        )
    return value.try_cast("bigint")


def event_day(timestamp: Column) -> Column:
    """Calendar day in the session time zone, which the engine pins to UTC."""
    return F.to_date(timestamp)


def today_text() -> Column:
    return F.current_date().cast("string")
