"""Message bytes to typed event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.functions.times import event_day, event_timestamp
from tremorlake.schemas import MESSAGE_SCHEMA, STREAM_COLUMNS


def parse_json(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """One column per schema field; malformed text and unfit fields become NULL."""
    parsed = F.from_json(F.col(value).cast("string"), schema)
    return messages.select(parsed.alias("data")).select("data.*")


def parse_quakes(messages: DataFrame) -> DataFrame:
    """Event messages with a usable time and an id; anything else is dropped."""
    rows = parse_json(messages, MESSAGE_SCHEMA)
    timed = rows.withColumn("time_utc", event_timestamp(F.col("time_utc")))
    dated = timed.withColumn("day", event_day(F.col("time_utc")))
    return dated.filter(F.col("day").isNotNull() & F.col("id").isNotNull()).select(*STREAM_COLUMNS)
