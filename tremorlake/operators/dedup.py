"""Exact and fuzzy de-duplication.

Both keep the first row per key under a total order. The rank-1 filter over ``row_number`` makes
Spark place a group limit before the shuffle, so each map task sends at most one row per key: a key
that holds a third of all rows arrives at its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.operators.normalize import SOURCE_PRIORITY

# Fixed values of the fuzzy match: one calendar minute, a tenth of a degree.
MINUTE_MS = 60_000
CELLS_PER_DEGREE = 10

_RANK = "_rank"


def _rank_one(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    ranking = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(ranking)).filter(F.col(_RANK) == 1).drop(_RANK)


def _tie_break(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """The remaining columns, so that the order is total up to identical rows."""
    return [F.desc(name) for name in df.columns if name not in used]


def _any_null(columns: Sequence[Column]) -> Column:
    return reduce(or_, (column.isNull() for column in columns))


def keep_first(
    df: DataFrame, keys: Sequence[Column], order: Sequence[Column], null_keys: str = "keep"
) -> DataFrame:
    """The first row per key.

    A NULL in a key says nothing about identity: ``null_keys="keep"`` passes such rows through,
    ``null_keys="collapse"`` treats NULL as a value, so that one row per NULL group remains.
    """
    if null_keys == "collapse":
        return _rank_one(df, keys, order)
    if null_keys != "keep":
        raise ValueError(f"unknown treatment of NULL keys: {null_keys!r}")
    unknown = _any_null(keys)
    return _rank_one(df.filter(~unknown), keys, order).unionByName(df.filter(unknown))


def latest_order(df: DataFrame, key: str = "id", time: str = "time_utc") -> list[Column]:
    return [F.desc(time), *_tie_break(df, (key, time))]


def dedup_latest(
    df: DataFrame, key: str = "id", time: str = "time_utc", null_keys: str = "keep"
) -> DataFrame:
    """Exact dedup: of the rows with one key, the one with the latest time."""
    return keep_first(df, [F.col(key)], latest_order(df, key, time), null_keys)


def fuzzy_keys() -> list[Column]:
    """Calendar minute and 0.1 degree cell; two rows match when all three are equal."""
    return [
        F.floor(F.col("time_utc") / MINUTE_MS),
        F.floor(F.col("latitude") * CELLS_PER_DEGREE),
        F.floor(F.col("longitude") * CELLS_PER_DEGREE),
    ]


def fuzzy_order(df: DataFrame, priority: Sequence[str] = SOURCE_PRIORITY) -> list[Column]:
    """Most trusted source, then largest magnitude; unlisted sources come last."""
    trust = F.array_position(F.array(*(F.lit(name) for name in priority)), F.col("source_system"))
    trust = F.when(trust > 0, trust).otherwise(len(priority) + 1)
    first = ("source_system", "magnitude", "id")
    return [F.asc(trust), *(F.desc(name) for name in first), *_tie_break(df, first)]


def dedup_fuzzy(
    df: DataFrame, priority: Sequence[str] = SOURCE_PRIORITY, null_keys: str = "keep"
) -> DataFrame:
    """Fuzzy dedup: of the rows in one minute and cell, the one from the most trusted source."""
    return keep_first(df, fuzzy_keys(), fuzzy_order(df, priority), null_keys)


def dedup_both(
    df: DataFrame, priority: Sequence[str] = SOURCE_PRIORITY, null_keys: str = "keep"
) -> DataFrame:
    """Exact, then fuzzy dedup.

    Same result as chaining the two operators, arranged so that the second does not read the first
    one's output twice. After the exact step an id names one row; a row that lacks time or position
    therefore goes through the fuzzy ranking in a group of its own, keyed by its id. Only rows
    without id and without bucket bypass it, and those come straight from the scan.
    """
    if null_keys == "collapse":
        return dedup_fuzzy(dedup_latest(df, null_keys="collapse"), priority, "collapse")
    if null_keys != "keep":
        raise ValueError(f"unknown treatment of NULL keys: {null_keys!r}")
    buckets = fuzzy_keys()
    no_bucket = _any_null(buckets)
    unnamed = df.filter(F.col("id").isNull())
    named = dedup_latest(df.filter(F.col("id").isNotNull()), null_keys="collapse")
    pool = named.unionByName(unnamed.filter(~no_bucket))
    alone = F.when(no_bucket, F.col("id"))
    kept = _rank_one(pool, [*buckets, alone], fuzzy_order(pool, priority))
    return kept.unionByName(unnamed.filter(no_bucket))
