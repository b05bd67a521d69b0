"""Sorted candidate lists: the first that holds, and bounded pieces of lists brought together again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates in one row of a shuffled table, so that no row grows with the dimension.
PIECE = 64

#: Candidates tested in generated code before the rest of a list.
_HEAD = 8


def first_hit(candidates: Column, holds: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """``value`` of the first candidate that holds; NULL if none does.

    The head of the list is tested in generated code, which stops at the first hit. A higher-order
    filter, about three times slower, sees only the rest of a longer list without a hit so far.
    """
    beyond = F.size(candidates) - _HEAD
    tail = F.slice(candidates, _HEAD + 1, F.greatest(beyond, F.lit(0)))
    first, *others = (F.get(candidates, F.lit(i)) for i in range(_HEAD))
    hit = F.when(holds(first), value(first))
    for candidate in others:
        hit = hit.when(holds(candidate), value(candidate))
    return hit.when(beyond > 0, value(F.get(F.filter(tail, holds), F.lit(0))))


def first_per_row(rows: DataFrame, pieces: DataFrame, keys: Sequence[str], row: str, kept: Sequence[str], hit: Column) -> DataFrame:
    """``kept`` columns of every row with ``_hit``, the least ``hit`` over all pieces that share its keys.

    One join. The rows of a key are where the join has put them, so the aggregate by (keys, row) needs no
    shuffle of its own. ``row`` tells rows of one key apart.
    """
    pieces = shuffled(pieces)
    carried = rows.select(*keys, row, F.struct(*kept).alias("_kept"), *(c for c in rows.columns if c not in (*keys, row, *kept)))
    met = carried.join(pieces, list(keys), "left").withColumn("_hit", hit)
    first = met.groupBy(*keys, row).agg(F.first("_kept").alias("_kept"), F.min("_hit").alias("_hit"))
    return first.select("_kept.*", "_hit")


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` with the hint that a join shuffles it, whatever size Spark expects of it.

    Spark's estimate knows nothing of rows that an explode adds, so it would broadcast lists of any length.
    """
    return table.hint("shuffle_merge")


def salt_of(salts: Column, *values: Column) -> Column:
    """A number below ``salts``, the same in a retried task; identical rows of two partitions differ."""
    return F.pmod(F.xxhash64(F.spark_partition_id(), *values), salts).cast("int")
