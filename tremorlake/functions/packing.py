"""One 64-bit key for a (day, integer) pair.

An arg-max over strings makes Spark aggregate by sorting. A sort on a single fixed-width key runs
as a radix sort, a sort on two keys compares rows; packing the pair keeps the cheap path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 33
_LOW_NULL = 1 << 32
_LOW_SHIFT = 1 << 31
_LOW_MASK = (1 << _LOW_BITS) - 1
_DAY_SHIFT = 1 << 29
_DAY_NULL = (1 << 30) - 1


def pack_day_key(day: Column, key: Column) -> Column:
    """Reversible bigint of a DATE and an INT column; NULLs have codes of their own."""
    high = F.coalesce(F.unix_date(day).cast("bigint") + _DAY_SHIFT, F.lit(_DAY_NULL).cast("bigint"))
    low = F.coalesce(key.cast("bigint") + _LOW_SHIFT, F.lit(_LOW_NULL).cast("bigint"))
    return F.shiftleft(high, _LOW_BITS).bitwiseOR(low)


def packed_day(packed: Column) -> Column:
    high = F.shiftright(packed, _LOW_BITS)
    return F.when(high != _DAY_NULL, F.date_from_unix_date((high - _DAY_SHIFT).cast("int")))


def packed_key(packed: Column) -> Column:
    low = packed.bitwiseAND(F.lit(_LOW_MASK).cast("bigint"))
    return F.when(low != _LOW_NULL, (low - _LOW_SHIFT).cast("int"))
