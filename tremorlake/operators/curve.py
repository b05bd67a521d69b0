"""A space-filling curve over day and position, for files whose footers prune by all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.lists import salt_of

#: Bits of each axis: a day of the range, 180 / 1024 and 360 / 1024 degrees.
BITS = 10

#: Slices that rows of one place on the curve can be dealt to.
_SLICES = 1024


def _spread(value: Column) -> Column:
    """Ten bits with two empty ones after each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two ends, in ``2 ** BITS`` steps; NULL and NaN lie at the low end."""
    share = F.try_divide(F.nanvl(value, low) - low, high - low)
    steps = F.floor(F.coalesce(share, F.lit(0.0)) * (1 << BITS))
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), steps)).cast("bigint")


def curve(day: Column, latitude: Column, longitude: Column, first_day: int, last_day: int) -> Column:
    """Place on the Z-order curve: the bits of the three axes in turn, so near rows mostly have near places."""
    days = F.unix_date(day).cast("double")
    axes = (
        _scaled(days, F.lit(float(first_day)), F.lit(float(max(last_day, first_day) + 1))),
        _scaled(latitude.cast("double"), F.lit(-90.0), F.lit(90.0)),
        _scaled(longitude.cast("double"), F.lit(-180.0), F.lit(180.0)),
    )
    parts = [F.shiftleft(_spread(axis), at) for at, axis in enumerate(axes)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def clustered(df: DataFrame, rows_per_file: int, day: str = "day") -> DataFrame:
    """``df`` dealt by range along the curve and sorted, about ``rows_per_file`` rows to a partition.

    Two small passes before: the number of rows and the ends of the days, and Spark's sample for the ranges.
    Rows of one place spread over several partitions by salt.
    """
    ends = F.unix_date(F.min(day)), F.unix_date(F.max(day))
    rows, first, last = df.agg(F.count("*"), *(F.coalesce(e, F.lit(0)) for e in ends)).first()
    place = curve(F.col(day), F.col("latitude"), F.col("longitude"), first, last)
    placed = df.withColumn("_place", place).withColumn("_slice", salt_of(F.lit(_SLICES), "latitude", "longitude", day))
    files = max(1, -(-rows // rows_per_file))
    dealt = placed.repartitionByRange(files, "_place", "_slice").sortWithinPartitions("_place", "_slice")
    return dealt.drop("_place", "_slice")
