"""Arithmetic that treats missing values and zero as the analysis needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def midpoint(low: Column, high: Column) -> Column:
    """The middle of both bounds, or the one that is there."""
    low, high = low.cast("double"), high.cast("double")
    return F.coalesce((low + high) / 2, low, high)


def safe_ratio(part: Column, whole: Column, default: float = 0.5) -> Column:
    return F.when(whole == 0, F.lit(default)).otherwise(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)))


def relative_error(actual: Column, predicted: Column) -> Column:
    """|actual - predicted| / |actual|, null where actual is 0."""
    return F.abs((actual - predicted) / F.nullif(actual.cast("double"), F.lit(0.0)))


def right_closed_bin(value: Column, width: float) -> Column:
    """Number of the bin (0, width] = 1, (width, 2 width] = 2, ..."""
    return F.ceil(value / width).cast("int")
