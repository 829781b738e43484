"""Small numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column, places: int = 0) -> Column:
    """Round half to even at ``places`` decimals, and never return ``-0.0``."""
    unit = float(10**places)
    return F.rint(col * unit) / unit + 0.0


def clip(col: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    # greatest and least skip nulls, so a missing value must be kept missing here.
    return F.when(col.isNotNull(), F.least(F.greatest(col, low), high))


def is_finite(*cols: Column) -> Column:
    """True when every value is present, not NaN and not infinite."""
    flag = F.lit(True)
    for col in cols:
        flag = flag & col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))
    return flag


def norm(*cols: Column) -> Column:
    return F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))


def fixed(col: Column, places: int) -> Column:
    """Text with exactly ``places`` decimals, rounded half to even."""
    value = half_even(col, places)
    return F.coalesce(value.try_cast(f"decimal(18,{places})").cast("string"), value.cast("string"))


def truncate(col: Column) -> Column:
    """Drop the fraction, toward zero."""
    return col.cast("long")


def settled(col: Column, places: int) -> Column:
    """``half_even`` of an aggregate: summation noise below 1e-9 is dropped first.

    Partial sums meet in any order on a cluster, so the last bits of a mean differ
    between runs; without this a value on a rounding edge would flip.
    """
    return half_even(half_even(col, 9), places)
