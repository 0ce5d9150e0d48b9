"""Small column functions that several operators and users need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A double, null where the text isn't a number or is NaN."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-9) -> Column:
    """Equal within a tolerance; nulls are equal to nulls only."""
    return F.when(a.isNull() | b.isNull(), a.eqNullSafe(b)).otherwise(F.abs(a - b) <= absolute + relative * F.abs(b))


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def between_bins(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of x, the top edge in the last one; null outside."""
    place = F.least(F.lit(bins - 1), F.floor((x - low) * bins / (high - low)))
    return F.when(x.between(low, high), place).cast("int")


def wording(rank: Column) -> Column:
    """What a percentile among controls says."""
    return F.when(rank >= 0.95, "above controls").when(rank <= 0.05, "below controls").otherwise("within controls")
