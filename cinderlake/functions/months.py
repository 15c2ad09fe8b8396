"""Expressions over arrays of twelve monthly numbers: one row per key, no shuffle after the sums.

Ties go to the first month; a series that sums to 0 has null measures and keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = tuple(range(1, 13))
INITIALS = "JFMAMJJASOND"


def month_sums(month: str, value: str) -> Column:
    """Aggregate: the sums of value for months 1 to 12, 0 where there is none."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col(month) == m, F.col(value))), F.lit(0)) for m in MONTHS])


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda a, x: a + x)


def wrap(month: Column) -> Column:
    """One step around the year: over 12 goes 12 down, under 1 goes 12 up; fractions stay."""
    return F.when(month > 12, month - 12).when(month < 1, month + 12).otherwise(month)


def first_of(series: Column, value: Column) -> Column:
    return F.array_position(series, value).cast("int")


def peak_month(series: Column) -> Column:
    return F.when(total(series) > 0, first_of(series, F.array_max(series)))


def relabelled(series: Column, peak: Column) -> Column:
    """The series with its peak moved to place 6."""
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda r: F.element_at(series, wrap(r - 6 + peak).cast("int")))


def original(place: Column, peak: Column) -> Column:
    return wrap(place - (6 - peak))


def running(series: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.aggregate(F.slice(series, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))


def cumulative_share(series: Column, scale: float = 100.0) -> Column:
    return F.transform(running(series), lambda x: F.lit(scale) * x / total(series))


def nearest(shares: Column, target: float) -> Column:
    """The first place whose share is nearest to target."""
    gaps = F.transform(shares, lambda x: F.abs(x - F.lit(float(target))))
    return first_of(gaps, F.array_min(gaps))


def inverse_ecdf(ecdf: Column, target: float) -> Column:
    """The place where a growing ecdf reaches target, linear between places; the last place of a plateau at it.

    Targets below the first value are raised to it.
    """
    q = F.greatest(F.lit(float(target)), F.element_at(ecdf, 1))
    below = F.size(F.filter(ecdf, lambda x: x <= q))
    lo, hi = F.element_at(ecdf, below), F.element_at(ecdf, F.least(below + 1, F.size(ecdf)))
    return F.when(below >= F.size(ecdf), F.size(ecdf).cast("double")).otherwise(below + (q - lo) / (hi - lo))


def ranked_length(series: Column, percent: float = 80.0, slack: float = 2.0) -> Column:
    """Months, largest first, that come nearest to percent; one fewer (at least 1) if they overshoot by more than slack."""
    shares = cumulative_share(F.sort_array(series, asc=False))
    k = nearest(shares, percent)
    return F.when(F.element_at(shares, k) - percent > slack, F.greatest(k - 1, F.lit(1))).otherwise(k)


def resultant(series: Column) -> tuple[Column, Column]:
    """Sums of the months' vectors at 15, 45, ... 345 degrees."""
    place = F.sequence(F.lit(1), F.lit(12))
    angle = lambda m: F.radians(m * 30.0 - 15.0)
    x = F.aggregate(F.zip_with(series, place, lambda v, m: v * F.cos(angle(m))), F.lit(0.0), lambda a, b: a + b)
    y = F.aggregate(F.zip_with(series, place, lambda v, m: v * F.sin(angle(m))), F.lit(0.0), lambda a, b: a + b)
    return x, y


def concentration(series: Column) -> Column:
    x, y = resultant(series)
    return F.when(total(series) > 0, 100.0 * F.sqrt(x * x + y * y) / total(series))


def concentration_peak(series: Column) -> Column:
    x, y = resultant(series)
    degrees = F.degrees(F.atan2(y, x))
    turned = F.when(degrees < 0, degrees + 360.0).otherwise(degrees)
    gaps = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.round(F.abs(m * 30.0 - 15.0 - turned), 9))
    return F.when(total(series) > 0, first_of(gaps, F.array_min(gaps)))


def season_code(first: Column, last: Column) -> Column:
    """Month initials from first to last, around the year."""
    doubled = F.lit(INITIALS * 2)
    return F.substring(doubled, first.cast("int"), (F.pmod(last - first, F.lit(12)) + 1).cast("int"))
