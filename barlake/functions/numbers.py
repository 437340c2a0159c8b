"""Null, NaN and zero handling shared by the signal operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(value: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(value, F.lit(None).cast("double"))


def or_zero(value: Column) -> Column:
    """A missing value counts as 0."""
    return F.coalesce(number(value), F.lit(0.0))


def first_nonzero(*values: Column) -> Column:
    """First value that is neither missing nor 0, else 0."""
    return F.coalesce(*[F.nullif(number(v), F.lit(0.0)) for v in values], F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """Bounds a value; missing stays missing (``greatest``/``least`` alone would skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when the whole is 0 or missing."""
    return F.try_divide(part, whole) * F.lit(100.0)
