"""NULL-safe ratios and output rounding.

Sums stay DECIMAL; ratios are DOUBLE and rounded once, at the output. Spark's
``round`` is HALF_UP.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def one() -> Column:
    return F.lit(1)


def null() -> Column:
    return F.lit(None).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is zero."""
    return num / F.when(den != 0, den)


def growth_rate(now: Column, base: Column) -> Column:
    """Signed change against the size of the base, NULL where the base is zero."""
    return ratio(now - base, F.abs(base))


def positive_part(x: Column) -> Column:
    """max(x, 0) that keeps NULL as NULL (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def money(x: Column) -> Column:
    return F.round(x.cast("double"), 2)


def frac(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def change_pct(now: Column, before: Column) -> Column:
    """Percentage change to one decimal, NULL where there was nothing before."""
    return F.round(growth_rate(now.cast("double"), before.cast("double")) * 100, 1)


def inaction_cost(change: Column) -> Column:
    """Three months' share of an annualised fall; NULL when nothing fell."""
    return F.when(change < 0, F.abs(change) / 12 * 3)


def inaction_opportunity(change: Column) -> Column:
    """Six months at the fallen amount; zero when nothing fell."""
    return F.when(change < 0, F.abs(change) * 6).otherwise(F.lit(0.0))
