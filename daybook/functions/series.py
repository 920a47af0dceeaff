"""Statistics of one dense monthly series held as ``array<double>``.

A member's months fit in one row (the period axis has at most 600 entries), so
each statistic is a projection over the array: after the one roll-up that builds
the series there is no further shuffle, sort or window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def s() -> Column:
    """The series column of a member frame."""
    return F.col("s")


def dense(by_idx: Column, n: int) -> Column:
    """Zero-filled array of length n from a map<int, double>."""
    if n <= 0:
        return F.array().cast("array<double>")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.coalesce(F.element_at(by_idx, i), F.lit(0.0)),
    )


def at(s: Column, i: int | Column) -> Column:
    return F.get(s, F.lit(i) if isinstance(i, int) else i)


def last(s: Column, back: int = 0) -> Column:
    """The element ``back`` places before the end; NULL if the series is shorter."""
    return F.get(s, F.size(s) - 1 - back)


def total(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def mean(s: Column) -> Column:
    return total(s) / F.when(F.size(s) > 0, F.size(s))


def stddev(s: Column, avg: Column) -> Column:
    """Sample standard deviation (n - 1); NULL below two points."""
    squares = F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg))
    return F.sqrt(squares / F.when(F.size(s) > 1, F.size(s) - 1))


def slope(s: Column, n: int) -> Column:
    """Least-squares slope over x = 1..n."""
    if n < 2:
        return F.lit(None).cast("double")
    sum_x = n * (n + 1) / 2
    spread = n * n * (n * n - 1) / 12
    sum_xy = F.aggregate(F.transform(s, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.round((F.lit(float(n)) * sum_xy - F.lit(float(sum_x)) * total(s)) / F.lit(float(spread)), 6)


def steps(s: Column) -> Column:
    """Month-on-month differences, one shorter than the series."""
    n = F.size(s)
    return F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: b - a)


def _longest_run(s: Column, holds) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def advance(acc, d):
        run = F.when(holds(d), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(steps(s), start, advance)


def decline_streak(s: Column) -> Column:
    """Struct (run = still open at the end, best = longest) of strict falls."""
    return _longest_run(s, lambda d: d < 0)


def growth_streak(s: Column) -> Column:
    return _longest_run(s, lambda d: d > 0)


def decline_run_by_index(s: Column) -> Column:
    """Array of the running fall length at every period (0 at the first)."""
    return F.aggregate(
        steps(s),
        F.array(F.lit(0)),
        lambda acc, d: F.concat(
            acc, F.array(F.when(d < 0, F.element_at(acc, -1) + 1).otherwise(F.lit(0)))
        ),
    )


def window_mean(s: Column, width: int, back: int = 0) -> Column:
    """Mean of ``width`` periods ending ``back`` periods before the end; NULL if too short."""
    part = F.slice(s, F.greatest(F.size(s) - back - width + 1, F.lit(1)), F.lit(width))
    return F.when(F.size(s) >= width + back, total(part) / width)


def peak(s: Column) -> Column:
    return F.array_max(s)


def trough(s: Column) -> Column:
    return F.array_min(s)


def first_index_of(s: Column, value: Column) -> Column:
    """Zero-based earliest position of a value."""
    return (F.array_position(s, value) - 1).cast("int")


def hhi(s: Column) -> Column:
    """Sum of squared shares; NULL when the total is zero."""
    whole = total(s)
    squares = F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x)
    return squares / F.when(whole != 0, whole * whole)


def competition_ranks(s: Column) -> Column:
    """1224 ranking of every element, largest first."""
    return F.transform(s, lambda v: F.size(F.filter(s, lambda x: x > v)) + 1)
