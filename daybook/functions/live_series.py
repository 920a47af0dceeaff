"""Statistics of one monthly series that holds only its live months.

A series is ``struct<n: int, i: array<int>, v: array<double>>``: the length of the axis, the months that have a value other
than zero in ascending order, and their values. No number of months bounds the axis; a book with one row dated 1900 has a
longer ``n``, not longer series. Every statistic folds over the live months and takes the zero months between them by
arithmetic: they are runs that break, a count in a variance, a candidate for peak and trough.

``values``, ``long``, ``ranked_months`` and ``decline_run_by_index`` give one entry for each month, for results that have a
row for each month; they sort, so they take n log n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halving steps of a search, largest first: a DATE has fewer months than the first two steps.
STEPS = [1 << k for k in range(16, -1, -1)]


def s() -> Column:
    """The series column of a member frame."""
    return F.col("s")


def series(entries: Column, n: int) -> Column:
    """A series over ``n`` months from an array of struct (idx, v), one entry for a month at most, in any order."""
    live = F.array_sort(F.filter(entries, lambda e: e["v"] != 0))
    return F.struct(F.lit(n).alias("n"), F.transform(live, lambda e: e["idx"]).alias("i"), F.transform(live, lambda e: e["v"]).alias("v"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although lambdas inside read it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _months(s: Column) -> Column:
    return F.when(s["n"] > 0, F.sequence(F.lit(0), s["n"] - 1)).otherwise(F.array().cast("array<int>"))


def empty_months(s: Column) -> Column:
    return s["n"] - F.size(s["v"])


def at(s: Column, i: int | Column) -> Column:
    """The value of month i: zero where it is not live, NULL off the axis."""
    i = F.lit(i) if isinstance(i, int) else i
    found = F.get(s["v"], (F.array_position(s["i"], i.cast("int")) - 1).cast("int"))
    return F.when((i >= 0) & (i < s["n"]), F.coalesce(found, F.lit(0.0)))


def last(s: Column, back: int = 0) -> Column:
    """The value ``back`` months before the end; NULL if the series is shorter."""
    return at(s, s["n"] - 1 - back)


def total(s: Column) -> Column:
    return F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + x)


def part(s: Column, start: int | Column, stop: int | Column) -> Column:
    """Sum of the months from ``start`` up to, not with, ``stop``."""
    inside = F.zip_with(s["i"], s["v"], lambda i, x: F.when((i >= start) & (i < stop), x).otherwise(F.lit(0.0)))
    return F.aggregate(inside, F.lit(0.0), lambda a, x: a + x)


def sum_over_months(s: Column, of) -> Column:
    """Sum of ``of(value)`` over all months, the empty ones at once."""
    return F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + of(x)) + empty_months(s) * of(F.lit(0.0))


def stddev(s: Column, avg: Column) -> Column:
    """Sample standard deviation (n - 1); NULL below two months."""
    return F.sqrt(sum_over_months(s, lambda x: (x - avg) * (x - avg)) / F.when(s["n"] > 1, s["n"] - 1))


def slope(s: Column, n: int) -> Column:
    """Least-squares slope over x = 1..n."""
    if n < 2:
        return F.lit(None).cast("double")
    sum_x = n * (n + 1) / 2
    spread = n * n * (n * n - 1) / 12
    sum_xy = F.aggregate(F.zip_with(s["i"], s["v"], lambda i, x: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.round((F.lit(float(n)) * sum_xy - F.lit(float(sum_x)) * total(s)) / F.lit(float(spread)), 6)


def moves(s: Column) -> Column:
    """Array of struct (idx, d): every month-on-month change other than zero, in order of months; two for a live month at most."""
    def around(i: Column, k: Column) -> Column:
        v = F.get(s["v"], k)
        before = F.when(F.get(s["i"], k - 1) == i - 1, F.get(s["v"], k - 1)).otherwise(F.lit(0.0))
        into = F.when(i > 0, F.struct(i.alias("idx"), (v - before).alias("d")))
        follows = F.coalesce(F.get(s["i"], k + 1) == i + 1, F.lit(False))
        out = F.when((i + 1 < s["n"]) & ~follows, F.struct((i + 1).alias("idx"), (-v).alias("d")))
        return F.array(into, out)

    return F.filter(F.flatten(F.transform(s["i"], around)), lambda m: m["d"] != 0)


def _longest_run(s: Column, holds) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(-1).alias("idx"))

    def advance(acc, m):
        on = F.when(m["idx"] == acc["idx"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        run = F.when(holds(m["d"]), on).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"), m["idx"].alias("idx"))

    # A run is open only if it reaches the last month; a month without change after it has ended it.
    finish = lambda acc: F.struct(F.when(acc["idx"] == s["n"] - 1, acc["run"]).otherwise(F.lit(0)).alias("run"), acc["best"].alias("best"))
    return F.aggregate(moves(s), start, advance, finish)


def decline_streak(s: Column) -> Column:
    """Struct (run = still open at the end, best = longest) of strict falls in consecutive months."""
    return _longest_run(s, lambda d: d < 0)


def growth_streak(s: Column) -> Column:
    return _longest_run(s, lambda d: d > 0)


def decline_run_by_index(s: Column) -> Column:
    """Array of the running fall length at every month (0 at the first).

    Of the t months before a fall at t, k are falls, so entry t - k - 1 of the others is the last month that did not fall.
    """
    entry = lambda t, run: F.struct(t.alias("idx"), run.alias("run"))
    falls = F.transform(F.filter(moves(s), lambda m: m["d"] < 0), lambda m: m["idx"])

    def runs(f: Column) -> Column:
        return _bound(F.array_except(_months(s), f), lambda steady: F.concat(
            F.transform(steady, lambda t: entry(t, F.lit(0))), F.transform(f, lambda t, k: entry(t, t - F.get(steady, t - k - 1)))))

    return F.transform(F.array_sort(_bound(falls, runs)), lambda e: e["run"])


def window_mean(s: Column, width: int, back: int = 0) -> Column:
    """Mean of ``width`` months ending ``back`` months before the end; NULL if too short."""
    stop = s["n"] - back
    return F.when(s["n"] >= width + back, part(s, stop - width, stop) / width)


def peak(s: Column) -> Column:
    high = F.array_max(s["v"])
    return F.when(empty_months(s) > 0, F.greatest(high, F.lit(0.0))).otherwise(high)


def trough(s: Column) -> Column:
    low = F.array_min(s["v"])
    return F.when(empty_months(s) > 0, F.least(low, F.lit(0.0))).otherwise(low)


def first_index_of(s: Column, value: Column) -> Column:
    """Earliest month of a value; zero is found where the live months leave their first gap."""
    gap = F.array_position(F.transform(s["i"], lambda i, k: i == k), F.lit(False))
    first_empty = F.when(empty_months(s) > 0, F.when(gap > 0, gap - 1).otherwise(F.size(s["i"])))
    live = F.get(s["i"], (F.array_position(s["v"], value) - 1).cast("int"))
    return F.when(value == 0, first_empty).otherwise(live).cast("int")


def hhi(s: Column) -> Column:
    """Sum of squared shares; NULL when the total is zero."""
    whole = total(s)
    squares = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + x * x)
    return squares / F.when(whole != 0, whole * whole)


def values(s: Column) -> Column:
    """Every month's value in order."""
    entry = lambda t, x: F.struct(t.alias("idx"), x.alias("v"))
    gaps = F.transform(F.array_except(_months(s), s["i"]), lambda t: entry(t, F.lit(0.0)))
    filled = F.transform(F.array_sort(F.concat(gaps, F.zip_with(s["i"], s["v"], entry))), lambda e: e["v"])
    return F.when(empty_months(s) > 0, filled).otherwise(s["v"])


def long(s: Column) -> Column:
    """Array of struct (idx, value, prev), one for each month; prev is NULL at the first."""
    whole = values(s)
    prev = F.concat(F.array(F.lit(None).cast("double")), whole)
    rows = F.zip_with(whole, F.slice(prev, F.lit(1), F.greatest(s["n"], F.lit(0))), lambda x, p: F.struct(x.alias("value"), p.alias("prev")))
    return F.transform(rows, lambda r, t: F.struct(t.alias("idx"), r["value"].alias("value"), r["prev"].alias("prev")))


def sums_of(s: Column, width: int) -> Column:
    """Sums of consecutive groups of ``width`` months from the first on; the last may be shorter."""
    chunks = F.floor((s["n"] + width - 1) / width).cast("int")
    get = lambda x, t: F.coalesce(F.get(x, t), F.lit(0.0))
    of = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(chunks - 1, F.lit(0))), lambda q: sum((get(x, q * width + k) for k in range(1, width)), get(x, q * width)))
    return _bound(values(s), of)


def ranked_months(s: Column) -> Column:
    """Array of struct (idx, value, rank): 1224 ranking of every month, largest first, by bisection of the sorted live values."""
    def rows(ordered: Column) -> Column:
        upto = lambda x: F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda p, k: F.when(F.get(ordered, p + k - 1) <= x, p + k).otherwise(p))
        rank = lambda x: F.size(ordered) - upto(x) + 1 + F.when(x < 0, empty_months(s)).otherwise(F.lit(0))
        entry = lambda t, x, r: F.struct(t.alias("idx"), x.alias("value"), r.alias("rank"))
        live = F.zip_with(s["i"], s["v"], lambda t, x: entry(t, x, rank(x)))
        return _bound(rank(F.lit(0.0)), lambda r: F.concat(live, F.transform(F.array_except(_months(s), s["i"]), lambda t: entry(t, F.lit(0.0), r))))

    return F.array_sort(_bound(F.sort_array(s["v"]), rows))
