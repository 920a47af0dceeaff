"""The monthly cube: one small cuboid, a period axis without gaps or end, and member series of live months.

Facts are rolled up once to (city, grp, month); everything the analyses read is a
further roll-up of that table. Item, customer and salesman totals have their own
cuboids, because one wide cuboid over all six dimensions would not shrink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal
from threading import RLock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions import series as dense
from ..functions.numeric import frac, inaction_cost, inaction_opportunity, ratio
from ..session import written_down
from .ranking import ranked

SYNTHETIC_YEAR = 1900
UNCATEGORISED, UNATTRIBUTED = "Uncategorised", "Unattributed"


@dataclass(frozen=True)
class Axis:
    key: str
    cols: tuple[str, ...]
    noun: str
    label: str


CITY = Axis("city", ("city",), "cities", "City")
GROUP = Axis("group", ("grp",), "products", "SubCategory")
PERIOD = Axis("period", ("idx",), "months", "Month")
COMBO = Axis("combo", ("grp", "city"), "combinations", "SubCategory x City")
SALESMAN = Axis("salesman", ("salesman",), "sales managers", "Sales Manager")
CUSTOMER = Axis("customer", ("customer",), "customers", "Customer")
ITEM = Axis("item", ("item",), "items", "Item")
COMPANY = Axis("company", (), "company", "Company")
AXES = {a.key: a for a in (CITY, GROUP, PERIOD, COMBO, SALESMAN, CUSTOMER, ITEM)}


def label_or(col: Column, fallback: str) -> Column:
    text = F.trim(col)
    return F.when(F.length(text) > 0, text).otherwise(F.lit(fallback))


def modal_year(facts: DataFrame) -> DataFrame:
    """One row: the year most dated rows fall in; the smallest year on a tie."""
    return (
        facts.filter(F.col("voucher_date").isNotNull())
        .groupBy(F.year("voucher_date").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max_by(F.col("y"), F.struct(F.col("n"), -F.col("y"))).alias("modal_year"))
    )


MONTH_NAMES = ("january february march april may june july august september october november december").split()


def month_number(month: Column, month_num: Column) -> Column:
    """Month number from a number 1..12, else from a full or abbreviated month name."""
    name = F.lower(F.trim(month))
    by_name = F.lit(None).cast("int")
    for i, m in enumerate(MONTH_NAMES, 1):
        by_name = F.when(F.substring(name, 1, 3) == m[:3], F.lit(i)).otherwise(by_name)
    return F.when(month_num.between(1, 12), month_num.cast("int")).otherwise(by_name)


def resolve_period(facts: DataFrame) -> DataFrame:
    """Add ``month`` (first day) and ``period_fallback``.

    Dated rows use their date. Undated rows that name a month take the modal year
    of the dated rows (1900 when nothing is dated); rows with neither get NULL.
    """
    has_names = {"month_name", "month_num"} & set(facts.columns)
    dated = F.trunc(F.col("voucher_date"), "MM")
    if not has_names:
        return facts.withColumn("month", dated).withColumn("period_fallback", F.lit(False))
    name = F.col("month_name") if "month_name" in facts.columns else F.lit(None).cast("string")
    num = F.col("month_num") if "month_num" in facts.columns else F.lit(None).cast("int")
    number = month_number(name, num)
    year = F.coalesce(modal_year(facts).scalar(), F.lit(SYNTHETIC_YEAR))
    return facts.withColumn("month", F.coalesce(dated, F.make_date(year, number, F.lit(1)))).withColumn(
        "period_fallback", F.col("voucher_date").isNull() & number.isNotNull()
    )


def signed_amount(measure: str = "amount", net_returns: bool = True) -> Column:
    """Magnitude signed by the voucher class (returns negative), or its absolute value."""
    value = F.col(measure)
    return F.when(F.col("is_return"), -value).otherwise(value) if net_returns else F.abs(value)


def month_index(month: Column, start: date) -> Column:
    return ((F.year(month) - start.year) * 12 + F.month(month) - start.month).cast("int")


def period_label(idx: Column, start: date) -> Column:
    return F.date_format(F.add_months(F.lit(start), idx.cast("int")), "MMM-yy")


def period_key(idx: Column, start: date) -> Column:
    return F.date_format(F.add_months(F.lit(start), idx.cast("int")), "yyyy-MM")


@dataclass
class Cube:
    """Cuboid plus its period axis. ``cells``: city, grp, idx, amount (decimal)."""

    facts: DataFrame
    cells: DataFrame
    start: date | None
    n: int
    period_totals: list[Decimal]
    net_returns: bool = True
    measure: str = "amount"
    _frames: dict[str, DataFrame] = field(default_factory=dict)
    _lock: RLock = field(default_factory=RLock, repr=False, compare=False)

    @property
    def total(self) -> float:
        return float(sum(self.period_totals, Decimal(0)))

    @property
    def empty(self) -> bool:
        return sum(self.period_totals, Decimal(0)) == 0

    def label(self, idx: Column) -> Column:
        return period_label(idx, self.start)

    def label_at(self, i: int) -> str:
        months = self.start.year * 12 + self.start.month - 1 + (i % self.n)
        return date(months // 12, months % 12 + 1, 1).strftime("%b-%y")

    def source(self, axis: Axis) -> DataFrame:
        """Cells at the grain an axis needs (idx, amount and the axis columns)."""
        if set(axis.cols) <= {"city", "grp", "idx"}:
            return self.cells
        if axis.key not in self._frames:
            self._frames[axis.key] = roll_up(self.facts, axis.cols, self.measure, self.net_returns).select(
                *axis.cols, month_index(F.col("month"), self.start).alias("idx"), "amount"
            ).filter(F.col("idx").between(0, self.n - 1))
        return self._frames[axis.key]

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A roll-up of the cuboid that many analyses read, written down once.

        A cached frame keeps every shuffle partition and its whole lineage: each analysis would run that many tasks on a few
        rows, and each task would answer the driver with the counters of the fact plan.
        """
        with self._lock:
            if name not in self._frames:
                self._frames[name] = written_down(make(), name.replace(":", "-"))
            return self._frames[name]

    def all_members(self, axis: Axis) -> DataFrame:
        """member, axis columns, total, s (series of live months); zero totals included."""
        name = f"series:{axis.key}"
        if set(axis.cols) <= {"city", "grp", "idx"}:
            return self.kept(name, lambda: live_members(self.cells, axis, self.n))
        if name not in self._frames:
            self._frames[name] = live_members(self.source(axis), axis, self.n).persist()
        return self._frames[name]

    def members(self, axis: Axis) -> DataFrame:
        return self.all_members(axis).filter(F.col("total") != 0)

    def member_count(self, axis: Axis) -> int:
        name = f"count:{axis.key}"
        if name not in self._frames:
            self._frames[name] = self.members(axis).count()
        return self._frames[name]

    def company(self) -> DataFrame:
        """One row: total and the company series."""
        return self.all_members(COMPANY)

    def months(self) -> DataFrame:
        """One row per period: idx, key, label, revenue, prev (NULL first) and the series."""
        start = self.start or date(SYNTHETIC_YEAR, 1, 1)
        return self.company().select("s", F.inline(S.long(F.col("s")))).select(
            "idx",
            period_key(F.col("idx"), start).alias("period"),
            period_label(F.col("idx"), start).alias("month"),
            F.col("value").alias("revenue"),
            "prev",
            "s",
        )

    def combos(self) -> DataFrame:
        """Live product x city combinations with their totals."""
        return self.members(COMBO).select("member", "grp", "city", "total")

    def combos_with_series(self) -> DataFrame:
        return self.members(COMBO)

    def release(self) -> None:
        for f in self._frames.values():
            if isinstance(f, DataFrame):
                f.unpersist()


def roll_up(facts: DataFrame, cols: tuple[str, ...], measure: str, net_returns: bool) -> DataFrame:
    amount = signed_amount(measure, net_returns)
    return (
        facts.filter(F.col("month").isNotNull())
        .withColumn("_signed", amount)
        .filter(F.col("_signed") != 0)
        .groupBy(*cols, "month")
        .agg(F.sum("_signed").alias("amount"))
    )


def live_members(cells: DataFrame, axis: Axis, n: int) -> DataFrame:
    """One row per member with the series of its live months.

    A member has one entry for each of its live months, so the list collected per member does not grow with the facts,
    nor with the length of the axis.
    """
    entries = F.collect_list(F.struct("idx", F.col("amount").cast("double").alias("v")))
    return _members(cells, axis, S.series(entries, n))


def dense_series(cells: DataFrame, axis: Axis, n: int) -> DataFrame:
    """One row per member with its zero-filled array of ``n`` entries, for axes of fixed length such as the month names."""
    entries = F.map_from_entries(F.collect_list(F.struct("idx", F.col("amount").cast("double").alias("v"))))
    return _members(cells, axis, dense.dense(entries, n))


def _members(cells: DataFrame, axis: Axis, series: Column) -> DataFrame:
    monthly = cells.groupBy(*axis.cols, "idx").agg(F.sum("amount").alias("amount"))
    agg = monthly.groupBy(*axis.cols).agg(F.sum("amount").cast("double").alias("total"), series.alias("s"))
    member = F.lit(axis.label) if not axis.cols else F.concat_ws(" x ", *[F.col(c) for c in axis.cols])
    return agg.select(member.alias("member"), *axis.cols, F.coalesce("total", F.lit(0.0)).alias("total"), "s")


def _month_number(d: date) -> int:
    return d.year * 12 + d.month - 1


def build_cube(
    facts: DataFrame,
    from_date: date | None = None,
    to_date: date | None = None,
    net_returns: bool = True,
    measure: str = "amount",
) -> Cube:
    """Roll the fact table up to the (city, grp, month) cuboid and fix the period axis.

    The axis is the requested window, widened to the data and filled without gaps, however long it gets. One small job
    reads it: a row per month that has data, of which the DATE type has 119,988.
    """
    placed = resolve_period(facts)
    monthly = written_down(roll_up(placed, ("city", "grp"), measure, net_returns), "cuboid")
    per_month = {r["month"]: r["amount"] for r in monthly.groupBy("month").agg(F.sum("amount").alias("amount")).collect()}
    lows = [*per_month, *([from_date] if from_date else [])]
    highs = [*per_month, *([to_date] if to_date else [])]
    if not lows or not highs or max(highs) < min(lows):
        cells = monthly.select("city", "grp", F.lit(0).alias("idx"), "amount").limit(0)
        return Cube(placed, cells, None, 0, [], net_returns, measure)
    first = _month_number(min(lows))
    n = _month_number(max(highs)) - first + 1
    start = date(first // 12, first % 12 + 1, 1)
    cells = monthly.select("city", "grp", month_index(F.col("month"), start).alias("idx"), "amount")
    totals = [Decimal(0)] * n
    for month, amount in per_month.items():
        totals[_month_number(month) - first] += amount
    return Cube(placed, cells, start, n, totals, net_returns, measure)


def period_axis(cube: Cube) -> DataFrame:
    return cube.months().select(F.col("idx").cast("bigint").alias("idx"), "period", "month")


def cube_totals(cube: Cube, axis: Axis) -> DataFrame:
    return cube.all_members(axis).select("member", F.round("total", 2).alias("total"))


def cube_matrix(cube: Cube, cols: tuple[str, ...]) -> DataFrame:
    """A matrix of the cube, e.g. ("city", "idx") or ("grp", "item")."""
    names = set(cols)
    if names <= {"city", "grp", "idx"}:
        base = cube.cells
    else:
        keep = tuple(c for c in cols if c != "idx")
        base = roll_up(cube.facts, keep, cube.measure, cube.net_returns).select(
            *keep, month_index(F.col("month"), cube.start).alias("idx"), "amount"
        ).filter(F.col("idx").between(0, cube.n - 1))
    out = base.groupBy(*cols).agg(F.sum("amount").cast("double").alias("amount"))
    return out.withColumn("idx", F.col("idx").cast("bigint")) if "idx" in names else out


def cube_meta(cube: Cube) -> DataFrame:
    """Row accounting of the cube build, from the facts in one pass."""
    signed = signed_amount(cube.measure, True)
    idx = month_index(F.col("month"), cube.start)
    on_axis = F.coalesce(idx.between(0, cube.n - 1), F.lit(False))
    names = cube.n
    return cube.facts.withColumn("_v", signed).withColumn("_on", on_axis).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("_on") & (F.col("_v") != 0)).alias("rows_counted"),
        F.count_if(~F.col("_on")).alias("rows_off_axis"),
        F.count_if(F.col("_on") & (F.col("_v") == 0)).alias("rows_zero"),
        F.count_if(F.col("_on") & (F.col("_v") < 0)).alias("return_rows"),
        F.coalesce(F.sum(F.when(F.col("_on") & (F.col("_v") < 0), F.abs("_v"))), F.lit(0))
        .cast("double").alias("return_amount"),
        F.count_if(F.col("period_fallback")).alias("periods_from_fallback"),
        F.count_if(F.col("month").isNull()).alias("unresolved_rows"),
    ).select(
        "*", F.lit(names).cast("bigint").alias("periods"), F.lit(False).alias("truncated"),
        F.lit(cube.n > 12).alias("same_month_collision"),
    )


def dense_long(cube: Cube, axis: Axis) -> DataFrame:
    """member x period in long form, zero-filled."""
    return cube.members(axis).select("member", F.posexplode(S.values(F.col("s"))).alias("idx", "amount")).select(
        "member", F.col("idx").cast("bigint").alias("idx"), "amount"
    )


def all_combos(cube: Cube) -> DataFrame:
    """Every city x product pair with its total and whether it is live.

    Products are numbered by total, each city row generates those numbers, and an
    equi-join turns numbers back into names: the product is the answer itself, but
    no pair is produced by an unkeyed join.
    """
    groups = ranked(cube.all_members(GROUP).select("grp", "total"), "total", ("grp",), name="pos").select("grp", "pos")
    n_groups = groups.select(F.max("pos")).scalar()
    cities = cube.all_members(CITY).select("city").withColumn("pos", F.explode(F.sequence(F.lit(1).cast("bigint"), n_groups)))
    live = cube.all_members(COMBO).select("city", "grp", F.col("total").alias("revenue"))
    return (
        cities.join(groups, "pos")
        .join(live, ["city", "grp"], "left")
        .select("city", "grp", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .withColumn("is_active", F.col("revenue") != 0)
    )


def active_counterparts(cube: Cube, primary: Axis) -> DataFrame:
    """For every member, its live counterparts numbered strongest first."""
    other = "grp" if primary.key == "city" else "city"
    mine = primary.cols[0]
    r = ranked(cube.combos(), "total", (other,), (mine,))
    return r.select(F.col(mine).alias("member"), F.col(other).alias("counterpart"), "rank",
                    F.col("total").alias("revenue"))


def member_statistics(cube: Cube, axis: Axis) -> DataFrame:
    """The statistical primitives (C07-C18) of every member in one projection."""
    n = cube.n
    s = F.col("s")
    streak, growth = S.decline_streak(s), S.growth_streak(s)
    base = cube.members(axis).withColumn("mean", F.col("total") / n)
    base = base.withColumn("sd", S.stddev(s, F.col("mean"))).withColumn("peak", S.peak(s)).withColumn("trough", S.trough(s))
    half = (n + 1) // 2
    return base.select(
        "member",
        frac(F.col("mean")).alias("mean"),
        F.round("sd", 2).alias("sd"),
        frac(ratio(F.col("sd"), F.abs("mean"))).alias("cv"),
        F.round(S.slope(s, n), 2).alias("slope"),
        streak["best"].cast("bigint").alias("decline_longest"),
        streak["run"].cast("bigint").alias("decline_current"),
        growth["best"].cast("bigint").alias("growth_longest"),
        growth["run"].cast("bigint").alias("growth_current"),
        frac(S.window_mean(s, 3)).alias("recent_avg"),
        frac(S.window_mean(s, 3, 3)).alias("prior_avg"),
        F.round("peak", 2).alias("peak"),
        S.first_index_of(s, F.col("peak")).cast("bigint").alias("peak_idx"),
        F.round("trough", 2).alias("trough"),
        S.first_index_of(s, F.col("trough")).cast("bigint").alias("trough_idx"),
        frac(ratio(F.col("peak"), F.col("trough"))).alias("peak_trough_ratio"),
        F.round(S.last(s) - F.col("peak"), 2).alias("peak_gap"),
        frac(ratio(S.last(s) - F.col("peak"), F.abs("peak"))).alias("peak_gap_rate"),
        frac(S.hhi(s)).alias("hhi"),
        frac(1 / F.when(S.hhi(s) > 0, S.hhi(s))).alias("diversification"),
        F.round(S.part(s, 0, half), 2).alias("first_half"),
        F.round(S.part(s, half, n), 2).alias("second_half"),
    )


def mom_series(cube: Cube, axis: Axis) -> DataFrame:
    """Month-on-month growth of every member (NULL at the first period and after a zero)."""
    return cube.members(axis).select("member", F.inline(S.long(F.col("s")))).select(
        "member", F.col("idx").cast("bigint").alias("idx"), F.col("value").alias("amount"),
        frac(ratio(F.col("value") - F.col("prev"), F.abs("prev"))).alias("mom"),
    )
