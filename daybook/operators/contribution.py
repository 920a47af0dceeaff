"""Contribution bridge: who moved revenue between two sets of months, and by how much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import frac, growth_rate, inaction_cost, money, one, ratio
from ..functions.live_series import s
from ..plans.thresholds import AMBER, GREEN, two_step
from ..plans.verdict import Analysis, per_row, single
from .cube import GROUP, Axis, Cube
from .trend import falls, step_status, when_long_enough


def d() -> Column:
    return F.col("delta")


@dataclass
class Bridge:
    rows: DataFrame
    facts: DataFrame
    base_label: str
    comparison_label: str


def _sum_at(periods: list[int]) -> Column:
    return F.aggregate(F.array(*[F.lit(i) for i in periods]), F.lit(0.0), lambda a, i: a + S.at(s(), i))


def bridge(cube: Cube, axis: Axis, base: list[int] | None = None, comparison: list[int] | None = None) -> Bridge:
    """Base and comparison sums per member (default: first and last period), with totals in ``facts``."""
    base = base or [0]
    comparison = comparison or [max(cube.n - 1, 0)]
    rows = cube.all_members(axis).select("member", F.round(_sum_at(base), 2).alias("base"),
                                         F.round(_sum_at(comparison), 2).alias("comparison"))
    rows = rows.filter((F.col("base") != 0) | (F.col("comparison") != 0)).withColumn(
        "delta", F.round(F.col("comparison") - F.col("base"), 2))
    if cube.n < 2:
        rows = rows.limit(0)
    zero = F.lit(0.0)
    facts = rows.agg(
        F.coalesce(F.round(F.sum(F.when(d() < 0, -d())), 2), zero).alias("lost"),
        F.coalesce(F.round(F.sum(F.when(d() > 0, d())), 2), zero).alias("gained"),
        F.count_if(d() < 0).alias("down"), F.count_if(d() > 0).alias("up"), F.count(one()).alias("n"),
        F.round(F.sum("base"), 2).alias("base_total"), F.round(F.sum("comparison"), 2).alias("comparison_total"),
        F.round(F.sum(d()), 2).alias("net"), F.min(d()).alias("worst"), F.max(d()).alias("best"),
        F.max(F.abs(d())).alias("largest"), F.round(F.sum(F.abs(d())), 2).alias("moved"), F.stddev_samp(d()).alias("sd"))
    lost = facts.select("lost").scalar()
    role = F.when(d() > 0, "GROWTH DRIVER").when(d() < 0, "DRAG").otherwise("NEUTRAL")
    rows = rows.withColumn("share", F.when(d() < 0, ratio(-d(), lost))).withColumn("role", role)
    labels = (cube.label_at(base[0]), cube.label_at(comparison[-1])) if cube.n else ("", "")
    return Bridge(rows, facts, *labels)


def _table(b: Bridge) -> DataFrame:
    return b.rows.select("member", "base", "comparison", "delta", frac(F.col("share")).alias("share_of_decline"), "role",
                         step_status(d()).alias("status"))


def _built(metric: Column) -> Column:
    """NULL when no member was in the bridge (fewer than two periods, or nothing to compare)."""
    return F.when(F.col("n") > 0, metric)


def red_flags(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    a = per_row(b.rows, F.col("share"), "MATERIAL_NEGATIVE_CONTRIBUTOR", noun=axis.noun,
                headline=F.round(F.sum(d()), 2), coi=frac(inaction_cost(F.round(F.sum(d()), 2))))
    a.table = a.table.select("member", "base", "comparison", "delta", frac(F.col("share")).alias("share_of_decline"),
                             "role", "status", "severity")
    return a


def largest_negative(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    worst = F.least(F.col("worst"), F.lit(0.0))
    metric = F.coalesce(ratio(-worst, F.col("lost")), F.lit(0.0))
    return single(_table(b), b.facts, _built(metric), "MATERIAL_NEGATIVE_CONTRIBUTOR", headline=worst,
                  coi=frac(inaction_cost(worst)))


def largest_positive(cube: Cube, axis: Axis, **sides) -> Analysis:
    """A strong grower is good news; only the absence of any grower is flagged."""
    b = bridge(cube, axis, **sides)
    metric = F.when(F.col("up") == 0, F.lit(1.0)).otherwise(0.0)
    return single(_table(b), b.facts, _built(metric), "OFFSET_DEFICIT", headline=F.greatest(F.col("best"), F.lit(0.0)))


def net_movers(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    return single(_table(b), b.facts, ratio(F.col("down").cast("double"), F.col("n")), "DECLINING_SHARE_OF_ENTITIES",
                  headline=F.col("up"))


def positive_vs_negative(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    side = lambda name, amount, count: F.struct(F.lit(name).alias("side"), amount.alias("amount"), count.alias("members"))
    table = b.facts.select(F.inline(F.array(
        side("Growth", F.col("gained"), F.col("up")), side("Decline", -F.col("lost"), F.col("down")),
        side("Net", F.coalesce("net", F.lit(0.0)), F.col("n")))))
    table = table.select("side", (F.col("amount") + 0.0).alias("amount"), "members")
    uncovered = F.greatest(F.lit(0.0), ratio(F.col("lost") - F.col("gained"), F.col("lost")))
    metric = F.when(F.col("lost") != 0, uncovered)
    return single(table, b.facts, metric, "OFFSET_DEFICIT", headline=F.col("net"), coi=frac(inaction_cost(F.col("net"))))


def contribution_imbalance(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    m = ratio(F.col("largest"), F.col("moved"))
    return single(_table(b), b.facts, m, "MOVEMENT_CONCENTRATION", headline=frac(m))


def top_negative(cube: Cube, axis: Axis, n: int = 2, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    worst = b.rows.filter(d() < 0).orderBy(F.asc("delta"), "member").limit(n)
    lost = b.facts.select("lost").scalar()
    facts = worst.agg(F.sum(-d()).alias("c")).withColumn("m", ratio(F.col("c"), lost))
    return single(_table(b), facts, F.col("m"), "TOP2_NEGATIVE_SHARE", headline=frac(F.col("m")),
                  coi=frac(inaction_cost(-F.col("c"))))


def offset_capacity(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    cover = ratio(F.col("gained"), F.col("lost"))
    metric = F.when(cover.isNotNull(), F.greatest(F.lit(0.0), 1 - cover))
    return single(b.rows.select("member", "delta", "role", step_status(d()).alias("status")), b.facts, metric,
                  "OFFSET_DEFICIT", headline=money(cover))


def change_vs_average(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    avg = b.facts.select(ratio(F.col("moved"), F.col("n"))).scalar()
    multiple = ratio(F.abs(d()), avg)
    table = b.rows.select("member", "delta", money(multiple).alias("multiple"), "role",
                          F.when((d() < 0) & (multiple > 2), AMBER).otherwise(GREEN).alias("status"))
    most = ratio(F.col("largest"), ratio(F.col("moved"), F.col("n")))
    return single(table, b.facts, most, two_step(2, 3.5), headline=money(most))


def _sides_table(b: Bridge) -> DataFrame:
    return b.facts.select(F.inline(F.array(
        F.struct(F.lit("base").alias("side"), F.lit(b.base_label).alias("period"), F.col("base_total").alias("revenue")),
        F.struct(F.lit("comparison").alias("side"), F.lit(b.comparison_label).alias("period"), F.col("comparison_total").alias("revenue")),
        F.struct(F.lit("change").alias("side"), F.lit("").alias("period"), F.col("net").alias("revenue")))))


def company_growth(cube: Cube, axis: Axis = GROUP, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    rate = ratio(F.col("net"), F.abs("base_total"))
    return single(_sides_table(b), b.facts, falls(rate), "COMPANY_DECLINE", headline=frac(rate),
                  coi=frac(inaction_cost(F.col("net"))))


def monthly_direction(cube: Cube) -> Analysis:
    runs = cube.company().select(F.posexplode(S.decline_run_by_index(s())).alias("idx", "streak"))
    table = cube.months().join(runs, "idx").select("month", money(F.col("revenue")).alias("revenue"), F.col("streak").cast("bigint").alias("streak"))
    table = table.withColumn("status", F.when(F.col("streak") >= 3, AMBER).otherwise(GREEN))
    facts = cube.company().select(S.slope(s(), cube.n).alias("b"), (F.col("total") / max(cube.n, 1)).alias("m"))
    return single(table, facts, ratio(falls(F.col("b")), F.abs("m")), "NEGATIVE_SLOPE", headline=money(F.col("b")))


def decline_persistence(cube: Cube) -> Analysis:
    table = cube.months().select("month", money(F.col("revenue")).alias("revenue"),
                                 frac(growth_rate(F.col("revenue"), F.col("prev"))).alias("mom"),
                                 step_status(F.col("revenue") - F.col("prev")).alias("status"))
    facts = cube.company().select(F.round(S.last(s()) - S.last(s(), 1), 2).alias("c"))
    return single(table, facts, falls(F.col("c")), "LATEST_MONTH_FELL", headline=F.col("c"))


def break_even_timeline(cube: Cube, axis: Axis = GROUP, **sides) -> Analysis:
    """Months until a fifth of the latest month is gone at the fitted (negative) trend."""
    net = bridge(cube, axis, **sides).facts.select("net").scalar()
    facts = cube.company().select(S.last(s()).alias("latest"), S.slope(s(), cube.n).alias("b"), net.alias("net"))
    runway = F.when(F.col("b") < 0, F.col("latest") * 0.2 / F.abs("b"))
    short = F.when(runway.isNotNull(), F.greatest(F.lit(0.0), 12 - runway))
    table = facts.select(money(F.col("latest")).alias("latest"), frac(F.col("latest") * 0.2).alias("fifth"),
                         money(F.col("b")).alias("slope"), F.col("net").alias("bridge_change"),
                         F.round(runway, 4).alias("months_left"))
    return single(table, facts, short, "DECLINE_RUNWAY_SHORTFALL", headline=F.round(runway, 4),
                  coi=frac(inaction_cost(F.col("net"))))


def change_distribution(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    m = ratio(F.col("sd"), ratio(F.col("moved"), F.col("n")))
    return single(_table(b), b.facts, F.when(F.col("n") >= 2, m), "CHANGE_DISTRIBUTION_SPREAD", headline=frac(m))


def net_position(cube: Cube, axis: Axis = GROUP, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    share = F.when((F.col("base_total") == 0) | (F.col("net") >= 0), F.lit(0.0)).otherwise(
        ratio(F.abs("net"), F.col("base_total")))
    return single(_sides_table(b), b.facts, _built(share), "NET_REVENUE_DECLINE", headline=F.col("net"),
                  coi=frac(inaction_cost(F.col("net"))))


def recovery_potential(cube: Cube, axis: Axis, **sides) -> Analysis:
    b = bridge(cube, axis, **sides)
    m = F.when(F.col("down") > 0, ratio(F.col("lost"), F.col("base_total")))
    return single(_table(b), b.facts, m, "RECOVERABLE_SHARE", headline=F.when(F.col("down") > 0, F.col("lost")),
                  coi=F.when(F.col("down") > 0, F.round(F.col("lost") * 3, 2)))


def monthly_bridge(cube: Cube) -> Analysis:
    step = F.round(F.col("revenue") - F.col("prev"), 2)
    table = cube.months().filter(F.col("idx") > 0).select(
        "month", money(F.col("revenue")).alias("revenue"), step.alias("delta"), step_status(step).alias("status"))
    facts = cube.company().select(
        F.round(S.last(s()) - S.at(s(), 0), 2).alias("c"),
        (S.empty_months(s()) / F.lit(float(max(cube.n, 1)))).alias("empty"))
    return single(table, facts, when_long_enough(cube, 2, F.col("empty")), two_step(0.25, 0.50), headline=F.col("c"))


def structural_limits(cube: Cube) -> Analysis:
    """What the shape of the data rules out: too few periods, empty months, missing dimensions."""
    empty = S.empty_months(s())
    n = cube.n
    checks = [
        (F.lit(n < 2), "month-over-month movement: single period"),
        (F.lit(n < 3), "3-month momentum: fewer than three periods"),
        (F.lit(n < 6), "half-over-half comparison: fewer than six periods"),
        (empty > 0, "monthly bridge: months without revenue"),
        (F.lit(cube.cells.select("city").limit(1).count() == 0), "city attribution: no city"),
        (F.lit(cube.cells.select("grp").limit(1).count() == 0), "product attribution: no stock group"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))
    facts = cube.company().select(found.alias("limits"))
    table = facts.select(F.explode("limits").alias("limitation")).withColumn("state", F.lit("Limited"))
    count = F.size("limits").cast("bigint")
    return single(table, facts, count, two_step(1, 3), headline=count)


