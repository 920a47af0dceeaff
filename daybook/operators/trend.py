"""Trend analyses: direction, streaks, momentum, peaks and timing of revenue.

Each takes the cube (and an axis) and returns an Analysis: its table and verdict.
Per-member statistics are projections over the member's series array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import frac, growth_rate, inaction_cost, money, null, positive_part, ratio
from ..functions.live_series import s
from ..plans.thresholds import AMBER, GREEN, amber_only, falling, two_step
from ..plans.verdict import Analysis, per_row, single
from .cube import CITY, Axis, Cube
from .ranking import ranked


def falls(x: Column) -> Column:
    """How far a signed rate is below zero; zero when it is not."""
    return positive_part(-x)


def when_long_enough(cube: Cube, periods: int, metric: Column) -> Column:
    return metric if cube.n >= periods else null()


def direction_of(x: Column, up: str = "Growing", down: str = "Declining", flat: str = "Flat") -> Column:
    return F.when(x > 0, up).when(x < 0, down).otherwise(flat)


def step_status(change: Column) -> Column:
    return F.when(change < 0, AMBER).otherwise(GREEN)


def decline_streak(cube: Cube, axis: Axis) -> Analysis:
    change = S.last(s()) - S.at(s(), 0)
    rows = cube.members(axis).select(
        "member",
        money(F.col("total")).alias("revenue"),
        S.decline_streak(s())["best"].cast("bigint").alias("streak"),
        F.round(S.slope(s(), cube.n), 2).alias("slope"),
        inaction_cost(change).alias("_coi"),
    )
    a = per_row(rows, F.col("streak"), "DECLINE_STREAK", noun=axis.noun,
                headline=F.max("streak"), coi=money(F.sum("_coi")))
    a.table = a.table.withColumn("coi", frac(F.col("_coi"))).drop("_coi")
    return a


def latest_growth(cube: Cube, axis: Axis) -> Analysis:
    growth = when_long_enough(cube, 2, growth_rate(S.last(s()), S.last(s(), 1)))
    rows = cube.members(axis).select("member", money(F.col("total")).alias("revenue"), growth.alias("g"))
    a = per_row(rows, falls(F.col("g")), "LATEST_MOM_DECLINE", noun=axis.noun,
                headline=frac(F.min(F.when(F.col("g") < 0, F.col("g")))))
    a.table = a.table.select(
        "member", "revenue", frac(F.col("g")).alias("growth"),
        F.when(F.col("g").isNull(), "No prior month").otherwise(direction_of(F.col("g"))).alias("direction"),
        "status", "severity")
    return a


def rolling_momentum(cube: Cube, axis: Axis, window: int = 3) -> Analysis:
    recent, prior = S.window_mean(s(), window), S.window_mean(s(), window, window)
    both = prior.isNotNull()
    rows = cube.members(axis).select(
        "member", F.when(both, recent).alias("r"), prior.alias("p")
    ).withColumn("c", growth_rate(F.col("r"), F.col("p")))
    a = per_row(rows, falls(F.col("c")), "MOMENTUM_3M_DECLINE", noun=axis.noun, headline=frac(F.min("c")))
    a.table = a.table.select("member", money(F.col("r")).alias("recent"), money(F.col("p")).alias("prior"),
                             frac(F.col("c")).alias("change"), "status", "severity")
    return a


def peak_gap(cube: Cube, axis: Axis) -> Analysis:
    rows = cube.members(axis).withColumn("peak", S.peak(s())).withColumn("current", S.last(s())).withColumn(
        "g", F.col("current") - F.col("peak")
    ).withColumn("r", ratio(F.col("g"), F.abs("peak")))
    shortfall = F.sum(F.when(F.col("g") < 0, -F.col("g")))
    a = per_row(rows, falls(F.col("r")), "PEAK_GAP", noun=axis.noun,
                headline=frac(F.min("r")), coi=money(shortfall))
    a.table = a.table.select(
        "member", money(F.col("peak")).alias("peak"),
        cube.label(S.first_index_of(s(), F.col("peak"))).alias("peak_month"),
        money(F.col("current")).alias("current"), money(F.col("g")).alias("gap"),
        frac(F.col("r")).alias("gap_pct"), "status", "severity")
    return a


def share_shift(cube: Cube, axis: Axis) -> Analysis:
    first = float(cube.period_totals[0]) if cube.n else 0.0
    final = float(cube.period_totals[-1]) if cube.n else 0.0
    rows = cube.members(axis).select(
        "member",
        when_long_enough(cube, 2, ratio(S.at(s(), 0), F.lit(first))).alias("a"),
        when_long_enough(cube, 2, ratio(S.last(s()), F.lit(final))).alias("b"),
    ).withColumn("d", F.col("b") - F.col("a"))
    a = per_row(rows, falls(F.col("d")), "SHARE_LOSS_PP", noun=axis.noun,
                headline=frac(F.when(F.min("d") < 0, F.max(F.abs("d")))))
    a.table = a.table.select("member", frac(F.col("a")).alias("start_share"), frac(F.col("b")).alias("end_share"),
                             frac(F.col("d")).alias("shift"), "status", "severity")
    return a


def _dispersion(cube: Cube, axis: Axis, zero_totals: bool = False) -> DataFrame:
    base = cube.all_members(axis) if zero_totals else cube.members(axis)
    return base.withColumn("m", F.col("total") / max(cube.n, 1)).withColumn("sd", S.stddev(s(), F.col("m"))).withColumn(
        "cv", ratio(F.col("sd"), F.abs("m")))


def volatility_cv(cube: Cube, axis: Axis) -> Analysis:
    a = per_row(_dispersion(cube, axis), F.col("cv"), "VOLATILITY_CV", noun=axis.noun, headline=frac(F.max("cv")))
    flag = F.when(F.col("cv").isNull(), "Not assessed").when(F.col("status") == "RED", "HIGH VOLATILITY").when(
        F.col("status") == "AMBER", "MODERATE").otherwise("STABLE")
    a.table = a.table.select("member", frac(F.col("m")).alias("mean"), money(F.col("sd")).alias("std_dev"),
                             frac(F.col("cv")).alias("cv"), flag.alias("flag"), "status", "severity")
    return a


def top_n_dependency(cube: Cube, axis: Axis, n: int = 2, threshold: str = "TOP2_DEPENDENCY") -> Analysis:
    members = cube.members(axis).select("member", "total")
    top = members.orderBy(F.desc("total"), "member").limit(n)
    table = members.join(top.select("member", F.lit("Yes").alias("in_top")), "member", "left").select(
        "member", money(F.col("total")).alias("revenue"),
        frac(ratio(F.col("total"), F.lit(cube.total))).alias("share_pct"),
        F.coalesce("in_top", F.lit("No")).alias("in_top_n"))
    enough = members.select(F.count(F.lit(1)) >= 2).scalar()
    facts = top.agg(F.sum("total").alias("t")).select(F.when(enough, ratio(F.col("t"), F.lit(cube.total))).alias("m"))
    return single(table, facts, F.col("m"), threshold, headline=frac(F.col("m")))


def trend_slope(cube: Cube, axis: Axis) -> Analysis:
    rows = cube.members(axis).select("member", (F.col("total") / max(cube.n, 1)).alias("m"),
                                     S.slope(s(), cube.n).alias("b"))
    metric = ratio(falls(F.col("b")), F.abs("m"))
    a = per_row(rows, metric, "NEGATIVE_SLOPE", noun=axis.noun, headline=money(F.min("b")))
    words = F.when(F.col("b").isNull(), "Not assessed").when(F.col("b") == 0, "Flat").when(
        F.col("b") > 0, "Upward").when(F.col("status").isin("AMBER", "RED"), "Steep Decline").otherwise("Declining")
    a.table = a.table.select("member", money(F.col("b")).alias("slope"),
                             money(F.col("b") * cube.n).alias("projected"), words.alias("direction"),
                             "status", "severity")
    return a


def company_trend(cube: Cube) -> Analysis:
    change = F.col("revenue") - F.col("prev")
    table = cube.months().select("month", money(F.col("revenue")).alias("revenue"),
                                 frac(growth_rate(F.col("revenue"), F.col("prev"))).alias("mom"),
                                 step_status(change).alias("status"))
    facts = cube.company().select((S.last(s()) - S.at(s(), 0)).alias("c"), S.at(s(), 0).alias("f"))
    rate = when_long_enough(cube, 2, ratio(F.col("c"), F.abs("f")))
    return single(table, facts, falls(rate), "COMPANY_DECLINE", headline=money(F.col("c")),
                  coi=money(inaction_cost(F.col("c"))))


def growth_decline_balance(cube: Cube, axis: Axis) -> Analysis:
    base = cube.members(axis).select("member", "total", S.slope(s(), cube.n).alias("b"))
    way = F.when(F.col("b").isNull(), "Flat").otherwise(direction_of(F.col("b")))
    table = base.select("member", money(F.col("total")).alias("revenue"),
                        frac(ratio(F.col("total"), F.lit(cube.total))).alias("share_pct"), way.alias("direction"),
                        F.when(way == "Declining", AMBER).otherwise(GREEN).alias("status"))
    facts = base.agg(F.count_if(F.col("b") < 0).alias("down"), F.count_if(F.col("b") > 0).alias("up"),
                     F.count(F.lit(1)).alias("n"))
    metric = when_long_enough(cube, 2, ratio(F.col("down").cast("double"), F.col("n")))
    return single(table, facts, metric, "DECLINING_SHARE_OF_ENTITIES", headline=F.col("up"))


def monthly_concentration(cube: Cube) -> Analysis:
    total = F.lit(cube.total)
    share = F.when(total > 0, F.col("revenue") / F.when(total > 0, total)).otherwise(0.0)
    table = cube.months().select("month", money(F.col("revenue")).alias("revenue"), frac(share).alias("share_pct"))
    facts = cube.company().select(S.peak(s()).alias("hi"), S.trough(s()).alias("lo"))
    spread = F.when(F.col("lo") > 0, F.col("hi") / F.when(F.col("lo") > 0, F.col("lo"))).when(
        F.col("hi") > 0, F.lit(99.0)).otherwise(1.0)
    return single(table, facts, when_long_enough(cube, 2, spread), two_step(1.5, 2.0), headline=money(spread))


def front_vs_back(cube: Cube) -> Analysis:
    half = (cube.n + 1) // 2
    rest = cube.n - half
    facts = cube.company().select(
        S.part(s(), 0, max(half, 1)).alias("t1"),
        S.part(s(), half, cube.n).alias("t2"),
    ).withColumn("a1", F.col("t1") / max(half, 1)).withColumn("a2", F.col("t2") / max(rest, 1)).withColumn(
        "d", F.when(F.col("a1") > 0, (F.col("a2") - F.col("a1")) / F.when(F.col("a1") > 0, F.col("a1"))).otherwise(0.0))
    halves = F.array(
        F.struct(F.lit(f"First Half (P1-P{half})").alias("period"), F.col("t1").alias("t"), F.col("a1").alias("a")),
        F.struct(F.lit(f"Second Half (P{half + 1}-P{cube.n})").alias("period"), F.col("t2").alias("t"), F.col("a2").alias("a")))
    table = facts.select(F.inline(halves)).select(
        "period", money(F.col("t")).alias("revenue"), frac(F.col("a")).alias("avg_monthly"),
        frac(ratio(F.col("t"), F.lit(cube.total))).alias("share_pct"))
    return single(table, facts, when_long_enough(cube, 2, F.col("d")), falling(-0.05, -0.15),
                  headline=frac(F.col("d")), coi=money(F.when(F.col("d") < 0, F.col("a1") - F.col("a2"))))


def monthly_volatility(cube: Cube, axis: Axis) -> Analysis:
    rows = _dispersion(cube, axis, zero_totals=True).withColumn("v", F.coalesce("cv", F.lit(0.0)))
    a = per_row(rows, when_long_enough(cube, 2, F.col("v")), two_step(0.20, 0.30), noun=axis.noun,
                headline=frac(F.max("v")))
    a.table = a.table.select("member", frac(F.col("m")).alias("mean"),
                             money(F.coalesce("sd", F.lit(0.0))).alias("std_dev"), frac(F.col("v")).alias("cv"),
                             "status", "severity")
    return a


def latest_vs_average(cube: Cube) -> Analysis:
    facts = cube.company().select(S.last(s()).alias("latest"), (F.col("total") / max(cube.n, 1)).alias("m"))
    gap = F.when(F.col("m") > 0, (F.col("latest") - F.col("m")) / F.when(F.col("m") > 0, F.col("m"))).otherwise(0.0)
    table = facts.select(money(F.col("latest")).alias("latest"), frac(F.col("m")).alias("average"),
                         frac(gap).alias("variance_pct"))
    return single(table, facts, when_long_enough(cube, 2, gap), falling(-0.10, -0.20), headline=frac(gap),
                  coi=money(F.when(gap < 0, F.col("m") - F.col("latest"))))


def recent_3m_share(cube: Cube) -> Analysis:
    facts = cube.company().select((S.last(s()) + S.last(s(), 1) + S.last(s(), 2)).alias("t3"), "total")
    actual = F.when(F.col("total") > 0, F.col("t3") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0)
    expected = F.lit(3.0 / max(cube.n, 1))
    table = facts.select(money(F.col("t3")).alias("recent_3m"), frac(actual).alias("share_pct"),
                         frac(expected).alias("expected_pct"), frac(actual - expected).alias("delta_pp"))
    return single(table, facts, when_long_enough(cube, 3, actual - expected), falling(-0.03, -0.06),
                  headline=frac(actual))


def mom_consistency(cube: Cube) -> Analysis:
    moves = F.transform(S.moves(s()), lambda m: m["d"])
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def advance(acc: Column, d: Column) -> Column:
        run = F.when(d < 0, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    facts = cube.company().select(
        F.size(F.filter(moves, lambda d: d > 0)).cast("bigint").alias("up"),
        F.size(F.filter(moves, lambda d: d < 0)).cast("bigint").alias("down"),
        F.aggregate(moves, start, advance)["best"].cast("bigint").alias("longest"))
    grew = F.col("up") / F.lit(float(max(cube.n - 1, 1)))
    table = facts.select("up", "down", "longest", frac(grew).alias("consistency"))
    return single(table, facts, when_long_enough(cube, 2, grew), falling(0.50, 0.35), headline=frac(grew))


def rank_stability(cube: Cube, axis: Axis = CITY) -> Analysis:
    base = cube.all_members(axis).select("member", "total", S.at(s(), 0).alias("a"), S.last(s()).alias("b")).withColumn(
        "neg_total", -F.col("total"))
    tie = ("neg_total", "member")
    r = ranked(ranked(base, "a", tie, name="rank_first"), "b", tie, name="rank_latest")
    table = r.select("member", "rank_first", "rank_latest",
                     (F.col("rank_first") - F.col("rank_latest")).alias("rank_change"),
                     F.when(F.col("rank_latest") > F.col("rank_first"), AMBER).otherwise(GREEN).alias("status"))
    facts = table.agg(F.greatest(F.max(-F.col("rank_change")), F.lit(0)).alias("drop"))
    return single(table, facts, when_long_enough(cube, 2, F.col("drop")), two_step(1, 2), headline=F.col("drop"))


def quarterly_trajectory(cube: Cube) -> Analysis:
    rows = cube.company().select(S.sums_of(s(), 3).alias("q")).select("q", F.posexplode("q").alias("i", "revenue")).withColumn(
        "prior", F.get("q", F.col("i") - 1))
    change = F.when(F.col("prior") > 0, (F.col("revenue") - F.col("prior")) / F.when(F.col("prior") > 0, F.col("prior")))
    rows = rows.withColumn("c", change)
    table = rows.select((F.col("i") + 1).cast("bigint").alias("quarter"), money(F.col("revenue")).alias("revenue"),
                        frac(F.col("c")).alias("qoq"), step_status(F.col("c")).alias("status"))
    facts = rows.agg(F.count_if(F.col("c") < 0).alias("down"))
    return single(table, facts, when_long_enough(cube, 3, F.col("down")), two_step(1, 2), headline=F.col("down"))


def cross_city_sync(cube: Cube, axis: Axis = CITY) -> Analysis:
    table = cube.all_members(axis).select(
        "member", direction_of(S.last(s()) - S.last(s(), 1)).alias("latest_direction"),
        direction_of(S.last(s(), 1) - S.last(s(), 2)).alias("prior_direction"),
    ).withColumn("changed", F.when(F.col("latest_direction") != F.col("prior_direction"), "Yes").otherwise("No")).withColumn(
        "status", F.when(F.col("latest_direction") == "Declining", AMBER).otherwise(GREEN))
    facts = table.agg(F.count_if(F.col("latest_direction") == "Growing").alias("up"),
                      F.count_if(F.col("latest_direction") == "Declining").alias("down"), F.count(F.lit(1)).alias("n"))
    split = ((F.col("up") > 0) & (F.col("down") > 0)).cast("double")
    metric = when_long_enough(cube, 3, F.when(F.col("n") >= 2, split))
    return single(table, facts, metric, amber_only(1), headline=split)


def latest_vs_peak(cube: Cube) -> Analysis:
    facts = cube.company().select(S.peak(s()).alias("p"), S.last(s()).alias("latest"), "s")
    reach = F.when(F.col("p") > 0, F.col("latest") / F.when(F.col("p") > 0, F.col("p"))).otherwise(1.0)
    table = facts.select(money(F.col("p")).alias("peak"), cube.label(S.first_index_of(s(), F.col("p"))).alias("peak_month"),
                         money(F.col("latest")).alias("latest"), money(F.col("p") - F.col("latest")).alias("gap"),
                         frac(reach).alias("share_of_peak"))
    return single(table, facts, when_long_enough(cube, 2, reach), falling(0.85, 0.70), headline=frac(reach),
                  coi=money(F.col("p") - F.col("latest")))


def growth_decline_impact(cube: Cube, axis: Axis, amber: float = 0.0, red: float = -20000.0) -> Analysis:
    rows = cube.members(axis).select("member", S.at(s(), 0).alias("a"), S.last(s()).alias("b")).withColumn(
        "d", F.col("b") - F.col("a"))
    table = rows.select("member", money(F.col("a")).alias("start_revenue"), money(F.col("b")).alias("end_revenue"),
                        money(F.col("d")).alias("delta"), direction_of(F.round("d", 2)).alias("direction"),
                        step_status(F.round("d", 2)).alias("status"))
    facts = rows.agg(F.round(F.sum("d"), 2).alias("net"))
    return single(table, facts, when_long_enough(cube, 2, F.col("net")), falling(amber, red), headline=F.col("net"),
                  coi=F.when(F.col("net") < 0, -F.col("net")))


