"""Peak and trough analyses of members and of the company's months."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import frac, money, one, ratio
from ..functions.live_series import s
from ..plans.thresholds import AMBER, GREEN, NO_BANDS, falling, two_step
from ..plans.verdict import Analysis, per_row, single
from .cube import Axis, Cube
from .trend import when_long_enough

c = F.col


def profile(df: DataFrame, cube: Cube) -> DataFrame:
    """Peak, trough, ratio, gap, mean, current and CV of each series.

    ``collapsed``: sold at its peak but fell to zero or below; its ratio is undefined
    (NULL) and it counts as the most volatile. A series that never sold has ratio 1.
    """
    d = df.withColumn("peak", S.peak(s())).withColumn("trough", S.trough(s())).withColumn("mean", c("total") / max(cube.n, 1))
    d = d.withColumn("collapsed", (c("trough") <= 0) & (c("peak") > 0))
    d = d.withColumn("pt_ratio", F.when(~c("collapsed"), F.when(c("trough") > 0, c("peak") / F.when(c("trough") > 0, c("trough"))).otherwise(1.0)))
    d = d.withColumn("gap", F.round(c("peak") - c("trough"), 2)).withColumn("current", S.last(s()))
    d = d.withColumn("peak_idx", S.first_index_of(s(), c("peak"))).withColumn("trough_idx", S.first_index_of(s(), c("trough")))
    return d.withColumn("cv", F.coalesce(ratio(S.stddev(s(), c("mean")), F.abs("mean")), F.lit(0.0)))


def _members(cube: Cube, axis: Axis) -> DataFrame:
    return profile(cube.members(axis), cube)


def _register(df: DataFrame) -> DataFrame:
    return df.select("member", money(c("peak")).alias("peak"), money(c("trough")).alias("trough"),
                     money(c("pt_ratio")).alias("pt_ratio"), "gap", "collapsed")


def peak_trough_profile(cube: Cube, axis: Axis) -> DataFrame:
    return _members(cube, axis).select(
        "member", money(c("peak")).alias("peak"), cube.label(c("peak_idx")).alias("peak_month"), money(c("trough")).alias("trough"),
        cube.label(c("trough_idx")).alias("trough_month"), frac(c("pt_ratio")).alias("pt_ratio"), "gap",
        frac(c("mean")).alias("mean"), money(c("total")).alias("total"), money(c("current")).alias("current"),
        frac(c("cv")).alias("cv"), "collapsed")


def _most_volatile(df: DataFrame):
    """Ratio of the most volatile member: NULL as soon as one collapsed."""
    return F.when(F.count_if(c("collapsed")) == 0, F.max("pt_ratio"))


def peak_trough_register(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis)
    a = per_row(d, c("pt_ratio"), "PEAK_TROUGH_RATIO", noun=axis.noun, headline=money(_most_volatile(d)))
    a.table = a.table.select(
        "member", money(c("peak")).alias("peak"), money(c("trough")).alias("trough"), money(c("pt_ratio")).alias("pt_ratio"),
        "gap", "collapsed", "status", "severity")
    return a


def highest_volatility(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis)
    facts = d.agg(_most_volatile(d).alias("r"))
    order = [F.desc("collapsed"), F.desc("pt_ratio"), F.desc("total"), F.asc("member")]
    return single(_register(d.orderBy(*order).limit(1)), facts, c("r"), two_step(2.0, 2.5), headline=money(c("r")))


def most_stable(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis)
    facts = d.agg(F.min("pt_ratio").alias("r"), F.count(one()).alias("n"))
    order = [F.asc("collapsed"), F.asc("pt_ratio"), F.desc("total"), F.asc("member")]
    a = single(_register(d.orderBy(*order).limit(1)), facts, F.when(c("n") > 0, 0.0), NO_BANDS, headline=money(c("r")))
    a.verdict = a.verdict.withColumn("priority", F.lit(5).cast("bigint"))
    return a


def average_volatility(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis)
    facts = d.agg(F.coalesce(F.avg("pt_ratio"), F.lit(1.0)).alias("r"), F.count_if(c("collapsed")).alias("collapsed"),
                  F.count(one()).alias("n"))
    table = facts.select(frac(c("r")).alias("average_ratio"), c("collapsed").alias("collapsed_members"), c("n").alias("members"))
    return single(table, facts, F.when(c("n") > 0, c("r")), two_step(1.75, 2.0), headline=money(c("r")))


def extreme_count(cube: Cube, axis: Axis, limit: float = 2.0) -> Analysis:
    wild = F.coalesce(c("pt_ratio") >= limit, F.lit(False)) | c("collapsed")
    d = _members(cube, axis)
    table = d.select("member", money(c("pt_ratio")).alias("pt_ratio"), F.when(wild, "Extreme").otherwise("Stable").alias("state"),
                     F.when(wild, AMBER).otherwise(GREEN).alias("status"))
    facts = d.agg(F.count_if(wild).alias("k"), F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, c("k")), two_step(1, 2), headline=c("k"))


def revenue_at_risk(cube: Cube, axis: Axis, amber: float = 25000, red: float = 50000) -> Analysis:
    d = _members(cube, axis)
    table = d.select("member", money(c("peak")).alias("peak"), money(c("trough")).alias("trough"), "gap")
    facts = d.agg(F.round(F.sum("gap"), 2).alias("g"))
    return single(table, facts, c("g"), two_step(amber, red), headline=c("g"), coi=frac(c("g") / max(cube.n, 1)))


def peak_month_share(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis).withColumn("p", F.when(c("total") > 0, c("peak") / F.when(c("total") > 0, c("total"))).otherwise(0.0))
    a = per_row(d, c("p"), two_step(0.12, 0.15), noun=axis.noun, headline=frac(F.max("p")))
    a.table = a.table.select("member", money(c("total")).alias("revenue"), money(c("peak")).alias("peak"), frac(c("p")).alias("peak_pct"),
                             "status", "severity")
    return a


def trough_vs_average(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis).withColumn(
        "p", F.when(c("mean") > 0, (c("mean") - c("trough")) / F.when(c("mean") > 0, c("mean"))).otherwise(0.0))
    a = per_row(d, c("p"), two_step(0.40, 0.60), noun=axis.noun, headline=frac(F.max("p")))
    a.table = a.table.select("member", frac(c("mean")).alias("mean"), money(c("trough")).alias("trough"), frac(c("p")).alias("drop_pct"),
                             "status", "severity")
    return a


def current_vs_trough(cube: Cube, axis: Axis) -> Analysis:
    d = _members(cube, axis).withColumn(
        "p", F.when(c("trough") > 0, (c("current") - c("trough")) / F.when(c("trough") > 0, c("trough"))).otherwise(0.0))
    a = per_row(d, c("p"), falling(0.30, 0.15), noun=axis.noun, headline=frac(F.min("p")))
    a.table = a.table.select("member", money(c("current")).alias("current"), money(c("trough")).alias("trough"),
                             frac(c("p")).alias("buffer_pct"), "status", "severity")
    return a


def volatility_weighted_exposure(cube: Cube, axis: Axis, amber: float = 250000, red: float = 500000) -> Analysis:
    d = _members(cube, axis)
    weight = F.when(c("pt_ratio").isNull(), 1.0).otherwise((c("pt_ratio") - 1) / F.greatest(c("pt_ratio"), F.lit(1.0)))
    d = d.withColumn("w", c("total") * weight)
    table = d.select("member", money(c("total")).alias("revenue"), money(c("pt_ratio")).alias("pt_ratio"), money(c("w")).alias("exposure"))
    facts = d.agg(F.sum("w").alias("w"))
    return single(table, facts, c("w"), two_step(amber, red), headline=money(c("w")), coi=money(c("w") / max(cube.n, 1)))


# --- company months --------------------------------------------------------------------


def _company(cube: Cube) -> DataFrame:
    return profile(cube.company(), cube)


def monthly_overview(cube: Cube) -> Analysis:
    d = _company(cube)
    table = d.select(money(c("peak")).alias("peak"), cube.label(c("peak_idx")).alias("peak_month"), money(c("trough")).alias("trough"),
                     cube.label(c("trough_idx")).alias("trough_month"), c("gap").alias("swing"), money(c("pt_ratio")).alias("pt_ratio"))
    return single(table, d, F.lit(0.0), NO_BANDS, headline=money(F.coalesce("pt_ratio", F.lit(1.0))))


def monthly_range(cube: Cube, amber: float = 50000, red: float = 100000) -> Analysis:
    table = cube.months().select("month", money(c("revenue")).alias("revenue"),
                                 F.round(S.peak(s()) - c("revenue"), 2).alias("vs_peak"))
    return single(table, _company(cube), c("gap"), two_step(amber, red), headline=c("gap"), coi=frac(c("gap") / max(cube.n, 1)))


def company_cv(cube: Cube) -> Analysis:
    d = _company(cube)
    table = d.select(frac(c("mean")).alias("mean"), money(S.stddev(s(), c("mean"))).alias("std_dev"), frac(c("cv")).alias("cv"))
    return single(table, d, c("cv"), two_step(0.15, 0.20), headline=frac(c("cv")))


def best_vs_worst_multiple(cube: Cube) -> Analysis:
    d = _company(cube)
    table = d.select(money(c("peak")).alias("best"), money(c("trough")).alias("worst"), frac(c("pt_ratio")).alias("multiple"))
    return single(table, d, c("pt_ratio"), two_step(1.5, 2.0), headline=money(F.coalesce("pt_ratio", F.lit(1.0))))


def months_below_average(cube: Cube) -> Analysis:
    mean = F.lit(cube.total / max(cube.n, 1))
    gap = frac(c("revenue") - mean)
    table = cube.months().select("month", money(c("revenue")).alias("revenue"), gap.alias("vs_average"),
                                 F.when(gap < 0, "Below Average").otherwise("Above Average").alias("state"),
                                 F.when(gap < 0, AMBER).otherwise(GREEN).alias("status"))
    facts = table.agg(F.count_if(c("state") == "Below Average").alias("k"))
    bands = two_step(math.ceil(round(cube.n * 0.55, 9)), math.ceil(round(cube.n * 0.70, 9)))
    return single(table, facts, c("k"), bands, headline=c("k"))


def trend_strength(cube: Cube, amber: float = -500, red: float = -2000) -> Analysis:
    facts = cube.company().select(F.coalesce(S.slope(s(), cube.n), F.lit(0.0)).alias("b"))
    table = facts.select(money(c("b")).alias("slope"), money(c("b") * cube.n).alias("projected"))
    return single(table, facts, c("b"), falling(amber, red), headline=money(c("b")), coi=money(F.when(c("b") < 0, -c("b"))))


def predictability(cube: Cube) -> Analysis:
    d = _company(cube).withColumn("p", F.greatest(F.lit(0.0), 1 - c("cv")))
    table = d.select(frac(c("cv")).alias("cv"), frac(c("p")).alias("predictability"))
    return single(table, d, c("p"), falling(0.85, 0.70), headline=frac(c("p")))


def acceleration(cube: Cube, amber: float = -2000, red: float = -10000) -> Analysis:
    facts = cube.company().select(F.round(S.last(s()) - S.last(s(), 1), 2).alias("now"),
                                  F.round(S.last(s(), 1) - S.last(s(), 2), 2).alias("before")).withColumn(
        "a", F.round(c("now") - c("before"), 2))
    table = facts.select(c("now").alias("latest_change"), c("before").alias("prior_change"), c("a").alias("acceleration"))
    return single(table, facts, when_long_enough(cube, 3, c("a")), falling(amber, red), headline=c("a"))


def peak_month_concentration(cube: Cube) -> Analysis:
    d = _company(cube).withColumn("p", F.when(c("total") > 0, c("peak") / F.when(c("total") > 0, c("total"))).otherwise(0.0))
    table = d.select(cube.label(c("peak_idx")).alias("peak_month"), money(c("peak")).alias("peak"), frac(c("p")).alias("peak_share"))
    return single(table, d, c("p"), two_step(0.12, 0.15), headline=frac(c("p")))
