"""City x product coverage: dependency, breadth, balance and gaps in the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import frac, money, one, ratio
from ..plans.thresholds import AMBER, GREEN, MEDIUM, NO_BANDS, Threshold, amber_only, falling, two_step
from ..plans.verdict import Analysis, per_row, single
from .concentration import combo_order
from .cube import CITY, GROUP, Axis, Cube
from .ranking import ranked

c = F.col


def _counterparts(cube: Cube, axis: Axis) -> DataFrame:
    """member, revenue and, over its live counterparts: how many, leader, highest, lowest, sum of squares."""
    mine, other = axis.cols[0], ("grp" if axis.key == "city" else "city")
    live = cube.combos().groupBy(c(mine).alias("member")).agg(
        F.count(one()).alias("active"),
        F.min_by(other, F.struct(-c("total"), c(other))).alias("leader"),
        F.max("total").alias("hi"),
        F.min("total").alias("lo"),
        F.sum(c("total") * c("total")).alias("sq"))
    return cube.members(axis).select("member", c("total").alias("revenue")).join(live, "member", "left")


def dependency_risk(cube: Cube, axis: Axis) -> Analysis:
    d = _counterparts(cube, axis).withColumn("p", ratio(c("hi"), c("revenue")))
    a = per_row(d, c("p"), "SINGLE_ENTITY_DEPENDENCY", noun=axis.noun, headline=frac(F.max("p")))
    a.table = a.table.select("member", money(c("revenue")).alias("revenue"), "active", "leader", frac(c("p")).alias("dependency_pct"),
                             "status", "severity")
    return a


def portfolio_strength(cube: Cube, axis: Axis) -> Analysis:
    d = _counterparts(cube, axis).withColumn("strength", c("revenue") * c("active"))
    table = d.select("member", money(c("revenue")).alias("revenue"), "active", money(c("strength")).alias("strength"),
                     frac(c("revenue") / c("active")).alias("avg_per_product"))
    facts = d.agg(F.max("strength").alias("m"), F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, 0.0), NO_BANDS, headline=money(c("m")))


def revenue_parity(cube: Cube, axis: Axis) -> Analysis:
    n = max(cube.member_count(axis), 1)
    sh = ratio(c("total"), F.lit(cube.total))
    rows = cube.members(axis).select("member", "total", sh.alias("sh"))
    table = rows.select("member", money(c("total")).alias("revenue"), frac(c("sh")).alias("share_pct"),
                        frac(c("sh") - F.lit(1.0 / n)).alias("vs_equal_share"))
    facts = rows.agg(F.max("sh").alias("m"))
    return single(table, facts, c("m"), amber_only(0.30), headline=frac(c("m")))


def range_within(cube: Cube, axis: Axis) -> Analysis:
    d = _counterparts(cube, axis).withColumn("gap", F.round(c("hi") - c("lo"), 2)).withColumn("p", ratio(c("gap"), c("hi")))
    a = per_row(d, F.when(c("active") >= 2, c("p")), amber_only(0.40), noun=axis.noun, headline=frac(F.max("p")))
    a.table = a.table.select("member", money(c("hi")).alias("highest"), money(c("lo")).alias("lowest"), "gap",
                             frac(c("p")).alias("gap_pct"), "status", "severity")
    return a


def coverage_gap(cube: Cube, axis: Axis) -> Analysis:
    other = GROUP if axis.key == "city" else CITY
    possible = cube.all_members(other).count()
    live = cube.combos().groupBy(c(axis.cols[0]).alias("member")).agg(F.count(one()).alias("active"))
    rows = cube.all_members(axis).select("member").join(live, "member", "left").select(
        "member", F.coalesce("active", F.lit(0)).cast("bigint").alias("active"))
    cover = c("active") / F.lit(float(max(possible, 1)))
    table = rows.select("member", "active", F.lit(possible).cast("bigint").alias("possible"), frac(cover).alias("coverage_pct"))
    facts = rows.agg(F.sum("active").alias("a"), (F.count(one()) * possible).alias("p"))
    m = 1 - ratio(c("a").cast("double"), c("p"))
    return single(table, facts, m, "COVERAGE_GAP", headline=frac(m))


def largest_single_combo(cube: Cube) -> Analysis:
    top = cube.combos().orderBy(*combo_order()).limit(1).withColumn("sh", ratio(c("total"), F.lit(cube.total)))
    table = top.select(c("member").alias("combo"), money(c("total")).alias("revenue"), frac(c("sh")).alias("share_pct"))
    return single(table, top.agg(F.max("sh").alias("m")), c("m"), two_step(0.20, 0.30), headline=frac(c("m")))


def cross_ranking(cube: Cube, axis: Axis) -> Analysis:
    table = ranked(cube.members(axis).select("member", "total"), "total", competition=True).select(
        "member", money(c("total")).alias("revenue"), "rank")
    facts = cube.members(axis).agg(F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, 0.0), NO_BANDS, headline=c("n"))


def cross_diversification(cube: Cube, axis: Axis) -> Analysis:
    """City: HHI over its products. Product: in how many cities it sells (fewer is worse)."""
    d = _counterparts(cube, axis).withColumn("h", ratio(c("sq"), c("revenue") * c("revenue")))
    if axis.key == "city":
        a = per_row(d, c("h"), two_step(0.5, 0.7), noun=axis.noun, headline=frac(F.max("h")))
    else:
        a = per_row(d, c("active"), falling(2.5, 1.5), noun=axis.noun, headline=F.min("active"))
    a.table = a.table.select("member", "active", frac(c("h")).alias("hhi"),
                             money(1 / F.when(c("h") != 0, c("h"))).alias("effective"), "status", "severity")
    return a


def dominant_counterpart(cube: Cube, axis: Axis) -> Analysis:
    mine, other = axis.cols[0], ("grp" if axis.key == "city" else "city")
    second = ranked(cube.combos(), "total", (other,), (mine,)).filter(c("rank") == 2).select(
        c(mine).alias("member"), c("total").alias("second"))
    d = _counterparts(cube, axis).join(second, "member", "left")
    table = d.select("member", "leader", money(c("hi")).alias("leader_revenue"), F.round(c("hi") - c("second"), 2).alias("lead"),
                     frac(ratio(c("hi"), c("revenue"))).alias("dominance_ratio"))
    facts = d.agg(F.countDistinct("leader").alias("k"), F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, 0.0), NO_BANDS, headline=c("k"))


def bottom_combos(cube: Cube, n: int = 3) -> Analysis:
    low = cube.combos().orderBy(F.asc("total"), "grp", "city").limit(n)
    avg = cube.combos().agg((F.sum("total") / F.count(one())).alias("a"), F.min("total").alias("lo"))
    table = low.select(c("member").alias("combo"), money(c("total")).alias("revenue"),
                       frac(ratio(c("total"), avg.select("a").scalar())).alias("of_average"))
    m = ratio(c("lo"), c("a"))
    return single(table, avg, m, Threshold(((0.25, AMBER, MEDIUM),), lower_is_worse=True), headline=money(c("lo")))


def share_within(cube: Cube, axis: Axis) -> Analysis:
    mine, other = axis.cols[0], ("grp" if axis.key == "city" else "city")
    owner = cube.members(axis).select(c(axis.cols[0]), c("total").alias("whole"))
    rows = cube.combos().join(owner, mine).withColumn("sh", ratio(c("total"), c("whole")))
    table = rows.select(c(mine).alias("member"), c(other).alias("counterpart"), money(c("total")).alias("revenue"),
                        frac(c("sh")).alias("share_pct"))
    facts = rows.agg(F.max("sh").alias("m"))
    return single(table, facts, F.when(c("m").isNotNull(), 0.0), NO_BANDS, headline=frac(c("m")))


def contribution_skew(cube: Cube, axis: Axis = GROUP, limit: float = 0.50) -> Analysis:
    """Counterpart members (cities, for products) where one entry holds over half the revenue."""
    base = CITY if axis.key == "group" else GROUP
    d = _counterparts(cube, base).withColumn("p", ratio(c("hi"), c("revenue")))
    over = F.coalesce(c("p") > limit, F.lit(False))
    table = d.select("member", "leader", frac(c("p")).alias("highest_pct"), F.when(over, "Yes").otherwise("No").alias("concentrated"),
                     F.when(over, AMBER).otherwise(GREEN).alias("status"))
    facts = d.agg(F.count_if(over).alias("k"), F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, c("k")), amber_only(2), headline=c("k"))


def classify_by_share(cube: Cube, axis: Axis) -> Analysis:
    sh = ratio(c("total"), F.lit(cube.total))
    rows = cube.members(axis).select("member", "total", sh.alias("sh"))
    tier = F.when(c("sh") > 0.20, "Core").when(c("sh") >= 0.10, "Support").otherwise("Marginal")
    table = rows.select("member", money(c("total")).alias("revenue"), frac(c("sh")).alias("share_pct"), tier.alias("tier"))
    facts = rows.agg(F.count_if(c("sh") > 0.20).alias("k"), F.count(one()).alias("n"))
    return single(table, facts, F.when(c("n") > 0, 0.0), NO_BANDS, headline=c("k"))
