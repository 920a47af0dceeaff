"""Concentration analyses: shares, HHI registers and ranked combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import frac, growth_rate, inaction_cost, money, one, ratio
from ..functions.live_series import s
from ..plans.thresholds import AMBER, GREEN, HIGH, NO_BANDS, RED, Threshold, two_step
from ..plans.verdict import Analysis, per_row, single
from .cube import CITY, GROUP, Axis, Cube
from .ranking import ranked
from .trend import direction_of


def total() -> Column:
    return F.col("total")


def _enough(value, count_col: str, least: int = 2):
    return F.when(F.col(count_col) >= least, value)


def _extremes(cube: Cube, axis: Axis) -> DataFrame:
    """One row: member count, largest and smallest total."""
    return cube.members(axis).agg(F.count(one()).alias("n"), F.max("total").alias("hi"), F.min("total").alias("lo"))


def equal_share_benchmark(cube: Cube, axis: Axis) -> Analysis:
    n = cube.member_count(axis)
    even = F.lit(cube.total / n) if n >= 2 else F.lit(None).cast("double")
    rows = cube.members(axis).select("member", "total", (total() - even).alias("d")).withColumn("r", ratio(F.col("d"), even))
    a = per_row(rows, F.abs("r"), "EQUAL_SHARE_DEVIATION", noun=axis.noun, headline=frac(F.max(even)))
    a.table = a.table.select("member", money(total()).alias("revenue"), frac(even).alias("benchmark"),
                             frac(F.col("d")).alias("deviation"), frac(F.col("r")).alias("deviation_pct"),
                             F.when(F.col("d") > 0, "ABOVE").otherwise("BELOW").alias("flag"), "status", "severity")
    return a


def ranking_scale_gap(cube: Cube, axis: Axis) -> Analysis:
    ext = _extremes(cube, axis)
    hi = ext.select("hi").scalar()
    table = ranked(cube.members(axis).select("member", "total"), "total", competition=True).select(
        "member", "rank", money(total()).alias("revenue"), frac(ratio(total(), F.lit(cube.total))).alias("share_pct"),
        frac(ratio(total(), hi)).alias("vs_largest"))
    multiple = _enough(ratio(F.col("hi"), F.col("lo")), "n")
    return single(table, ext, multiple, two_step(3, 5), headline=money(multiple))


def hhi_index(cube: Cube, axis: Axis) -> Analysis:
    share = ratio(total(), F.lit(cube.total))
    rows = cube.members(axis).select("member", "total", share.alias("sh"))
    table = rows.select("member", money(total()).alias("revenue"), frac(F.col("sh")).alias("share_pct"),
                        frac(F.col("sh") * F.col("sh")).alias("contribution"))
    facts = rows.agg(F.sum(F.col("sh") * F.col("sh")).alias("hhi"), F.count(one()).alias("n"))
    return single(table, facts, _enough(F.col("hhi") * F.col("n"), "n"), "HHI", headline=frac(F.col("hhi")))


def smallest_vs_largest(cube: Cube, axis: Axis) -> Analysis:
    ext = _extremes(cube, axis)
    table = cube.members(axis).select("member", money(total()).alias("revenue"),
                                      frac(ratio(total(), ext.select("hi").scalar())).alias("vs_largest"))
    part = ratio(F.col("lo"), F.col("hi"))
    return single(table, ext, _enough(1 - part, "n"), two_step(0.60, 0.80), headline=frac(part))


def growth_summary(cube: Cube, axis: Axis) -> Analysis:
    rows = cube.members(axis).select("member", S.at(s(), 0).alias("a"), S.last(s()).alias("b")).withColumn(
        "d", F.round(F.col("b") - F.col("a"), 2))
    table = rows.select("member", money(F.col("a")).alias("first"), money(F.col("b")).alias("last"), F.col("d").alias("change"),
                        frac(growth_rate(F.col("b"), F.col("a"))).alias("change_pct"),
                        direction_of(F.col("d")).alias("direction"),
                        F.when(F.col("d") < 0, AMBER).otherwise(GREEN).alias("status"))
    facts = rows.agg(F.count_if(F.col("d") < 0).alias("down"), F.count(one()).alias("n"),
                     F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0)).alias("lost"))
    metric = ratio(F.col("down").cast("double"), F.col("n")) if cube.n >= 2 else F.lit(None).cast("double")
    return single(table, facts, metric, "DECLINING_SHARE_OF_ENTITIES", headline=F.col("down"),
                  coi=frac(inaction_cost(-F.col("lost"))))


def average_per_period(cube: Cube, axis: Axis) -> Analysis:
    table = cube.members(axis).select("member", money(total()).alias("revenue"), frac(total() / max(cube.n, 1)).alias("average"),
                                      money(S.peak(s())).alias("best"), money(S.trough(s())).alias("worst"))
    facts = cube.company().select((total() / max(cube.n, 1)).alias("m"))
    return single(table, facts, F.lit(0.0), NO_BANDS, headline=frac(F.col("m")))


def multiple_of_smallest(cube: Cube, axis: Axis) -> Analysis:
    ext = _extremes(cube, axis)
    table = cube.members(axis).select("member", money(total()).alias("revenue"),
                                      money(ratio(total(), ext.select("lo").scalar())).alias("multiple"))
    multiple = _enough(ratio(F.col("hi"), F.col("lo")), "n")
    return single(table, ext, multiple, two_step(2.5, 4), headline=money(multiple))


def revenue_by_direction(cube: Cube, axis: Axis) -> Analysis:
    rows = cube.members(axis).select("member", "total", S.slope(s(), cube.n).alias("b"))
    way = F.when(F.col("b").isNull(), "Flat").otherwise(direction_of(F.col("b")))
    table = rows.select("member", money(total()).alias("revenue"), money(F.col("b")).alias("slope"), way.alias("direction"),
                        F.when(F.col("b") < 0, AMBER).otherwise(GREEN).alias("status"))
    facts = rows.agg(F.coalesce(F.sum(F.when(F.col("b") < 0, total())), F.lit(0.0)).alias("down"))
    weight = ratio(F.col("down"), F.lit(cube.total))
    metric = weight if cube.n >= 2 else F.lit(None).cast("double")
    return single(table, facts, metric, two_step(0.50, 0.70), headline=frac(weight))


def median_vs_mean(cube: Cube, axis: Axis) -> Analysis:
    facts = cube.members(axis).agg(F.count(one()).alias("n"), (F.sum("total") / F.count(one())).alias("mean"),
                                   F.percentile("total", F.lit(0.5)).alias("median"))
    skew = ratio(F.col("mean") - F.col("median"), F.abs("mean"))
    table = facts.select(frac(F.col("mean")).alias("mean"), frac(F.col("median")).alias("median"),
                         frac(F.col("mean") - F.col("median")).alias("difference"), frac(skew).alias("skew"))
    return single(table, facts, _enough(F.abs(skew), "n"), two_step(0.20, 0.40), headline=frac(skew))


QUARTILE_LABELS = ("Q1 Core", "Q2 Strong", "Q3 Developing", "Q4 Marginal")


def quartile_classification(cube: Cube, axis: Axis) -> Analysis:
    n = cube.member_count(axis)
    r = ranked(cube.members(axis).select("member", "total"), "total", competition=True).withColumn(
        "q", F.least(F.lit(4), F.floor((F.col("rank") - 1) * 4 / max(n, 1)).cast("int") + 1))
    table = r.select("member", "rank", money(total()).alias("revenue"), frac(ratio(total(), F.lit(cube.total))).alias("share_pct"),
                     F.element_at(F.array(*[F.lit(x) for x in QUARTILE_LABELS]), F.col("q")).alias("quartile"),
                     F.when(F.col("q") == 4, AMBER).otherwise(GREEN).alias("status"))
    facts = r.agg(F.coalesce(F.sum(F.when(F.col("q") == 4, total())), F.lit(0.0)).alias("bottom"), F.count(one()).alias("n"))
    share = ratio(F.col("bottom"), F.lit(cube.total))
    return single(table, facts, _enough(1 - share, "n"), two_step(0.85, 0.95), headline=frac(share))


# --- lens 9: HHI register -------------------------------------------------------------


def hhi_cells(cube: Cube, axis: Axis) -> DataFrame:
    """Register rows: the mean, over a member's live cells, of each cell's monthly HHI.

    A product's cells are its cities and a city's are its products; any other axis is
    its own cell. Averaging per cell keeps seasonality that would cancel in the sum.
    """
    return cube.kept(f"hhi:{axis.key}", lambda: _hhi_cells(cube, axis))


def _hhi_cells(cube: Cube, axis: Axis) -> DataFrame:
    members = cube.members(axis).withColumn("peak", S.peak(s())).select(
        *(["member"]), *axis.cols, "total", "peak", S.first_index_of(s(), F.col("peak")).alias("peak_idx"), "s")
    if axis.key in ("city", "group"):
        key = axis.cols[0]
        cells = cube.combos_with_series().select(key, S.hhi(s()).alias("h"))
        per = cells.groupBy(key).agg(F.avg("h").alias("hhi"), F.avg(1 / F.when(F.col("h") != 0, F.col("h"))).alias("div"))
        return members.join(per, key, "left")
    return members.withColumn("hhi", S.hhi(s())).withColumn("div", 1 / F.when(F.col("hhi") != 0, F.col("hhi")))


def _hhi_rows(cube: Cube, axis: Axis) -> DataFrame:
    rows = hhi_cells(cube, axis)
    return rows if cube.n >= 2 else rows.withColumn("hhi", F.lit(None).cast("double"))


def _hhi_facts(cube: Cube, axis: Axis) -> DataFrame:
    return _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).agg(
        F.count(one()).alias("n"), F.avg("hhi").alias("avg"), F.max("hhi").alias("hi"), F.min("hhi").alias("lo"),
        F.sum("hhi").alias("sum"), F.sum(F.col("total") * F.col("hhi")).alias("exposure"),
        F.count_if(F.col("hhi") > 0.10).alias("above10"), F.count_if(F.col("hhi") > 0.15).alias("above15"))


def hhi_register(cube: Cube, axis: Axis) -> Analysis:
    a = per_row(_hhi_rows(cube, axis), F.col("hhi") * cube.n, "HHI", noun=axis.noun,
                headline=F.count_if(F.col("status") == RED))
    a.table = a.table.select("member", money(total()).alias("revenue"), frac(F.col("hhi")).alias("hhi"),
                             money(F.col("div")).alias("diversification"), cube.label(F.col("peak_idx")).alias("peak_month"),
                             frac(ratio(F.col("peak"), total())).alias("peak_share"), "status", "severity")
    return a


def highest_hhi(cube: Cube, axis: Axis) -> Analysis:
    table = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).select(
        "member", frac(F.col("hhi")).alias("hhi"), cube.label(F.col("peak_idx")).alias("peak_month"),
        frac(ratio(F.col("peak"), total())).alias("peak_share"))
    return single(table, _hhi_facts(cube, axis), F.col("hi") * cube.n, "HHI_MEMBER_MAX", headline=frac(F.col("hi")))


def average_portfolio_hhi(cube: Cube, axis: Axis) -> Analysis:
    facts = _hhi_facts(cube, axis)
    avg = facts.select("avg").scalar()
    table = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).select(
        "member", frac(F.col("hhi")).alias("hhi"), frac(F.col("hhi") - avg).alias("vs_average"))
    return single(table, facts, F.col("avg") * cube.n, "HHI_PORTFOLIO_AVERAGE", headline=frac(F.col("avg")))


def hhi_spread(cube: Cube, axis: Axis) -> Analysis:
    facts = _hhi_facts(cube, axis)
    hi, lo = facts.select("hi").scalar(), facts.select("lo").scalar()
    position = F.when(F.col("hhi") == hi, "Most concentrated").when(F.col("hhi") == lo, "Most diversified").otherwise("-")
    table = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).select(
        "member", frac(F.col("hhi")).alias("hhi"), position.alias("position"))
    gap = F.when(F.col("n") >= 2, F.col("hi") - F.col("lo"))
    return single(table, facts, gap * cube.n, "HHI_SPREAD", headline=frac(gap))


def above_hhi_limit(cube: Cube, axis: Axis, limit: float = 0.10) -> Analysis:
    rows = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull())
    over = F.col("hhi") > limit
    table = rows.select("member", frac(F.col("hhi")).alias("hhi"), money(total()).alias("revenue"),
                        F.when(over, "Yes").otherwise("No").alias("flag"),
                        F.when(over, AMBER).otherwise(GREEN).alias("status"))
    facts = rows.agg(F.count(one()).alias("n"), F.count_if(over).alias("k"), F.count_if(F.col("hhi") > 0.15).alias("severe"))
    # A single member above 0.15 makes the block RED whatever the head count: 2.0 is
    # out of a proportion's range and stands for "severe member present".
    part = ratio(F.col("k").cast("double"), F.col("n"))
    metric = F.when(F.col("severe") > 0, F.lit(2.0)).otherwise(part)
    bands = Threshold(((0.5, AMBER, "MEDIUM"), (2.0, RED, HIGH)))
    return single(table, facts, metric, bands, headline=F.col("k"))


def most_diversified(cube: Cube, axis: Axis) -> Analysis:
    table = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).select(
        "member", frac(F.col("hhi")).alias("hhi"), money(F.col("div")).alias("diversification"), money(total()).alias("revenue"))
    return single(table, _hhi_facts(cube, axis), F.col("lo") * cube.n, "HHI", headline=frac(F.col("lo")))


def hhi_weighted_exposure(cube: Cube, axis: Axis) -> Analysis:
    facts = _hhi_facts(cube, axis)
    rows = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull())
    table = rows.select("member", money(total()).alias("revenue"), frac(F.col("hhi")).alias("hhi"),
                        money(total() * F.col("hhi")).alias("exposure"))
    avg = facts.select("avg").scalar()
    counted = rows.agg(F.count_if(F.col("hhi") > avg).alias("k"), F.count(one()).alias("n"),
                       F.sum(total() * F.col("hhi")).alias("exposure"))
    return single(table, counted, ratio(F.col("k").cast("double"), F.col("n")), "HHI_ABOVE_AVERAGE", headline=F.col("k"),
                  coi=money(F.when(F.col("exposure") != 0, F.col("exposure") / 4)))


def diversification_gap(cube: Cube, axis: Axis) -> Analysis:
    even = F.lit(1.0 / max(cube.n, 1))
    table = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).select(
        "member", frac(F.col("hhi")).alias("hhi"), frac(even).alias("ideal"), frac(F.col("hhi") - even).alias("gap"),
        F.when(F.col("hhi") - even > 0.15, AMBER).otherwise(GREEN).alias("status"))
    spread = ratio(F.col("hi"), F.col("lo"))
    return single(table, _hhi_facts(cube, axis), spread, "HHI_MAX_MIN_RATIO", headline=frac(spread))


def concentration_health(cube: Cube, axis: Axis) -> Analysis:
    facts = _hhi_facts(cube, axis)
    even = F.lit(1.0 / max(cube.n, 1))
    raw = 100 - F.col("above10") * 10 - (F.col("hi") - even) * 500
    score = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    table = facts.select(frac(F.col("avg")).alias("average_hhi"), frac(F.col("hi")).alias("highest_hhi"),
                         frac(even).alias("ideal"), F.col("above10").alias("members_above"), F.round(score, 4).alias("score"))
    return single(table, facts, 100 - score, "HHI_HEALTH_SHORTFALL", headline=F.round(score, 4))


def concentration_improvement(cube: Cube, axis: Axis) -> Analysis:
    even = F.lit(1.0 / max(cube.n, 1))
    rows = _hhi_rows(cube, axis).filter(F.col("hhi").isNotNull()).withColumn("m", total() / max(cube.n, 1)).withColumn(
        "short", S.sum_over_months(s(), lambda x: F.greatest(F.col("m") - x, F.lit(0.0))))
    table = rows.select("member", frac(F.col("hhi")).alias("hhi"), frac(F.col("hhi") - even).alias("excess"),
                        frac(F.col("m")).alias("average"), money(F.col("short")).alias("shortfall"))
    facts = rows.agg(F.sum("hhi").alias("h"), F.count(one()).alias("n"), F.sum("short").alias("p")).withColumn(
        "x", F.col("h") - even * F.col("n"))
    return single(table, facts, F.col("x") * cube.n, "HHI_EXCESS_TOTAL", headline=frac(F.col("x")),
                  coi=money(F.when(F.col("p") != 0, F.col("p") / 4)))


# --- lens 10: ranked combinations ------------------------------------------------------


def combo_order() -> list:
    return [F.desc("total"), F.asc("grp"), F.asc("city")]


def top_combos(cube: Cube, n: int) -> DataFrame:
    """The n strongest live combos, numbered. The sort is a distributed top-n; the window sees n rows."""
    top = cube.combos().orderBy(*combo_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*combo_order())).cast("bigint"))


def top_n_combos(cube: Cube, n: int = 3, threshold: str = "TOP3_CONCENTRATION") -> Analysis:
    shown = top_combos(cube, max(n, 10))
    run = F.sum("total").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.lit(cube.total)
    table = shown.select("rank", F.col("member").alias("combo"), money(total()).alias("revenue"),
                         frac(ratio(total(), whole)).alias("share_pct"), frac(ratio(run, whole)).alias("cumulative"))
    facts = cube.combos().orderBy(*combo_order()).limit(n).agg(F.sum("total").alias("t"))
    share = ratio(F.col("t"), whole)
    return single(table, facts, share, threshold, headline=frac(share))


def adjacent_dropoff(cube: Cube) -> Analysis:
    top = top_combos(cube, 10).withColumn("next", F.lead("total").over(Window.orderBy("rank")))
    drop = total() - F.col("next")
    rows = top.withColumn("drop", drop).withColumn("r", ratio(drop, total()))
    table = rows.select("rank", F.col("member").alias("combo"), money(total()).alias("revenue"), money(F.col("drop")).alias("drop"),
                        frac(F.col("r")).alias("drop_pct"))
    facts = rows.agg(F.max(F.when(F.col("rank") == 1, F.col("r"))).alias("r"))
    return single(table, facts, F.col("r"), two_step(0.25, 0.50), headline=frac(F.col("r")))


def representation_in_top_n(cube: Cube, n: int = 5, facet: str = "city") -> Analysis:
    axis = GROUP if facet == "group" else CITY
    key = axis.cols[0]
    top = cube.combos().orderBy(*combo_order()).limit(n).groupBy(key).agg(
        F.count(one()).alias("k"), F.sum("total").alias("t"))
    rows = cube.all_members(axis).select("member", key).join(top, key, "left")
    table = rows.select("member", F.coalesce("k", F.lit(0)).cast("bigint").alias("appearances"),
                        money(F.coalesce("t", F.lit(0.0))).alias("revenue"),
                        F.when(F.col("k").isNotNull(), GREEN).otherwise(AMBER).alias("status"))
    facts = rows.agg(F.count("k").alias("present"), F.count(one()).alias("n"))
    metric = 1 - ratio(F.col("present").cast("double"), F.col("n"))
    return single(table, facts, metric, two_step(0.50, 0.70), headline=F.col("present"))


def rank_gap(cube: Cube, high: int = 1, low: int = 10) -> Analysis:
    top = top_combos(cube, low)
    table = top.select("rank", F.col("member").alias("combo"), money(total()).alias("revenue"))
    facts = top.agg(F.max(F.when(F.col("rank") == high, total())).alias("h"), F.max_by("total", "rank").alias("l"),
                    F.count(one()).alias("n"))
    multiple = _enough(ratio(F.col("h"), F.col("l")), "n")
    return single(table, facts, multiple, two_step(5, 10), headline=money(multiple))


def dominance_in_top_n(cube: Cube, n: int = 5, facet: str = "city") -> Analysis:
    key = (GROUP if facet == "group" else CITY).cols[0]
    top = cube.combos().orderBy(*combo_order()).limit(n)
    whole = top.agg(F.sum("total")).scalar()
    rows = top.groupBy(F.col(key).alias("member")).agg(F.sum("total").alias("t"), F.count(one()).alias("combos")).withColumn(
        "sh", ratio(F.col("t"), whole))
    table = rows.select("member", money(F.col("t")).alias("revenue"), frac(F.col("sh")).alias("share_pct"), "combos")
    facts = rows.agg(F.max("sh").alias("m"))
    return single(table, facts, F.col("m"), two_step(0.50, 0.70), headline=frac(F.col("m")))


def tail_risk(cube: Cube, head: int = 5) -> Analysis:
    whole = F.lit(cube.total)
    r = ranked(cube.combos(), "total", ("grp", "city"))
    table = r.filter(F.col("rank") > head).select("rank", F.col("member").alias("combo"), money(total()).alias("revenue"),
                                                  frac(ratio(total(), whole)).alias("share_pct"))
    top = cube.combos().orderBy(*combo_order()).limit(head).agg(F.sum("total")).scalar()
    facts = cube.combos().agg((F.sum("total") - top).alias("tail"), F.count(one()).alias("n"))
    share = F.when(F.col("n") > head, ratio(F.col("tail"), whole))
    return single(table, facts, 1 - share, two_step(0.75, 0.85), headline=frac(share))
