"""The management report views: item grain, month names, gross amounts, trailing streaks.

These read the same fact table as the monthly cube but with the report's own rules: a
month is its name (all years together, twelve at most), amounts are not netted, the
decline streak is the one still open at the end, and ranks are ordinal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.numeric import ratio
from .cube import CITY, COMPANY, ITEM, Axis, dense_series, month_number
from .ranking import ranked

c = F.col
MONTHS = "January February March April May June July August September October November December".split()
COMBO = Axis("item_city", ("item", "city"), "combinations", "Item x City")

# Report thresholds.
STREAK, DEPENDENT, SCALE_GAP = 3, 75.0, 30.0
STRONG, WEAK, MONTH_STRONG, MONTH_WEAK = 2.0, 5.0, 4.0, 10.0
HHI_MODERATE, HHI_HIGH = 0.50, 0.80
PARETO = {1: 15.0, 3: 40.0, 5: 60.0}
MATERIAL = 15.0


def s() -> Column:
    return c("s")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage share, 0 where the whole is zero."""
    return F.round(F.coalesce(ratio(part, whole), F.lit(0.0)) * 100, digits)


@dataclass
class MisCube:
    """``cells``: city, item, idx (position among the months present), amount."""

    facts: DataFrame
    cells: DataFrame
    months: list[int]
    totals: list[float]
    measure: str
    _frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.months)

    @property
    def total(self) -> float:
        return round(sum(self.totals), 2)

    def month(self, idx: Column) -> Column:
        return F.get(F.array(*[F.lit(MONTHS[m - 1]) for m in self.months]), idx)

    def members(self, axis: Axis) -> DataFrame:
        if axis.key not in self._frames:
            self._frames[axis.key] = dense_series(self.cells, axis, self.n).persist()
        return self._frames[axis.key]

    def combos(self) -> DataFrame:
        return self.members(COMBO).select("member", "item", "city", "total")

    def month_rows(self) -> DataFrame:
        return self.members(COMPANY).select(F.posexplode("s").alias("idx", "revenue"), "total").select("idx", self.month(c("idx")).alias("month"), "revenue", "total")


def mis_cube(facts: DataFrame, measure: str = "amount") -> MisCube:
    """Roll facts up to item x city x month name; empty and zero rows are dropped. Twelve rows reach the driver."""
    num = F.month("voucher_date")
    if "month_num" in facts.columns or "month_name" in facts.columns:
        name = c("month_name") if "month_name" in facts.columns else F.lit(None).cast("string")
        given = c("month_num") if "month_num" in facts.columns else F.lit(None).cast("int")
        num = F.coalesce(month_number(name, given), num)
    rows = facts.withColumn("_m", num).filter(c(measure).isNotNull() & (c(measure) != 0) & c("_m").isNotNull())
    base = rows.groupBy("city", "item", "_m").agg(F.sum(measure).alias("amount")).persist()
    found = {r["_m"]: float(r["amount"]) for r in base.groupBy("_m").agg(F.sum("amount").alias("amount")).collect()}
    months = sorted(found)
    idx = (F.array_position(F.array(*[F.lit(m) for m in months]), c("_m")) - 1).cast("int") if months else F.lit(0)
    cells = base.select("city", "item", idx.alias("idx"), "amount")
    return MisCube(facts, cells, months, [found[m] for m in months], measure)


def mis_matrix(cube: MisCube) -> DataFrame:
    return cube.cells.select("item", "city", cube.month(c("idx")).alias("month"), c("amount").cast("double").alias("amount"))


def mis_summary(cube: MisCube, vouchers: DataFrame) -> DataFrame:
    """Net, gross (each voucher header once), charges, and how many distinct things were sold where."""
    key = [x for x in ("company_id", "voucher_id") if x in cube.facts.columns and x in vouchers.columns]
    gross = vouchers.select(*key, "amount").join(cube.facts.select(*key), key, "left_semi").groupBy(*key).agg(
        F.max("amount").alias("amount")).agg(F.sum("amount").cast("double")).scalar()
    own = cube.facts.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("net"), F.countDistinct(*key).alias("vouchers"),
                         F.countDistinct("customer").alias("customers"), F.count(F.lit(1)).alias("rows"))
    items = cube.members(ITEM).agg(F.count(F.lit(1))).scalar()
    cities = cube.members(CITY).agg(F.count(F.lit(1))).scalar()
    return own.withColumn("gross", F.greatest(gross, c("net"))).withColumn("charges", F.round(c("gross") - c("net"), 2)).withColumn(
        "items", items).withColumn("cities", cities).withColumn("months", F.lit(cube.n).cast("bigint"))


def _trend(df: DataFrame, cube: MisCube) -> DataFrame:
    d = df.withColumn("streak", S.decline_streak(s())["run"].cast("bigint")).withColumn("b", F.coalesce(S.slope(s(), cube.n), F.lit(0.0)))
    return d.withColumn("sustained", (c("streak") >= STREAK) | (c("b") < 0))


def city_trend(cube: MisCube) -> DataFrame:
    """open decline streak, slope, what the streak cost and what returning to the best month would bring."""
    d = _trend(cube.members(CITY), cube).withColumn("base", F.get("s", (F.size("s") - 1 - c("streak")).cast("int")))
    lost = F.aggregate(F.slice("s", (F.size("s") - c("streak") + 1).cast("int"), F.greatest(c("streak"), F.lit(1)).cast("int")), F.lit(0.0),
                       lambda a, x: a + F.greatest(c("base") - x, F.lit(0.0)))
    reach = (F.greatest(S.peak(s()), F.lit(0.0)) - S.last(s())) * F.when(c("streak") > 0, c("streak")).otherwise(3)
    return d.select("member", F.round("total", 2).alias("revenue"), pct(c("total"), F.lit(cube.total)).alias("share_pct"), "streak", F.round("b", 2).alias("slope"),
                    "sustained", F.round(F.when(c("streak") > 0, lost).otherwise(0.0), 2).alias("cost_of_inaction"),
                    F.round(F.greatest(reach, F.lit(0.0)), 2).alias("opportunity"))


def city_totals(cube: MisCube) -> DataFrame:
    m = cube.members(CITY)
    n = m.agg(F.count(F.lit(1))).scalar()
    even = F.round(F.lit(cube.total) / n, 2)
    return m.select("member", F.round("total", 2).alias("revenue"), pct(c("total"), F.lit(cube.total)).alias("share_pct"), even.alias("benchmark"),
                    (c("total") > even).alias("above"), F.round(c("total") - even, 2).alias("variance"))


def historical_benchmark(facts: DataFrame, window_start: date, cities: int = 1) -> DataFrame:
    """Sales in the 3, 6 and 12 months before the window: total, per active month, per city."""
    first = F.trunc(F.lit(window_start), "MM")
    rows = []
    past = facts.filter((c("voucher_date") < first) & (c("voucher_date") >= F.add_months(first, -12)))
    signed = F.when(c("is_return"), -c("amount")).otherwise(c("amount")) if "is_return" in facts.columns else c("amount")
    month = F.trunc("voucher_date", "MM")
    per = past.groupBy(month.alias("m")).agg(F.sum(signed).alias("v"))
    for span in (3, 6, 12):
        inside = per.filter(c("m") >= F.add_months(first, -span))
        rows.append(inside.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("revenue"), F.count(F.lit(1)).alias("k")).select(
            F.lit(span).cast("bigint").alias("months_back"), "revenue", F.when(c("k") > 0, c("k")).otherwise(span).cast("bigint").alias("active_months")))
    out = reduce(DataFrame.unionByName, rows)
    avg = c("revenue") / c("active_months")
    return out.withColumn("avg_monthly", F.round(avg, 2)).withColumn("avg_per_city", F.round(avg / max(cities, 1), 2))


def _dominant(cube: MisCube, own: Axis, other: str) -> DataFrame:
    key = own.cols[0]
    live = cube.combos().filter(c("total") > 0).groupBy(c(key).alias("member")).agg(
        F.count(F.lit(1)).alias("active"), F.min_by(other, F.struct(-c("total"), c(other))).alias("dominant"), F.max("total").alias("hi"))
    d = cube.members(own).select("member", c("total").alias("revenue")).join(live, "member", "left")
    return d.select("member", F.round("revenue", 2).alias("revenue"), F.coalesce("active", F.lit(0)).cast("bigint").alias("active"), "dominant",
                    pct(F.coalesce("hi", F.lit(0.0)), c("revenue")).alias("dominant_pct")).withColumn("dependent", c("dominant_pct") >= DEPENDENT)


def item_total_by_city(cube: MisCube) -> DataFrame:
    return _dominant(cube, CITY, "item")


def item_contribution_share(cube: MisCube) -> DataFrame:
    return _dominant(cube, ITEM, "city")


def month_trend(cube: MisCube) -> DataFrame:
    company = _trend(cube.members(COMPANY), cube)
    return company.select(F.posexplode("s").alias("idx", "revenue"), "total", "streak", "b", "sustained").select(
        cube.month(c("idx")).alias("month"), F.round("revenue", 2).alias("revenue"), pct(c("revenue"), c("total")).alias("share_pct"), "streak",
        F.round("b", 2).alias("slope"), "sustained")


def month_trend_by_city(cube: MisCube) -> DataFrame:
    return cube.members(CITY).select("member", F.posexplode("s").alias("idx", "revenue")).select(
        cube.month(c("idx")).alias("month"), c("member").alias("city"), F.round("revenue", 2).alias("revenue"))


def month_mix_by_item(cube: MisCube) -> DataFrame:
    d = _trend(cube.members(ITEM), cube).withColumn("hi", S.peak(s()))
    sold = c("hi") > 0
    return d.select("member", F.round("total", 2).alias("revenue"), F.when(sold, cube.month(S.first_index_of(s(), c("hi")))).alias("driver_month"),
                    F.round(F.when(sold, c("hi")).otherwise(0.0), 2).alias("driver_revenue"), "streak", F.round("b", 2).alias("slope"), "sustained",
                    pct(F.when(sold, c("hi")).otherwise(0.0), c("total")).alias("driver_pct"))


def _versus(cities: DataFrame, names: tuple[str, str], totals: tuple[float, float]) -> DataFrame:
    hi, lo = max(totals), min(totals)
    gap = round((hi - lo) * 100 / hi, 2) if hi else 0.0
    winner = F.when(c("a") > c("b"), F.lit(names[0])).when(c("b") > c("a"), F.lit(names[1])).otherwise("TIE")
    return cities.select("city", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round(c("a") - c("b"), 2).alias("variance"), winner.alias("winner"),
                         F.lit(gap).alias("gap_pct"), F.lit("WATCH" if gap > SCALE_GAP else "Comparable").alias("state"))


def item_head_to_head(cube: MisCube, a: str | None = None, b: str | None = None) -> DataFrame:
    """two items side by side (default: the two largest; at most three rows reach the driver)."""
    items = cube.members(ITEM).select("item", "total")
    top = items.orderBy(F.desc("total"), "item").limit(3).collect()
    given = {r["item"]: r["total"] for r in items.filter(c("item").isin([x for x in (a, b) if x] or [""])).collect()}
    first = (a, given[a]) if a in given else (top[0]["item"], top[0]["total"])
    rest = [(r["item"], r["total"]) for r in top if r["item"] != first[0]]
    second = (b, given[b]) if b in given and b != first[0] else (rest[0] if rest else first)
    zero = F.lit(0.0)
    sides = cube.combos().filter(c("item").isin(first[0], second[0])).groupBy("city").agg(
        F.coalesce(F.sum(F.when(c("item") == first[0], c("total"))), zero).alias("a"), F.coalesce(F.sum(F.when(c("item") == second[0], c("total"))), zero).alias("b"))
    rows = cube.members(CITY).select(c("member").alias("city")).join(sides, "city", "left").select("city", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    return _versus(rows, (first[0], second[0]), (first[1], second[1]))


def month_head_to_head(cube: MisCube, a: str | None = None, b: str | None = None) -> DataFrame:
    """two months city by city (default: the first two)."""
    names = [MONTHS[m - 1] for m in cube.months]
    i = names.index(a) if a in names else 0
    j = names.index(b) if b in names and b != names[i] else next((k for k in range(cube.n) if k != i), i)
    rows = cube.members(CITY).select(c("member").alias("city"), S.at(s(), i).alias("a"), S.at(s(), j).alias("b"))
    return _versus(rows, (names[i], names[j]), (cube.totals[i], cube.totals[j]))


def _strength(avg: Column, strong: float, weak: float) -> Column:
    return F.when(avg <= strong, "STRONG").when(avg >= weak, "WEAK").otherwise("MIXED")


def item_ranking_by_city(cube: MisCube) -> DataFrame:
    """average ordinal rank of every item over all cities, unsold items last in total order.

    The ranks of pairs that never sold are summed in closed form from counts (how many
    sell in a city, how many better-ordered items sell there), so only live pairs are read.
    """
    live = cube.combos().filter(c("total") > 0).select("item", "city", "total")
    cities = cube.members(CITY).agg(F.count(F.lit(1))).scalar()
    held = live.groupBy("item").agg(F.count(F.lit(1)).alias("sold_in"))
    items = cube.members(ITEM).select("item", c("total").alias("revenue")).join(held, "item", "left").withColumn("sold_in", F.coalesce("sold_in", F.lit(0)))
    order = ranked(items, "revenue", ("item",), name="o", running="sold_in").withColumn("before", c("sold_in_running") - c("sold_in"))
    per_city = live.groupBy("city").agg(F.count(F.lit(1)).alias("sellers"))
    cells = live.join(order.select("item", "o"), "item").join(per_city, "city")
    cells = ranked(ranked(cells, "total", ("o",), ("city",), name="r"), "o", (), ("city",), name="pos", ascending=True)
    sums = cells.groupBy("item").agg(F.sum("r").alias("sum_r"), F.sum("sellers").alias("sum_sellers"), F.sum(c("pos") - 1).alias("sum_before"))
    all_sellers = per_city.agg(F.sum("sellers")).scalar()
    j = order.join(sums, "item", "left")
    z = F.lit(0)
    absent = cities - c("sold_in")
    rank_sum = (F.coalesce("sum_r", z) + (all_sellers - F.coalesce("sum_sellers", z)) + absent * c("o") - (c("before") - F.coalesce("sum_before", z)))
    avg = F.round(rank_sum / cities, 2)
    return j.select(c("item").alias("member"), F.round("revenue", 2).alias("revenue"), avg.alias("avg_rank"), _strength(avg, STRONG, WEAK).alias("state"))


def month_ranking_by_city(cube: MisCube) -> DataFrame:
    """ordinal rank of the (at most twelve) months inside each city, averaged."""
    ranks = F.transform("s", lambda v, i: F.size(F.filter("s", lambda x, j: (x > v) | ((x == v) & (j < i)))) + 1)
    long = cube.members(CITY).select(F.posexplode(ranks).alias("idx", "r"))
    per = long.groupBy("idx").agg(F.round(F.avg("r"), 2).alias("avg_rank"))
    revenue = cube.month_rows().select("idx", "month", F.round("revenue", 2).alias("revenue"))
    return revenue.join(per, "idx").select("month", "revenue", "avg_rank", _strength(c("avg_rank"), MONTH_STRONG, MONTH_WEAK).alias("state"))


def concentration_hhi(cube: MisCube) -> DataFrame:
    """HHI of products and of cities, and every item's HHI over months."""
    risk = lambda h: F.when(h >= HHI_HIGH, "HIGH_RISK").when(h >= HHI_MODERATE, "MODERATE_RISK").otherwise("DIVERSIFIED")
    none = F.lit(None)

    def portfolio(axis: Axis, level: str) -> DataFrame:
        share = ratio(c("total"), F.lit(cube.total)) if cube.total > 0 else F.lit(0.0)
        d = cube.members(axis).agg(F.round(F.coalesce(F.sum(share * share), F.lit(0.0)), 4).alias("hhi"), F.count(F.lit(1)).alias("n"))
        return d.select(F.lit(level).alias("level"), F.lit("all").alias("name"), "hhi", F.when(c("n") == 1, "STRUCTURAL_MONOPOLY").otherwise(risk(c("hhi"))).alias("risk"),
                        none.cast("string").alias("dominant_month"), none.cast("double").alias("dominant_pct"))

    d = cube.members(ITEM).withColumn("h", F.round(F.coalesce(S.hhi(s()), F.lit(0.0)), 4)).withColumn("hi", S.peak(s()))
    items = d.select(F.lit("item").alias("level"), c("member").alias("name"), c("h").alias("hhi"), risk(c("h")).alias("risk"),
                     F.when(c("hi") > 0, cube.month(S.first_index_of(s(), c("hi")))).alias("dominant_month"), pct(F.greatest(c("hi"), F.lit(0.0)), c("total")).alias("dominant_pct"))
    return portfolio(ITEM, "product").unionByName(portfolio(CITY, "city")).unionByName(items)


def top_combos(cube: MisCube) -> DataFrame:
    """all positive combinations ranked, with cumulative share."""
    r = ranked(cube.combos().filter(c("total") > 0), "total", ("item", "city"), running="total")
    whole = F.lit(cube.total)
    return r.select("rank", c("member").alias("combo"), F.round("total", 2).alias("revenue"), pct(c("total"), whole).alias("share_pct"),
                    pct(c("total_running"), whole).alias("cumulative_pct"))


def top_combo_flags(cube: MisCube) -> DataFrame:
    top = cube.combos().filter(c("total") > 0).orderBy(F.desc("total"), "item", "city").limit(5)
    listed = top.agg(F.sort_array(F.collect_list("total"), asc=False).alias("t"))  # five values at most
    whole = F.lit(cube.total)
    out = listed
    for n, limit in PARETO.items():
        out = out.withColumn(f"top{n}_pct", pct(S.total(F.slice("t", 1, n)), whole)).withColumn(f"top{n}_flag", c(f"top{n}_pct") > limit)
    return out.drop("t")


def bridge_by_item(cube: MisCube, p1: list[str] | None = None, p2: list[str] | None = None) -> DataFrame:
    """change per item between two sets of months (default: first and second half)."""
    names = [MONTHS[m - 1] for m in cube.months]
    a = [names.index(x) for x in p1 or [] if x in names]
    b = [names.index(x) for x in p2 or [] if x in names]
    if not a or not b:
        half = cube.n // 2
        a, b = (list(range(half)), list(range(half, cube.n))) if cube.n >= 2 else ([0], [0])
    pick = lambda idx: F.aggregate(F.array(*[F.lit(i) for i in idx]), F.lit(0.0), lambda acc, i: acc + F.get("s", i))
    rows = cube.members(ITEM).select("member", F.round(pick(a), 2).alias("base"), F.round(pick(b), 2).alias("comparison")).withColumn(
        "delta", F.round(c("comparison") - c("base"), 2))
    whole = rows.agg(F.abs(F.round(F.sum("delta"), 2))).scalar()
    rows = rows.withColumn("share_pct", pct(c("delta"), whole))
    return rows.withColumn("red_flag", (c("delta") < 0) & (F.abs("share_pct") >= MATERIAL)).withColumn(
        "role", F.when(c("delta") > 0, "GROWTH_DRIVER").when(c("delta") < 0, "DRAG").otherwise("NEUTRAL"))


def bridge_by_month(cube: MisCube) -> DataFrame:
    return cube.month_rows().select("month", F.round("revenue", 2).alias("revenue"))


def _extremes(df: DataFrame, cube: MisCube) -> DataFrame:
    d = df.withColumn("hi", S.peak(s())).withColumn("lo", S.trough(s()))
    d = d.withColumn("collapsed", (c("lo") <= 0) & (c("hi") > 0))
    swing = F.when(c("lo") > 0, F.round(c("hi") / F.when(c("lo") > 0, c("lo")), 2)).when(~c("collapsed"), 1.0)
    return d.withColumn("pt_ratio", swing).withColumn("peak_month", cube.month(S.first_index_of(s(), c("hi")))).withColumn(
        "trough_month", cube.month(S.first_index_of(s(), c("lo")))).withColumn("swing", F.round(c("hi") - c("lo"), 2))


def peak_trough_by_item(cube: MisCube) -> DataFrame:
    """a zero trough has no ratio; it is marked collapsed and counts as RED."""
    d = _extremes(cube.members(ITEM), cube)
    state = F.when(c("collapsed") | (c("pt_ratio") >= 3.0), "RED").when(c("pt_ratio") >= 2.0, "AMBER").otherwise("GREEN")
    return d.select("member", "peak_month", F.round("hi", 2).alias("peak"), "trough_month", F.round("lo", 2).alias("trough"), "swing", "pt_ratio", "collapsed",
                    state.alias("status"))


def peak_trough_by_month(cube: MisCube) -> DataFrame:
    return _extremes(cube.members(COMPANY), cube).select(
        "peak_month", F.round("hi", 2).alias("peak"), "trough_month", F.round("lo", 2).alias("trough"), "swing", "pt_ratio")


def action_center(cube: MisCube) -> DataFrame:
    """Protocol rows. City: RED on an open streak of two (or one above 25% share), AMBER above 20%. Item: AMBER above 40%, GREEN above 15%."""
    whole = F.lit(cube.total)
    cities = cube.members(CITY).select(F.lit("city").alias("subject"), "member", "total", S.decline_streak(s())["run"].cast("bigint").alias("streak"), pct(c("total"), whole, 1).alias("share_pct"))
    level = F.when((c("streak") >= 2) | ((c("share_pct") > 25) & (c("streak") >= 1)), "RED").when(c("share_pct") > 20, "AMBER")
    items = cube.members(ITEM).select(F.lit("item").alias("subject"), "member", "total", F.lit(0).cast("bigint").alias("streak"), pct(c("total"), whole, 1).alias("share_pct"))
    item_level = F.when(c("share_pct") > 40, "AMBER").when(c("share_pct") > 15, "GREEN")
    found = items.withColumn("level", item_level).filter(c("level").isNotNull())
    greens = found.filter(c("level") == "GREEN").agg(F.count(F.lit(1))).scalar()
    anchor = items.orderBy(F.desc("total"), "member").limit(1).filter(greens == 0).withColumn("level", F.lit("GREEN"))
    out = cities.withColumn("level", level).filter(c("level").isNotNull()).unionByName(found).unionByName(anchor)
    return out.select("level", "subject", "member", F.round("total", 2).alias("exposure"), "streak", "share_pct")


def audit_reconciliation(cube: MisCube) -> DataFrame:
    """headline figures read from the fact rows next to the same figures read from the cube."""
    fact = cube.facts.filter(c(cube.measure) != 0)
    v, num = c(cube.measure), F.month("voucher_date")
    months = fact.groupBy(num.alias("m")).agg(F.sum(v).cast("double").alias("v")).filter(c("m").isNotNull())
    direct = months.agg(F.sum("v").alias("total"), F.min_by("v", "m").alias("start"), F.max_by("v", "m").alias("end"), F.max("v").alias("peak"),
                        F.min(F.when(c("v") > 0, c("v"))).alias("low"))
    top = lambda keys: fact.groupBy(*keys).agg(F.sum(v).cast("double").alias("v")).agg(F.max("v")).scalar()
    left = direct.select("*", top(["item"]).alias("top_item"), top(["city"]).alias("top_city"), top(["item", "city"]).alias("top_combo"))
    side = cube.members(COMPANY).select(c("total").alias("total"), S.at(s(), 0).alias("start"), S.last(s()).alias("end"), S.peak(s()).alias("peak"),
                                        F.array_min(F.filter(s(), lambda x: x > 0)).alias("low"))
    best = lambda axis: cube.members(axis).agg(F.max("total")).scalar()
    right = side.select("*", best(ITEM).alias("top_item"), best(CITY).alias("top_city"), best(COMBO).alias("top_combo"))
    names = ["total", "start", "end", "peak", "low", "top_item", "top_city", "top_combo"]
    melt = lambda d, tag: d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("figure"), c(n).alias(tag)) for n in names])))
    j = melt(left, "from_facts").join(melt(right, "from_cube"), "figure")
    gap = F.round(c("from_cube") - c("from_facts"), 2)
    return j.select("figure", F.round("from_facts", 2).alias("from_facts"), F.round("from_cube", 2).alias("from_cube"), gap.alias("variance"),
                    F.when(gap == 0, "PASS").otherwise("FAIL").alias("status"))


def executive_overview(cube: MisCube) -> DataFrame:
    """key figures, momentum, extremes, best and worst mover, top-3 combination share and the composite score."""
    total = F.lit(cube.total)
    last, prior, first = S.last(s()), (S.last(s(), 1) if cube.n > 1 else S.at(s(), 0)), S.at(s(), 0)
    base = cube.members(COMPANY).select(
        "total", F.lit(cube.n).cast("bigint").alias("months"), last.alias("latest"), prior.alias("prior"), first.alias("start"), "s")
    change = lambda a, b: F.round(F.coalesce(ratio(a - b, b), F.lit(0.0)) * 100, 1)
    recent = S.total(F.slice("s", F.greatest(F.size("s") - 2, F.lit(1)), F.lit(3)))
    before = S.total(F.slice("s", F.greatest(F.size("s") - 5, F.lit(1)), F.greatest(F.least(F.size("s") - 3, F.lit(3)), F.lit(0))))
    base = base.withColumn("period_change_pct", change(c("latest"), c("start"))).withColumn("r3", recent).withColumn("p3", before)
    positive = F.filter("s", lambda x: x > 0)
    base = base.withColumn("peak", F.greatest(F.array_max("s"), F.lit(0.0))).withColumn("trough", F.array_min(positive))

    def top(axis: Axis) -> DataFrame:
        return cube.members(axis).agg(F.max_by("member", F.struct("total", "member")).alias("name"), F.max("total").alias("v"))

    movers = cube.members(ITEM).select("member", F.round(S.last(s()) - (S.last(s(), 1) if cube.n > 1 else S.at(s(), 0)), 2).alias("d"))
    gain = movers.agg(F.max(F.struct("d", "member")).alias("g"), F.min(F.struct("d", "member")).alias("w"))
    streak = cube.members(CITY).agg(F.max(S.decline_streak(s())["run"])).scalar()
    top3 = cube.combos().filter(c("total") > 0).orderBy(F.desc("total"), "item", "city").limit(3).agg(F.sum("total")).scalar()
    item, city = top(ITEM), top(CITY)
    d = base.select(
        F.round("total", 2).alias("revenue"), F.round(c("total") / max(cube.n, 1), 2).alias("avg_monthly"), F.round("latest", 2).alias("latest"), F.round("prior", 2).alias("prior"),
        F.round(c("latest") - c("prior"), 2).alias("mom_change"), change(c("latest"), c("prior")).alias("mom_change_pct"), "period_change_pct",
        F.when(c("p3") == 0, c("period_change_pct")).otherwise(change(c("r3"), c("p3"))).alias("momentum_pct"), F.round("peak", 2).alias("peak"),
        cube.month(S.first_index_of(s(), c("peak"))).alias("peak_month"), F.round("trough", 2).alias("trough"),
        cube.month(S.first_index_of(s(), c("trough"))).alias("trough_month"),
        item.select("name").scalar().alias("top_item"), pct(item.select("v").scalar(), total, 1).alias("top_item_pct"),
        city.select("name").scalar().alias("top_city"), pct(city.select("v").scalar(), total, 1).alias("top_city_pct"),
        gain.select(F.when(c("g.d") > 0, c("g.member"))).scalar().alias("best_gain_item"), gain.select(F.greatest(c("g.d"), F.lit(0.0))).scalar().alias("best_gain"),
        gain.select(F.when(c("w.d") < 0, c("w.member"))).scalar().alias("worst_drag_item"), gain.select(F.least(c("w.d"), F.lit(0.0))).scalar().alias("worst_drag"),
        F.coalesce(streak, F.lit(0)).cast("bigint").alias("max_decline_streak"), pct(F.coalesce(top3, F.lit(0.0)), total, 1).alias("top3_combo_pct"))
    half_up = lambda x: F.floor(x + 0.5)
    clamp = lambda x: F.least(F.lit(100), F.greatest(F.lit(10), x))
    growth = clamp(half_up(50 + F.when(c("period_change_pct") > 0, c("period_change_pct") * 1.5).otherwise(c("period_change_pct") * 2)))
    runs = F.greatest(F.lit(0), 30 - c("max_decline_streak") * 6)
    swing = F.when(c("top_item_pct") > 50, 35).otherwise(60)
    spread = F.when(c("top3_combo_pct") > 50, 40).when(c("top3_combo_pct") > 30, 55).otherwise(70)
    return d.withColumn("growth_score", growth.cast("bigint")).withColumn("streak_score", runs.cast("bigint")).withColumn(
        "volatility_score", swing.cast("bigint")).withColumn("concentration_score", spread.cast("bigint")).withColumn(
        "composite_score", clamp(half_up((growth + runs + swing + spread) / 4)).cast("bigint"))


def what_changed(cube: MisCube) -> DataFrame:
    """F00 detail: each item's change from the prior to the latest month against the company's change."""
    prior = S.last(s(), 1) if cube.n > 1 else S.at(s(), 0)
    rows = cube.members(ITEM).select("member", F.round(prior, 2).alias("prior"), F.round(S.last(s()), 2).alias("latest")).withColumn(
        "change", F.round(c("latest") - c("prior"), 2))
    whole = abs(round(cube.totals[-1] - cube.totals[-2 if cube.n > 1 else 0], 2)) if cube.n else 0.0
    materiality = F.round(F.coalesce(ratio(F.abs("change") * 10, F.lit(cube.total)), F.lit(0.0)), 2)
    return rows.withColumn("share_pct", F.abs(pct(c("change"), F.lit(whole), 1))).withColumn("materiality", materiality).withColumn(
        "direction", F.when(c("change") >= 0, "up").otherwise("down"))


