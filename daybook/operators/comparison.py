"""Head-to-head pairs and rank matrices (products or months, city by city)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import frac, inaction_cost, money, null, one, ratio
from ..functions.live_series import s
from ..plans.thresholds import AMBER, GREEN, NO_BANDS, amber_only, two_step
from ..plans.verdict import Analysis, per_row, single
from .cube import CITY, GROUP, Cube, all_combos
from .ranking import ranked
from .trend import falls


@dataclass
class Pair:
    """Two entities side by side. ``rows``: city, a, b, city_total. Empty when fewer than two exist."""

    mode: str
    a: str
    b: str
    rows: DataFrame
    total_a: float
    total_b: float
    slopes: DataFrame | None

    @property
    def leader(self) -> str:
        return self.a if self.total_a >= self.total_b else self.b

    @property
    def trailer(self) -> str:
        return self.b if self.total_a >= self.total_b else self.a

    @property
    def high(self) -> float:
        return max(self.total_a, self.total_b)

    @property
    def low(self) -> float:
        return min(self.total_a, self.total_b)

    @property
    def valid(self) -> bool:
        return bool(self.a and self.b)


def _entities(cube: Cube, mode: str) -> DataFrame:
    if mode == "month":
        return cube.months().select(F.col("idx").cast("int").alias("key"), F.col("month").alias("label"),
                                    F.col("revenue").alias("total"), F.col("idx").cast("double").alias("ord"))
    return cube.all_members(GROUP).select(F.col("grp").alias("key"), F.col("grp").alias("label"), "total",
                                          (-F.col("total")).alias("ord"))


def resolve_pair(cube: Cube, mode: str = "product", a: str | None = None, b: str | None = None) -> Pair:
    """The named pair, or by default the two largest entities (two rows reach the driver)."""
    ents = _entities(cube, mode)
    named = ents.filter(F.col("label").isin([x for x in (a, b) if x])) if (a or b) else ents.limit(0)
    chosen = {r["label"]: r for r in named.collect()}
    best = ents.orderBy(F.desc("total"), "ord", "label").limit(3).collect()
    pick_a = chosen.get(a) or next((r for r in best), None)
    pick_b = chosen.get(b) or next((r for r in best if pick_a is None or r["key"] != pick_a["key"]), None)
    if pick_a is None or pick_b is None:
        empty = cube.all_members(CITY).select("member").limit(0)
        rows = empty.select(F.col("member").alias("city"), null().alias("a"), null().alias("b"), null().alias("city_total"))
        return Pair(mode, "", "", rows, 0.0, 0.0, None)
    cities = cube.all_members(CITY).select(F.col("member").alias("city"), F.col("total").alias("city_total"), "s")
    zero = F.lit(0.0)
    slopes = None
    if mode == "month":
        rows = cities.select("city", S.at(s(), pick_a["key"]).alias("a"), S.at(s(), pick_b["key"]).alias("b"), "city_total")
    else:
        sides = cube.all_members(GROUP).filter(F.col("grp").isin(pick_a["key"], pick_b["key"]))
        slopes = sides.agg(F.max(F.when(F.col("grp") == pick_a["key"], S.slope(s(), cube.n))).alias("slope_a"),
                           F.max(F.when(F.col("grp") == pick_b["key"], S.slope(s(), cube.n))).alias("slope_b"))
        combos = cube.cells.filter(F.col("grp").isin(pick_a["key"], pick_b["key"])).groupBy("city").agg(
            F.coalesce(F.sum(F.when(F.col("grp") == pick_a["key"], F.col("amount"))).cast("double"), zero).alias("a"),
            F.coalesce(F.sum(F.when(F.col("grp") == pick_b["key"], F.col("amount"))).cast("double"), zero).alias("b"))
        rows = cities.join(combos, "city", "left").select(
            "city", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"), "city_total")
    return Pair(mode, pick_a["label"], pick_b["label"], rows, pick_a["total"], pick_b["total"], slopes)


def a_() -> Column:
    return F.col("a")


def b_() -> Column:
    return F.col("b")


def gap_() -> Column:
    return F.round(F.abs(a_() - b_()), 2)


def _winner(p: Pair) -> Column:
    return F.when(a_() == b_(), "Tie").when(a_() > b_(), F.lit(p.a)).otherwise(F.lit(p.b))


def pair_rows(p: Pair) -> DataFrame:
    return p.rows.select("city", money(a_()).alias("a"), money(b_()).alias("b"), F.round(a_() - b_(), 2).alias("delta"),
                         _winner(p).alias("winner"))


def _valid(p: Pair, metric: Column) -> Column:
    return metric if p.valid else null()


def _facts(p: Pair, *aggs: Column) -> DataFrame:
    return p.rows.agg(F.count(one()).alias("n"), *aggs)


def h2h_gap(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    gap = F.lit(round(p.high - p.low, 2))
    return single(pair_rows(p), _facts(p), _valid(p, ratio(gap, F.lit(p.high))), "HEAD_TO_HEAD_GAP",
                  headline=_valid(p, gap), coi=_valid(p, frac(F.when(gap != 0, gap / 4))))


def h2h_ratio(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    m = _valid(p, ratio(F.lit(p.high), F.lit(p.low)))
    return single(pair_rows(p), _facts(p), m, two_step(2, 4), headline=money(m))


def dominance_pattern(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    facts = _facts(p, F.count_if(a_() > b_()).alias("wa"), F.count_if(b_() > a_()).alias("wb"))
    m = _valid(p, ratio(F.greatest("wa", "wb").cast("double"), F.col("n")))
    return single(pair_rows(p), facts, m, two_step(0.75, 1.0), headline=_valid(p, F.col("wa")))


def gap_magnitude(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    table = p.rows.select("city", gap_().alias("gap"), frac(ratio(F.abs(a_() - b_()), F.greatest(a_(), b_()))).alias("gap_pct"),
                          _winner(p).alias("leader"))
    m = _valid(p, ratio(F.lit(abs(p.total_a - p.total_b)), F.lit(p.high)))
    return single(table, _facts(p), m, "HEAD_TO_HEAD_GAP", headline=frac(m))


def largest_gap_city(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    facts = _facts(p, F.max(gap_()).alias("hi"), F.sum(gap_()).alias("t"))
    top = facts.select("hi").scalar()
    table = p.rows.select("city", money(a_()).alias("a"), money(b_()).alias("b"), gap_().alias("gap"),
                          F.when(gap_() == top, AMBER).otherwise(GREEN).alias("status"))
    return single(table, facts, _valid(p, ratio(F.col("hi"), F.col("t"))), two_step(0.50, 0.75), headline=F.col("hi"))


def underdog_wins(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    won = (_winner(p) == p.trailer)
    facts = _facts(p, F.count_if(won).alias("k"))
    any_win = facts.select(F.col("k") > 0).scalar()
    table = pair_rows(p).filter((F.col("winner") == p.trailer) | ~any_win)
    m = _valid(p, 1 - ratio(F.col("k").cast("double"), F.col("n")))
    return single(table, facts, m, two_step(0.75, 1.0), headline=F.col("k"))


def revenue_weighted_gap(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    whole = F.lit(cube.total)
    weight = ratio(F.col("city_total"), whole)
    weighted = F.coalesce(F.abs(a_() - b_()) * weight, F.lit(0.0))
    table = p.rows.select("city", gap_().alias("gap"), frac(weight).alias("weight"), money(weighted).alias("weighted"))
    facts = _facts(p, F.sum(weighted).alias("w"))
    return single(table, facts, _valid(p, ratio(F.col("w"), whole)), two_step(0.02, 0.05), headline=money(F.col("w")))


def growth_direction(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    if p.slopes is None:
        facts = cube.company().select(null().alias("slope_a"), null().alias("slope_b"), F.lit(0.0).alias("m"))
    else:
        facts = p.slopes.withColumn("m", F.lit(cube.total / max(cube.n, 1)))
    table = facts.select(F.lit(p.a).alias("a"), F.lit(p.b).alias("b"), money(F.col("slope_a")).alias("slope_a"),
                         money(F.col("slope_b")).alias("slope_b"))
    lower = F.when(F.col("slope_a").isNotNull() & F.col("slope_b").isNotNull(), F.least("slope_a", "slope_b"))
    m = ratio(falls(lower), F.abs("m"))
    return single(table, facts, m, "NEGATIVE_SLOPE", headline=money(F.col("slope_a") - F.col("slope_b")))


def scale_difference(cube: Cube, mode: str = "product", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    pair_total, whole = F.lit(round(p.total_a + p.total_b, 2)), F.lit(cube.total)
    facts = _facts(p)
    side = lambda name, t: F.struct(F.lit(name).alias("entity"), F.lit(t).alias("total"))
    table = facts.select(F.inline(F.array(side(p.a, p.total_a), side(p.b, p.total_b)))).select(
        "entity", "total", frac(ratio(F.col("total"), pair_total)).alias("of_pair"),
        frac(ratio(F.col("total"), whole)).alias("of_company"))
    m = _valid(p, ratio(F.lit(p.high), pair_total))
    return single(table, facts, m, two_step(0.65, 0.80), headline=frac(_valid(p, ratio(F.lit(p.high - p.low), whole))))


def h2h_recovery(cube: Cube, mode: str = "product", **pick) -> Analysis:
    """Shortfall of the trailer, counted only in cities where it already sells."""
    p = resolve_pair(cube, mode, **pick)
    lead, trail = (a_(), b_()) if p.leader == p.a else (b_(), a_())
    short = F.when((trail != 0) & (lead > trail), F.round(lead - trail, 2)).otherwise(0.0)
    state = F.when(trail == 0, "Not stocked").when(short == 0, "Already ahead").otherwise("Addressable")
    table = p.rows.select("city", money(lead).alias("leader_revenue"), money(trail).alias("trailer_revenue"),
                          short.alias("recoverable"), state.alias("state"))
    facts = _facts(p, F.round(F.sum(short), 2).alias("r"))
    return single(table, facts, _valid(p, ratio(F.col("r"), F.lit(cube.total))), two_step(0.03, 0.06),
                  headline=_valid(p, F.lit(round(p.high - p.low, 2))), coi=frac(inaction_cost(-F.col("r"))))


def combined_total(cube: Cube, mode: str = "month", **pick) -> Analysis:
    p = resolve_pair(cube, mode, **pick)
    both = round(p.total_a + p.total_b, 2)
    facts = _facts(p)
    side = lambda name, t: F.struct(F.lit(name).alias("entity"), F.lit(t).alias("total"))
    table = facts.select(F.inline(F.array(side(p.a, p.total_a), side(p.b, p.total_b), side("Combined", both)))).select(
        "entity", "total", frac(ratio(F.col("total"), F.lit(cube.total))).alias("share_pct"))
    return single(table, facts, _valid(p, F.lit(0.0)), NO_BANDS, headline=_valid(p, F.lit(both)))


# --- rank matrix -----------------------------------------------------------------------


@dataclass
class RankMatrix:
    """``cells``: city, label, ord, value, rank. ``entities``: per-entity rank statistics."""

    mode: str
    cells: DataFrame
    entities: DataFrame
    n: int
    cities: int
    noun: str
    threshold: str
    strong: int
    weak: int


def rank_cells(cube: Cube, mode: str = "product") -> DataFrame:
    """Competition rank of every product (or month) inside each city; empty cells tie below the sellers."""
    if mode == "month":
        cells = cube.all_members(CITY).select(F.col("member").alias("city"), F.inline(S.ranked_months(s())))
        return cells.select(
            "city", cube.label(F.col("idx")).alias("label"), F.col("idx").cast("double").alias("ord"), "value", F.col("rank").cast("bigint").alias("rank"))
    # One row per product in every city: the partition is the product list, equal in all cities.
    w = Window.partitionBy("city").orderBy(F.desc("revenue"))
    return all_combos(cube).select("city", F.col("grp").alias("label"), F.col("revenue").alias("value"),
                                   F.rank().over(w).cast("bigint").alias("rank"))


def rank_matrix(cube: Cube, mode: str = "product") -> RankMatrix:
    name = f"ranks:{mode}"
    if name + ":cities" not in cube._frames:
        totals = _entities(cube, mode).filter(F.col("total") != 0).select("label", "total", "ord")
        cells = cube.kept(name, lambda: rank_cells(cube, mode).drop("ord").join(totals.select("label", "ord"), "label"))
        stats = cells.groupBy("label").agg(
            F.avg("rank").alias("avg_rank"), F.min("rank").alias("best"), F.max("rank").alias("worst"),
            F.count(one()).alias("cities"), F.count_if(F.col("rank") == 1).alias("firsts"),
            F.count_if(F.col("rank") <= 2).alias("top_two"))
        ents = cube.kept(name + ":entities", lambda: totals.join(stats, "label").withColumn(
            "spread", F.when(F.col("cities") >= 2, F.col("worst") - F.col("best"))))
        cube._frames[name + ":n"] = ents.count()
        cube._frames[name + ":cities"] = cube.all_members(CITY).count()
    month = mode == "month"
    return RankMatrix(mode, cube._frames[name], cube._frames[name + ":entities"], cube._frames[name + ":n"],
                      cube._frames[name + ":cities"], "months" if month else "products",
                      "MONTH_RANK_WEAK" if month else "AVERAGE_RANK_WEAK", 4 if month else 2, 10 if month else 5)


def avg_rank() -> Column:
    return F.round("avg_rank", 2)


def total() -> Column:
    return F.col("total")


def ranking_consistency(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    strength = F.when(F.col("avg_rank") <= m.strong, "STRONG").when(F.col("avg_rank") >= m.weak, "WEAK").otherwise("MIXED")
    a = per_row(m.entities, F.col("avg_rank"), m.threshold, noun=m.noun, headline=F.count_if(F.col("avg_rank") <= m.strong))
    a.table = a.table.select(F.col("label").alias("member"), money(total()).alias("revenue"), avg_rank().alias("avg_rank"),
                             strength.alias("strength"), "status", "severity")
    return a


def rank_dispersion(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    a = per_row(m.entities, F.col("spread"), two_step(2, 4), noun=m.noun, headline=F.max("spread"))
    a.table = a.table.select(F.col("label").alias("member"), money(total()).alias("revenue"), "best", "worst", "spread",
                             "status", "severity")
    return a


def most_frequently_top(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    table = m.entities.select(F.col("label").alias("member"), money(total()).alias("revenue"), "firsts", "top_two")
    facts = table.agg(F.max("firsts").alias("k"))
    return single(table, facts, ratio(F.col("k").cast("double"), F.lit(m.cities)), "RANK_LEADER_UBIQUITY", headline=F.col("k"))


def weakest_overall(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    table = m.entities.select(F.col("label").alias("member"), money(total()).alias("revenue"), avg_rank().alias("avg_rank"), "cities")
    facts = m.entities.agg(F.max("avg_rank").alias("w"))
    return single(table, facts, ratio(F.col("w"), F.lit(m.n)), "WEAKEST_RANK_SHARE", headline=F.round("w", 2))


def ranking_agreement(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    agree = F.coalesce(F.col("spread") <= 1, F.lit(False))
    table = m.entities.select(F.col("label").alias("member"), avg_rank().alias("avg_rank"), "spread",
                              F.when(agree, "Yes").otherwise("No").alias("agreed"))
    widest = max(1, m.n - 1)
    facts = m.entities.agg(F.count_if(agree).alias("k"), F.avg("spread").alias("sp"))
    metric = F.when(F.col("sp").isNotNull(), F.lit(m.n) - F.col("k"))
    table = table.withColumn("agreement", frac(1 - facts.select("sp").scalar() / widest))
    return single(table, facts, metric, amber_only(widest), headline=F.col("k"))


def never_top_n(cube: Cube, mode: str = "product", n: int = 2) -> Analysis:
    m = rank_matrix(cube, mode)
    never = F.col("best") > n
    table = m.entities.select(F.col("label").alias("member"), money(total()).alias("revenue"), F.col("best").alias("best_rank"),
                              F.when(never, f"Never top {n}").otherwise("Yes").alias("flag"))
    facts = m.entities.agg(F.count_if(never).alias("k"), F.count(one()).alias("n"))
    return single(table, facts, ratio(F.col("k").cast("double"), F.col("n")), two_step(0.34, 0.50), headline=F.col("k"))


def city_leaders(m: RankMatrix) -> DataFrame:
    """city -> its first entity at rank 1 (entity order breaks ties)."""
    return m.cells.filter(F.col("rank") == 1).groupBy("city").agg(F.min_by("label", F.struct("ord", "label")).alias("leader"))


def dominant_concentration(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    wins = city_leaders(m).groupBy(F.col("leader").alias("member")).agg(F.count(one()).alias("cities"))
    table = wins.withColumn("status", F.when(F.col("cities") > m.cities / 2, AMBER).otherwise(GREEN))
    facts = wins.agg(F.max("cities").alias("k"))
    metric = ratio(F.col("k").cast("double"), F.lit(m.cities))
    return single(table, facts, metric, "RANK_LEADER_UBIQUITY", headline=frac(metric))


def preference_diversity(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    leaders = city_leaders(m)
    spread = m.cells.groupBy("city").agg(
        F.count_if(F.col("value") != 0).alias("active"), F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("sq"))
    hhi = F.when(F.round("t", 2) != 0, F.col("sq") / F.when(F.round("t", 2) != 0, F.col("t") * F.col("t")))
    rows = cube.all_members(CITY).select(F.col("member").alias("city"), F.col("total").alias("city_total")).join(
        spread, "city", "left").join(leaders, "city", "left").withColumn("h", hhi)
    per = per_row(rows, F.col("h") * m.n, "HHI", noun="cities", headline=F.max("h"))
    table = per.table.select("city", money(F.col("city_total")).alias("revenue"), F.coalesce("leader", F.lit("-")).alias("leader"),
                             F.coalesce("active", F.lit(0)).cast("bigint").alias("active"), frac(F.col("h")).alias("hhi"),
                             money(1 / F.when(F.col("h") != 0, F.col("h"))).alias("effective"), "status")
    facts = leaders.groupBy("leader").agg(F.count(one()).alias("k")).agg(F.max("k").alias("k"), F.count(one()).alias("n"))
    return single(table, facts, ratio(F.col("k").cast("double"), F.lit(m.cities)), "RANK_LEADER_UBIQUITY", headline=F.col("n"))


def bottom_ranked_risk(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    third = -(-m.n * 2 // 3)
    last = m.cells.groupBy("city").agg(F.max("rank").alias("last_rank"))
    hits = m.cells.join(last, "city").groupBy("label").agg(
        F.count_if(F.col("rank") > third).alias("hits"), F.count_if(F.col("rank") == F.col("last_rank")).alias("lasts"))
    keep = max(1, int(m.n / 3 + 0.5))
    bottom = m.entities.orderBy(F.desc("avg_rank"), "ord", "label").limit(keep)
    table = bottom.select(F.col("label").alias("member"), money(total()).alias("revenue"), avg_rank().alias("avg_rank"),
                          frac(ratio(total(), F.lit(cube.total))).alias("share_pct"))
    facts = hits.agg(F.max("hits").alias("h"), F.max("lasts").alias("l"))
    return single(table, facts, F.col("h"), "BOTTOM_RANK_UBIQUITY", headline=F.col("l"))


def rank_revenue_divergence(cube: Cube, mode: str = "product") -> Analysis:
    m = rank_matrix(cube, mode)
    r = ranked(m.entities.select("label", "total", "avg_rank"), "total", name="revenue_rank", competition=True)
    gap = F.round(F.col("revenue_rank") - F.col("avg_rank"), 2)
    words = F.when(F.col("revenue_rank") - F.col("avg_rank") > 1, "Wins small markets").when(
        F.col("revenue_rank") - F.col("avg_rank") < -1, "Losing where it matters").otherwise("Consistent")
    table = r.select(F.col("label").alias("member"), money(total()).alias("revenue"), "revenue_rank", avg_rank().alias("avg_rank"),
                     gap.alias("divergence"), words.alias("reading"))
    facts = table.agg(F.min("divergence").alias("d"))
    return single(table, facts, falls(F.col("d")), two_step(1.5, 3), headline=F.col("d"))


def _edge(m: RankMatrix, first: bool) -> DataFrame:
    """city, rank of the first (or last) entity in entity order."""
    edge = m.entities.agg((F.min if first else F.max)("ord")).scalar()
    return m.cells.filter(F.col("ord") == edge)


def latest_average_rank(cube: Cube, mode: str = "month") -> Analysis:
    m = rank_matrix(cube, mode)
    edge = _edge(m, first=False)
    table = edge.select("city", "rank", money(F.col("value")).alias("revenue"))
    facts = edge.agg(F.avg("rank").alias("r"))
    return single(table, facts, ratio(F.col("r"), F.lit(m.n)), "LATEST_PERIOD_RANK_SHARE", headline=frac(F.col("r")))


def strongest_overall(cube: Cube, mode: str = "month") -> Analysis:
    m = rank_matrix(cube, mode)
    table = m.entities.select(F.col("label").alias("member"), money(total()).alias("revenue"), avg_rank().alias("avg_rank"))
    facts = m.entities.agg(F.min("avg_rank").alias("r"))
    return single(table, facts, F.when(F.col("r").isNotNull(), 0.0), NO_BANDS, headline=frac(F.col("r")))


def _rank_moves(m: RankMatrix) -> DataFrame:
    a = _edge(m, True).select("city", F.col("rank").alias("first_rank"))
    b = _edge(m, False).select("city", F.col("rank").alias("last_rank"))
    return a.join(b, "city").withColumn("improvement", F.col("first_rank") - F.col("last_rank"))


def first_vs_last_rank(cube: Cube, mode: str = "month") -> Analysis:
    m = rank_matrix(cube, mode)
    moves = _rank_moves(m)
    table = moves.withColumn("status", F.when(F.col("improvement") >= 0, GREEN).otherwise(AMBER))
    facts = moves.agg(F.avg("improvement").alias("i"))
    return single(table, facts, ratio(falls(F.col("i")), F.lit(m.n)), "RANK_DRIFT_SHARE", headline=frac(F.col("i")))


def rank_volatility_by_city(cube: Cube, mode: str = "month") -> Analysis:
    m = rank_matrix(cube, mode)
    rows = m.cells.groupBy("city").agg(F.count(one()).alias("periods"), F.stddev_samp("rank").alias("v")).filter(F.col("periods") >= 2)
    table = rows.select("city", "periods", F.round("v", 2).alias("volatility"))
    facts = rows.agg(F.max("v").alias("v"))
    return single(table, facts, ratio(F.col("v"), F.lit(m.n)), "RANK_VOLATILITY_SHARE", headline=frac(F.col("v")))


def consistently_top_n(cube: Cube, mode: str = "month", n: int = 3) -> Analysis:
    m = rank_matrix(cube, mode)
    inside = F.col("avg_rank") <= n
    table = m.entities.select(F.col("label").alias("member"), money(total()).alias("revenue"), avg_rank().alias("avg_rank"),
                              F.when(inside, f"Top {n} everywhere").otherwise("Mixed").alias("verdict"))
    facts = m.entities.agg(F.count_if(inside).alias("k"), F.count(one()).alias("n"))
    return single(table, facts, F.when(F.col("n") > 0, 0.0), NO_BANDS, headline=F.col("k"))


def recent_vs_historical_rank(cube: Cube, mode: str = "month", window: int = 3) -> Analysis:
    m = rank_matrix(cube, mode)
    early = m.entities.orderBy("ord", "label").limit(window).select("label")
    recent = m.entities.orderBy(F.desc("ord"), F.desc("label")).limit(window).select("label")
    e = m.cells.join(early, "label", "left_semi").agg(F.avg("rank").alias("early"))
    r = m.cells.join(recent, "label", "left_semi").agg(F.avg("rank").alias("recent"))
    facts = e.select("early", r.scalar().alias("recent")).withColumn("d", F.col("recent") - F.col("early"))
    table = facts.select(F.round("early", 2).alias("early_rank"), F.round("recent", 2).alias("recent_rank"), frac(F.col("d")).alias("drift"))
    metric = ratio(F.greatest(F.col("d"), F.lit(0.0)), F.lit(m.n)) if m.n >= 2 * window else null()
    return single(table, facts, metric, "RANK_DRIFT_SHARE", headline=frac(F.col("recent")))


def most_improved(cube: Cube, mode: str = "month") -> Analysis:
    m = rank_matrix(cube, mode)
    moves = _rank_moves(m)
    facts = moves.agg(F.max("improvement").alias("i"))
    return single(moves, facts, F.when(F.col("i").isNotNull(), 0.0), NO_BANDS, headline=F.col("i"))
