"""The catalogue: 161 analyses in 16 lenses, each bound to an operator and its parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison as cmp
from ..operators import concentration as con
from ..operators import contribution as brg
from ..operators import coverage as cov
from ..operators import trend as trn
from ..operators import volatility as vol
from ..operators.cube import CITY, GROUP
from .verdict import Analysis


@dataclass(frozen=True)
class Entry:
    id: str
    lens: int
    slot: int
    title: str
    question: str
    run: Callable[..., Analysis]
    params: dict = field(default_factory=dict)
    designed: bool = False


LENSES = {
    1: "City revenue trend",
    2: "City totals against an equal share",
    3: "City-product dependency",
    4: "City balance within products",
    5: "Company month by month",
    6: "Product month mix and decline",
    7: "Product head to head",
    8: "Product ranking by city",
    9: "Month concentration (HHI)",
    10: "Strongest product-city combinations",
    11: "Contribution bridge by product",
    12: "Contribution bridge by month",
    13: "Month head to head",
    14: "Month ranking by city",
    15: "Peak and trough by product",
    16: "Peak and trough by month",
}

city, group = {"axis": CITY}, {"axis": GROUP}
products, months = {"mode": "product"}, {"mode": "month"}

# Which operator fills which slot, in slot order.
BINDINGS: dict[int, list[tuple[Callable[..., Analysis], dict]]] = {
    1: [(trn.decline_streak, city), (trn.latest_growth, city), (trn.rolling_momentum, {**city, "window": 3}),
        (trn.peak_gap, city), (trn.share_shift, city), (trn.volatility_cv, city),
        (trn.top_n_dependency, {**city, "n": 2, "threshold": "TOP2_DEPENDENCY"}), (trn.trend_slope, city),
        (trn.company_trend, {}), (trn.growth_decline_balance, city)],
    2: [(con.equal_share_benchmark, city), (con.ranking_scale_gap, city), (con.hhi_index, city),
        (con.smallest_vs_largest, city), (con.growth_summary, city), (con.average_per_period, city),
        (con.multiple_of_smallest, city), (con.revenue_by_direction, city), (con.median_vs_mean, city),
        (con.quartile_classification, city)],
    3: [(cov.dependency_risk, city), (cov.portfolio_strength, city), (cov.revenue_parity, city), (cov.range_within, city),
        (cov.coverage_gap, city), (cov.largest_single_combo, {}), (cov.cross_ranking, group),
        (cov.cross_diversification, city), (cov.dominant_counterpart, city), (cov.bottom_combos, {"n": 3})],
    4: [(cov.dependency_risk, group), (cov.cross_diversification, group), (cov.share_within, group), (cov.range_within, group),
        (cov.dominant_counterpart, group), (cov.contribution_skew, group), (cov.portfolio_strength, city),
        (cov.revenue_parity, group), (cov.classify_by_share, group), (cov.coverage_gap, group)],
    5: [(trn.company_trend, {}), (trn.monthly_concentration, {}), (trn.front_vs_back, {}), (trn.monthly_volatility, city),
        (trn.latest_vs_average, {}), (trn.recent_3m_share, {}), (trn.mom_consistency, {}), (trn.rank_stability, city),
        (trn.quarterly_trajectory, {}), (trn.cross_city_sync, city), (trn.latest_vs_peak, {})],
    6: [(trn.decline_streak, group), (trn.rolling_momentum, {**group, "window": 3}), (trn.peak_gap, group),
        (trn.volatility_cv, group), (trn.latest_growth, group), (trn.growth_decline_balance, group), (trn.share_shift, group),
        (trn.top_n_dependency, {**group, "n": 1, "threshold": "SINGLE_ENTITY_DEPENDENCY"}), (trn.trend_slope, group),
        (trn.growth_decline_impact, group)],
    7: [(cmp.h2h_gap, products), (cmp.h2h_ratio, products), (cmp.dominance_pattern, products), (cmp.gap_magnitude, products),
        (cmp.largest_gap_city, products), (cmp.underdog_wins, products), (cmp.revenue_weighted_gap, products),
        (cmp.growth_direction, products), (cmp.scale_difference, products), (cmp.h2h_recovery, products)],
    8: [(cmp.ranking_consistency, products), (cmp.rank_dispersion, products), (cmp.most_frequently_top, products),
        (cmp.weakest_overall, products), (cmp.ranking_agreement, products), (cmp.never_top_n, {**products, "n": 2}),
        (cmp.dominant_concentration, products), (cmp.preference_diversity, products), (cmp.bottom_ranked_risk, products),
        (cmp.rank_revenue_divergence, products)],
    9: [(con.hhi_register, group), (con.highest_hhi, group), (con.average_portfolio_hhi, group), (con.hhi_spread, group),
        (con.above_hhi_limit, {**group, "limit": 0.10}), (con.most_diversified, group), (con.hhi_weighted_exposure, group),
        (con.diversification_gap, group), (con.concentration_health, group), (con.concentration_improvement, group)],
    10: [(con.top_n_combos, {"n": 5, "threshold": "TOP5_CONCENTRATION"}), (con.top_n_combos, {"n": 3, "threshold": "TOP3_CONCENTRATION"}),
         (con.top_n_combos, {"n": 1, "threshold": "TOP1_CONCENTRATION"}), (con.adjacent_dropoff, {}),
         (con.representation_in_top_n, {"n": 5, "facet": "city"}), (con.representation_in_top_n, {"n": 5, "facet": "group"}),
         (con.top_n_combos, {"n": 5, "threshold": "TOP5_CONCENTRATION"}), (con.rank_gap, {"high": 1, "low": 10}),
         (con.dominance_in_top_n, {"n": 5, "facet": "city"}), (con.tail_risk, {"head": 5})],
    11: [(brg.red_flags, group), (brg.largest_negative, group), (brg.largest_positive, group), (brg.net_movers, group),
         (brg.positive_vs_negative, group), (brg.contribution_imbalance, group), (brg.top_negative, {**group, "n": 2}),
         (brg.offset_capacity, group), (brg.change_vs_average, group), (brg.company_growth, {})],
    12: [(brg.monthly_bridge, {}), (brg.monthly_direction, {}), (brg.decline_persistence, {}), (brg.break_even_timeline, {}),
         (brg.change_distribution, group), (brg.net_position, {}), (brg.structural_limits, {}), (brg.largest_negative, city),
         (brg.recovery_potential, city), (brg.positive_vs_negative, group)],
    13: [(cmp.h2h_gap, months), (cmp.h2h_ratio, months), (cmp.dominance_pattern, months), (cmp.gap_magnitude, months),
         (cmp.largest_gap_city, months), (cmp.underdog_wins, months), (cmp.combined_total, months), (cmp.h2h_recovery, months),
         (cmp.revenue_weighted_gap, months), (cmp.h2h_recovery, months)],
    14: [(cmp.ranking_consistency, months), (cmp.latest_average_rank, months), (cmp.strongest_overall, months),
         (cmp.weakest_overall, months), (cmp.first_vs_last_rank, months), (cmp.rank_volatility_by_city, months),
         (cmp.consistently_top_n, {**months, "n": 3}), (cmp.recent_vs_historical_rank, {**months, "window": 3}),
         (cmp.most_improved, months), (cmp.ranking_agreement, months)],
    15: [(vol.peak_trough_register, group), (vol.highest_volatility, group), (vol.most_stable, group),
         (vol.average_volatility, group), (vol.extreme_count, group), (vol.revenue_at_risk, group), (vol.peak_month_share, group),
         (vol.trough_vs_average, group), (vol.current_vs_trough, group), (vol.volatility_weighted_exposure, group)],
    16: [(vol.monthly_overview, {}), (vol.monthly_range, {}), (vol.company_cv, {}), (vol.best_vs_worst_multiple, {}),
         (vol.months_below_average, {}), (vol.trend_strength, {}), (vol.predictability, {}), (vol.acceleration, {}),
         (vol.peak_month_concentration, {}), (brg.structural_limits, {})],
}

# Slots that were designed to complete the grid rather than given with it.
DESIGNED = {"L03.A02", "L03.A03", "L03.A04", "L07.A10", "L08.A10", "L12.A10", "L13.A10", "L14.A10", "L15.A10"}

QUESTIONS: dict[str, str] = {
    "decline_streak": "What is the longest unbroken run of monthly falls?",
    "latest_growth": "Did the latest month rise or fall against the one before?",
    "rolling_momentum": "Are the last three months above or below the three before?",
    "peak_gap": "How far below its best month is the latest?",
    "share_shift": "Who gained and who lost share between first and last month?",
    "volatility_cv": "How steady is monthly revenue?",
    "top_n_dependency": "How much rides on the largest members?",
    "trend_slope": "Which way does the fitted trend point, and how steeply?",
    "company_trend": "Is the company growing or shrinking?",
    "growth_decline_balance": "How many members are growing and how many declining?",
    "monthly_concentration": "How far apart are the best and the worst month?",
    "front_vs_back": "Was the second half stronger than the first?",
    "monthly_volatility": "Which member swings most from month to month?",
    "latest_vs_average": "Is the latest month above its own average?",
    "recent_3m_share": "Do the last three months carry their proportional share?",
    "mom_consistency": "How often did revenue rise month on month?",
    "rank_stability": "Has the ranking changed between first and last month?",
    "quarterly_trajectory": "Is revenue rising quarter over quarter?",
    "cross_city_sync": "Do the cities move together?",
    "latest_vs_peak": "How much of the peak month does the latest month reach?",
    "growth_decline_impact": "Do the gains outweigh the losses?",
    "equal_share_benchmark": "Who sits far from an equal split?",
    "ranking_scale_gap": "How far ahead of the smallest is the largest?",
    "hhi_index": "How concentrated is revenue across members?",
    "smallest_vs_largest": "How small is the smallest next to the largest?",
    "growth_summary": "Who grew and who shrank from first to last month?",
    "average_per_period": "What does a typical month bring?",
    "multiple_of_smallest": "How many times the smallest is each member?",
    "revenue_by_direction": "How much revenue sits on a falling trend?",
    "median_vs_mean": "Is the average pulled up by a few large members?",
    "quartile_classification": "Which quarter of the ranking does each member fall in?",
    "dependency_risk": "Does one counterpart carry a member?",
    "portfolio_strength": "Who combines revenue with breadth?",
    "revenue_parity": "How evenly is revenue spread?",
    "range_within": "How far apart are a member's best and worst counterparts?",
    "coverage_gap": "How much of the matrix is empty?",
    "largest_single_combo": "How much rides on one product in one city?",
    "cross_ranking": "How do members rank by total?",
    "cross_diversification": "How widely is each member spread?",
    "dominant_counterpart": "Who leads inside each member, and by how much?",
    "bottom_combos": "Which live combinations are smallest?",
    "share_within": "How is each member split over its counterparts?",
    "contribution_skew": "Where does one entry hold more than half?",
    "classify_by_share": "Which members are core, support or marginal?",
    "h2h_gap": "How large is the gap between the two?",
    "h2h_ratio": "How many times the trailer is the leader?",
    "dominance_pattern": "Who wins in how many cities?",
    "gap_magnitude": "How large is the gap in each city?",
    "largest_gap_city": "Where is the gap concentrated?",
    "underdog_wins": "Where does the trailer lead?",
    "revenue_weighted_gap": "What is the gap worth once cities are weighted?",
    "growth_direction": "Are the two moving the same way?",
    "scale_difference": "How is the pair's revenue split?",
    "h2h_recovery": "What would closing the gap be worth where the trailer already sells?",
    "combined_total": "What are the two worth together?",
    "ranking_consistency": "Who ranks well everywhere?",
    "rank_dispersion": "Whose rank differs most between cities?",
    "most_frequently_top": "Who is first most often?",
    "weakest_overall": "Who ranks last on average?",
    "ranking_agreement": "Do the cities agree on the ranking?",
    "never_top_n": "Who never reaches the top?",
    "dominant_concentration": "Does one leader hold most cities?",
    "preference_diversity": "How diverse is each city's mix?",
    "bottom_ranked_risk": "Who is in the bottom third in several cities?",
    "rank_revenue_divergence": "Who ranks better or worse than revenue suggests?",
    "latest_average_rank": "Where does the latest period rank?",
    "strongest_overall": "Which one ranks best on average?",
    "first_vs_last_rank": "How did each city's rank of the first and last period change?",
    "rank_volatility_by_city": "Which city's ranking jumps about most?",
    "consistently_top_n": "Which ones average inside the top?",
    "recent_vs_historical_rank": "Do recent periods rank worse than early ones?",
    "most_improved": "Which city improved most?",
    "hhi_register": "Does revenue arrive evenly or in a few months?",
    "highest_hhi": "Which member is most month-concentrated?",
    "average_portfolio_hhi": "How concentrated is the portfolio on average?",
    "hhi_spread": "How different are the members?",
    "above_hhi_limit": "How many members are above the limit?",
    "most_diversified": "Which member is steadiest?",
    "hhi_weighted_exposure": "How much revenue is exposed to concentration?",
    "diversification_gap": "How far from an even spread are the members?",
    "concentration_health": "How healthy is the spread, out of 100?",
    "concentration_improvement": "What would smoothing be worth?",
    "top_n_combos": "How much do the strongest combinations carry?",
    "adjacent_dropoff": "How steep is the drop from one rank to the next?",
    "representation_in_top_n": "Who is represented among the strongest combinations?",
    "rank_gap": "How far apart are the first and the tenth?",
    "dominance_in_top_n": "Does one member own the strongest combinations?",
    "tail_risk": "How much does the tail contribute?",
    "red_flags": "Which members explain the decline?",
    "largest_negative": "Which member fell most?",
    "largest_positive": "Which member grew most?",
    "net_movers": "How many members rose and how many fell?",
    "positive_vs_negative": "Do gains cover losses?",
    "contribution_imbalance": "Is the movement one member's doing?",
    "top_negative": "How much do the worst members explain?",
    "offset_capacity": "Can growth cover the decline?",
    "change_vs_average": "Which movement is out of the ordinary?",
    "company_growth": "By what rate did the company move?",
    "monthly_direction": "Which way do the months point?",
    "decline_persistence": "Is revenue still falling?",
    "break_even_timeline": "How soon is a fifth of revenue gone at this trend?",
    "change_distribution": "Is the change broad or driven by outliers?",
    "net_position": "Is the company up or down in amount?",
    "recovery_potential": "What would restoring the decliners bring?",
    "monthly_bridge": "How did each month move against the one before?",
    "structural_limits": "What does the shape of the data rule out?",
    "peak_trough_register": "How far apart are peak and trough?",
    "highest_volatility": "Which member is most volatile?",
    "most_stable": "Which member is most stable?",
    "average_volatility": "How volatile is the average member?",
    "extreme_count": "How many members are extreme?",
    "revenue_at_risk": "How much lies between peaks and troughs?",
    "peak_month_share": "How much of the total is one month?",
    "trough_vs_average": "How far below average is the trough?",
    "current_vs_trough": "How much buffer is left above the trough?",
    "volatility_weighted_exposure": "How much revenue sits behind the swings?",
    "monthly_overview": "What are the company's peak and trough?",
    "monthly_range": "How wide is the monthly range?",
    "company_cv": "How variable are the company's months?",
    "best_vs_worst_multiple": "How many times the worst month is the best?",
    "months_below_average": "How many months are below average?",
    "trend_strength": "How strong is the monthly trend?",
    "predictability": "How predictable are the months?",
    "acceleration": "Is the movement speeding up or slowing down?",
    "peak_month_concentration": "How much of the year is the peak month?",
}


def _entries() -> list[Entry]:
    out = []
    for lens, bound in BINDINGS.items():
        for slot, (fn, params) in enumerate(bound, 1):
            eid = f"L{lens:02d}.A{slot:02d}"
            subject = params["axis"].label if "axis" in params else params.get("mode", "")
            name = fn.__name__
            title = name.replace("_", " ").capitalize() + (f" ({subject})" if subject else "")
            out.append(Entry(eid, lens, slot, title, QUESTIONS[name], fn, params, eid in DESIGNED))
    return out


CATALOG: list[Entry] = _entries()
BY_ID: dict[str, Entry] = {e.id: e for e in CATALOG}
USER_ANALYSES: dict[str, Entry] = {}


def register(entry: Entry) -> None:
    """Add a user's own analysis: any function of (cube, **params) returning an Analysis."""
    if entry.id in BY_ID:
        raise ValueError(f"{entry.id} is already bound")
    USER_ANALYSES[entry.id] = entry


def entries() -> list[Entry]:
    return [*CATALOG, *USER_ANALYSES.values()]


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(e.id, e.lens, LENSES.get(e.lens, ""), e.slot, e.title, e.question, "designed" if e.designed else "given")
            for e in entries()]
    return spark.createDataFrame(
        rows, "analysis_id string, lens bigint, lens_name string, slot bigint, title string, question string, source string")


def with_status(spark: SparkSession, verdicts: DataFrame) -> DataFrame:
    """The catalogue with what each analysis found; an entry without a verdict row has a NULL status."""
    found = verdicts.select("analysis_id", "status", "severity", "fired", "assessed")
    return catalog(spark).join(found, "analysis_id", "left")


def lens_summary(verdicts: DataFrame) -> DataFrame:
    """One row per lens: how many analyses stand at each status, how many rows fired, and the worst finding.

    The worst finding has the lowest priority number; the first id decides among equals.
    """
    at = lambda status: F.count_if(F.col("status") == status).alias(status.lower())
    return verdicts.groupBy("lens").agg(
        F.count(F.lit(1)).alias("analyses"), *[at(x) for x in ("RED", "AMBER", "GREEN", "IDLE")], F.sum("fired").alias("fired"),
        F.min_by("analysis_id", F.struct("priority", "analysis_id")).alias("worst_id"), F.min("priority").alias("worst_priority"))
