"""Queries over the monthly cube: catalogue operators, lens verdicts, cube primitives, cross-checks."""

from __future__ import annotations

from daybook.operators import comparison as cmp
from daybook.operators import contribution as brg
from daybook.operators import cube as cb
from daybook.operators import volatility as vol
from daybook.operators.crosschecks import verify_cube
from daybook.operators.cube import CITY, CUSTOMER, GROUP, ITEM, SALESMAN
from daybook.plans import catalog as cat
from daybook.plans import leaderboards
from daybook.plans.runner import run_all, run_lens
from daybook.plans.verdict import contract_violations, verdict

from .sql_analyses import S, brows, prow, rcells, vp
from .sql_base import N, T, ar, div, lbl, prelude, r, r2, severity, status, verdict_sql
from .star import sales_cube

# Inventory ids: the operators of each family in inventory order.
FAMILIES = {
    "T": """decline_streak latest_growth rolling_momentum peak_gap share_shift volatility_cv top_n_dependency trend_slope company_trend
            growth_decline_balance monthly_concentration front_vs_back monthly_volatility latest_vs_average recent_3m_share mom_consistency
            rank_stability quarterly_trajectory cross_city_sync latest_vs_peak growth_decline_impact""",
    "K": """equal_share_benchmark ranking_scale_gap hhi_index smallest_vs_largest growth_summary average_per_period multiple_of_smallest
            revenue_by_direction median_vs_mean quartile_classification hhi_register highest_hhi average_portfolio_hhi hhi_spread above_hhi_limit
            most_diversified hhi_weighted_exposure diversification_gap concentration_health concentration_improvement top_n_combos adjacent_dropoff
            representation_in_top_n rank_gap dominance_in_top_n tail_risk""",
    "B": """red_flags largest_negative largest_positive net_movers positive_vs_negative contribution_imbalance top_negative offset_capacity
            change_vs_average company_growth monthly_direction decline_persistence break_even_timeline change_distribution net_position
            recovery_potential monthly_bridge structural_limits""",
    "P": """h2h_gap h2h_ratio dominance_pattern gap_magnitude largest_gap_city underdog_wins revenue_weighted_gap growth_direction
            scale_difference h2h_recovery combined_total""",
    "R": """ranking_consistency rank_dispersion most_frequently_top weakest_overall ranking_agreement never_top_n dominant_concentration
            preference_diversity bottom_ranked_risk rank_revenue_divergence latest_average_rank strongest_overall first_vs_last_rank
            rank_volatility_by_city consistently_top_n recent_vs_historical_rank most_improved""",
    "V": """peak_trough_register highest_volatility most_stable average_volatility extreme_count revenue_at_risk peak_month_share
            trough_vs_average current_vs_trough volatility_weighted_exposure monthly_overview monthly_range company_cv best_vs_worst_multiple
            months_below_average trend_strength predictability acceleration peak_month_concentration""",
    "G": """dependency_risk portfolio_strength revenue_parity range_within coverage_gap largest_single_combo cross_ranking cross_diversification
            dominant_counterpart bottom_combos share_within contribution_skew classify_by_share""",
}
INVENTORY = {name: f"{fam}{i:02d}" for fam, names in FAMILIES.items() for i, name in enumerate(names.split(), 1)}

# Month-concentration and peak/trough measures read gross revenue, so that a month of
# returns does not push a share or a trough below zero; everything else nets returns.
GROSS_LENSES = {9, 15, 16}


def gross_op(name: str) -> bool:
    return INVENTORY[name][0] == "V" or (INVENTORY[name][0] == "K" and 11 <= int(INVENTORY[name][1:]) <= 20)


def cube_of(spark, sf_dir, net: bool = True):
    return sales_cube(spark, sf_dir) if net else sales_cube(spark, sf_dir, net_returns=False)


QUERIES: dict = {}
SQL: dict = {}


def _suffix(params: dict) -> str:
    parts = [v.key if hasattr(v, "key") else str(v) for k, v in params.items() if k != "threshold"]
    return "".join("_" + str(x).replace(".", "p") for x in parts)


def _table_query(entry, net):
    return lambda spark, sf: entry.run(cube_of(spark, sf, net), **entry.params).table


for _e in cat.CATALOG:
    _name = _e.run.__name__
    _net = not gross_op(_name)
    _q = f"{INVENTORY[_name]}_{_name}{_suffix(_e.params)}"
    if _q not in QUERIES:
        QUERIES[_q] = _table_query(_e, _net)
        SQL[_q] = prelude(_net) + S[_name](_e.params).table()

VERDICT_COLS = ["analysis_id", "status", "severity", "priority", "fired", "assessed", "headline", "coi"]


def lens_sql(lens: int) -> str:
    return " UNION ALL ".join(
        f"({verdict_sql(e.id, S[e.run.__name__](e.params))})" for e in cat.CATALOG if e.lens == lens)


def _lens_query(lens, net):
    return lambda spark, sf: run_lens(cube_of(spark, sf, net), lens).select(*VERDICT_COLS)


for _l in cat.LENSES:
    _net = _l not in GROSS_LENSES
    QUERIES[f"A12_run_lens_{_l:02d}"] = _lens_query(_l, _net)
    SQL[f"A12_run_lens_{_l:02d}"] = prelude(_net) + lens_sql(_l)


def q(name: str, sql: str | None = None, net: bool = True):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = prelude(net) + sql
        return fn
    return add


# --- verdict machinery -----------------------------------------------------------------

_CV = div("sd", "abs(mean)")
_BANDS = ar(0.15, 0.30)


@q("A10_verdict_rows", f"""SELECT member, {r('m')} AS cv, {status('m', _BANDS)} AS status, {severity('m', _BANDS)} AS severity,
  CASE WHEN m IS NULL THEN 5 WHEN m >= 0.3 THEN 2 WHEN m >= 0.15 THEN 3 ELSE 4 END::BIGINT AS priority, coalesce(m >= 0.15, false) AS fired
  FROM (SELECT *, {_CV} AS m FROM prof_grp)""")
def _(spark, sf):
    return verdict(cb.member_statistics(cube_of(spark, sf), GROUP).select("member", "cv"), cb.F.col("cv"), "VOLATILITY_CV").select(
        "member", "cv", "status", "severity", "priority", "fired")


@q("A11_worst_of", verdict_sql("L06.A03", S["peak_gap"]({"axis": GROUP})))
def _(spark, sf):
    return run_lens(cube_of(spark, sf), 6).filter("analysis_id = 'L06.A03'").select(*VERDICT_COLS)


ALL_VERDICTS = " UNION ALL ".join(f"({lens_sql(lens)})" for lens in cat.LENSES)


# Gross-only lenses are compared lens by lens; here the whole catalogue runs over the net cube.
# Cost figures of net month-HHI reach 1e11, where the last cents depend on summation order: whole units are compared.
@q("A12_run_all", f"SELECT * EXCLUDE (coi), {r('coi', 0)} AS coi FROM ({ALL_VERDICTS})")
def _(spark, sf):
    return run_all(cube_of(spark, sf)).select(*VERDICT_COLS).withColumn("coi", cb.F.round("coi", 0))


_verdicts: dict = {}


def all_verdicts(spark, sf):
    """Verdicts of the whole catalogue; one row per entry, kept for the queries that read them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _verdicts:
        _verdicts[key] = run_all(cube_of(spark, sf))
    return _verdicts[key]


# Verdict rows spoilt by slot, one rule after the other, next to the sound ones.
_SPOILT = [(1, "analysis_id", "'X' || analysis_id", "bad id"), (2, "lens", "lens + 40", "lens out of range"), (3, "slot", "-slot", "slot not positive"),
           (4, "status", "'PURPLE'", "unknown status"), (5, "severity", "'UTTER'", "unknown severity"), (6, "priority", "priority + 5", "priority out of range"),
           (7, "headline", "CAST('Infinity' AS DOUBLE)", "headline not finite"), (8, "coi", "CAST('NaN' AS DOUBLE)", "coi not finite")]
_SLOT = "CAST(substr(analysis_id, 6, 2) AS INT)"


@q("A14_verdict_contract", f"""SELECT CASE WHEN {_SLOT} = 1 THEN 'X' || analysis_id ELSE analysis_id END AS analysis_id,
  CASE {_SLOT} {' '.join(f"WHEN {n} THEN '{problem}'" for n, _, _, problem in _SPOILT)} END AS problem FROM ({ALL_VERDICTS}) WHERE {_SLOT} <= {len(_SPOILT)}""")
def _(spark, sf):
    sound = all_verdicts(spark, sf)
    spoilt = [sound.filter(f"slot = {n}").withColumn(name, cb.F.expr(value)) for n, name, value, _ in _SPOILT]
    rows = sound
    for part in spoilt:
        rows = rows.unionByName(part)
    return contract_violations(rows)


_PERSIST = """CASE WHEN severity = 'CRITICAL' THEN greatest(p, 4) ELSE p END"""
# L14.A01 is the one analysis whose verdict counts months.
_BOARD = f"""board AS (SELECT *, {_PERSIST} AS per FROM (SELECT *, CASE WHEN analysis_id = 'L14.A01' THEN least(5, greatest(1, assessed)) ELSE 3 END AS p
  FROM ({ALL_VERDICTS})) WHERE status <> 'IDLE')"""


@q("D01_owner_top5", f""", {_BOARD} SELECT row_number() OVER (ORDER BY score DESC, coalesce(coi, 0) DESC, analysis_id)::BIGINT AS rank, analysis_id, status, severity, score,
  {r2('coalesce(coi, 0) * 6')} AS financial_impact FROM (SELECT *, (sv * per * CASE WHEN sv >= 4 AND per >= 4 THEN 3 ELSE 2 END)::BIGINT AS score FROM (SELECT *,
  CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS sv FROM board)) QUALIFY rank <= 5""")
def _(spark, sf):
    return leaderboards.owner_top5(all_verdicts(spark, sf))


@q("D02_manager_top10", f""", {_BOARD} SELECT row_number() OVER (ORDER BY score DESC, impact DESC, analysis_id)::BIGINT AS rank, analysis_id, status, severity,
  {r2('impact')} AS impact, score FROM (SELECT *, {r("impact / 1000 * (CASE WHEN severity = 'CRITICAL' THEN 5 ELSE 4 END) * per * (CASE WHEN lens IN (1,3,4,6,7,8,10,11,13,14,15) THEN 5 ELSE 4 END)", 4)} AS score
  FROM (SELECT *, CAST(substr(analysis_id, 2, 2) AS INT) AS lens, greatest(100, coalesce(coi, CASE WHEN headline <> 0 THEN abs(headline) END, 1000)) AS impact FROM board)) QUALIFY rank <= 10""")
def _(spark, sf):
    return leaderboards.manager_top10(all_verdicts(spark, sf))


# --- pair, bridge, rank matrix, profile -------------------------------------------------


@q("B00_contribution_bridge_city", f"SELECT member, base, comparison, delta, {r('share')} AS share_of_decline, role FROM {brows({'axis': CITY})}")
def _(spark, sf):
    b = brg.bridge(cube_of(spark, sf), CITY)
    return b.rows.select("member", "base", "comparison", "delta", brg.frac(cb.F.col("share")).alias("share_of_decline"), "role")


@q("B00_contribution_bridge_halves", f"""SELECT member, base, comparison, {r2('comparison-base')} AS delta FROM (SELECT member, {r2('h1')} AS base, {r2('h2')} AS comparison FROM any_grp)""")
def _(spark, sf):
    cube = cube_of(spark, sf)
    half = (cube.n + 1) // 2
    return brg.bridge(cube, GROUP, list(range(half)), list(range(half, cube.n))).rows.select("member", "base", "comparison", "delta")


for _m in ("product", "month"):
    QUERIES[f"P00_pair_{_m}"] = lambda spark, sf, m=_m: cmp.pair_rows(cmp.resolve_pair(cube_of(spark, sf), m))
    SQL[f"P00_pair_{_m}"] = prelude() + prow({"mode": _m})
    QUERIES[f"R00_rank_matrix_{_m}"] = lambda spark, sf, m=_m: cmp.rank_matrix(cube_of(spark, sf), m).cells.select("city", "label", "value", "rank")
    SQL[f"R00_rank_matrix_{_m}"] = prelude() + f"SELECT city, label, value, rank FROM {rcells({'mode': _m})}"


@q("P00_pair_named", f"""SELECT city, {r2('a')} AS a, {r2('b')} AS b, {r2('a-b')} AS delta, CASE WHEN a = b THEN 'Tie' WHEN a > b THEN 'Brand#3' ELSE 'Brand#7' END AS winner FROM (
  SELECT c.member AS city, coalesce((SELECT sum(v)::DOUBLE FROM cells x WHERE x.city = c.member AND x.grp = 'Brand#3'), 0) AS a,
  coalesce((SELECT sum(v)::DOUBLE FROM cells x WHERE x.city = c.member AND x.grp = 'Brand#7'), 0) AS b FROM all_city c)""")
def _(spark, sf):
    return cmp.pair_rows(cmp.resolve_pair(cube_of(spark, sf), "product", a="Brand#3", b="Brand#7"))


@q("V00_peak_trough_profile", f"""SELECT member, {r2('pk')} AS peak, {lbl('pki')} AS peak_month, {r2('tr')} AS trough, {lbl('tri')} AS trough_month, {r('pr')} AS pt_ratio, gap,
  {r('mean')} AS mean, {r2('total')} AS total, {r2('l')} AS current, {r('cv')} AS cv, collapsed FROM {vp({'axis': CITY})}""", net=False)
def _(spark, sf):
    return vol.peak_trough_profile(cube_of(spark, sf, False), CITY)


# --- cube primitives --------------------------------------------------------------------

_DIM = {"city": "city", "group": "grp", "salesman": "salesman", "customer": "customer", "item": "item"}
for _a in (CITY, GROUP, ITEM, CUSTOMER, SALESMAN):
    QUERIES[f"C01_total_by_{_a.key}"] = lambda spark, sf, a=_a: cb.cube_totals(sales_cube(spark, sf, salesman=a.key == "salesman"), a)
    SQL[f"C01_total_by_{_a.key}"] = prelude() + f"SELECT {_DIM[_a.key]} AS member, {r2('sum(v)')} AS total FROM fact WHERE v <> 0 GROUP BY 1"

_MATRICES = {"city_period": ("city", "idx"), "group_period": ("grp", "idx"), "city_group": ("city", "grp"), "group_item": ("grp", "item"),
             "city_group_period": ("city", "grp", "idx"), "salesman_period": ("salesman", "idx"), "customer_period": ("customer", "idx")}
for _n, _cols in _MATRICES.items():
    QUERIES[f"C01_matrix_{_n}"] = lambda spark, sf, c=_cols: cb.cube_matrix(sales_cube(spark, sf, salesman="salesman" in c), c)
    SQL[f"C01_matrix_{_n}"] = prelude() + f"SELECT {', '.join(_cols)}, sum(v)::DOUBLE AS amount FROM fact JOIN mon USING (m) WHERE v <> 0 GROUP BY ALL"


@q("C01_cube_abs_measure", f"SELECT city AS member, {r2('sum(v)')} AS total FROM fact GROUP BY 1", net=False)
def _(spark, sf):
    return cb.cube_totals(cube_of(spark, sf, False), CITY)


@q("C01_cube_with_charges", f"""SELECT n.n_name AS member, {r2("sum(CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l.l_tax AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)))")} AS total
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def _(spark, sf):
    return cb.cube_totals(sales_cube(spark, sf, measure="amount_with_charges"), CITY)


@q("C02_cube_meta", f"""SELECT count(*) AS rows_in, count(*) FILTER (v <> 0) AS rows_counted, 0::BIGINT AS rows_off_axis, count(*) FILTER (v = 0) AS rows_zero, count(*) FILTER (v < 0) AS return_rows,
  coalesce(sum(-v) FILTER (v < 0), 0)::DOUBLE AS return_amount, 0::BIGINT AS periods_from_fallback, 0::BIGINT AS unresolved_rows, {N} AS periods, false AS truncated, {N} > 12 AS same_month_collision FROM fact""")
def _(spark, sf):
    return cb.cube_meta(cube_of(spark, sf))


@q("C03_period_axis", "SELECT idx::BIGINT AS idx, key AS period, lbl AS month FROM mon")
def _(spark, sf):
    return cb.period_axis(cube_of(spark, sf))


@q("C04_dense_series_city", "SELECT member, idx::BIGINT AS idx, v AS amount FROM ser_city")
def _(spark, sf):
    return cb.dense_long(cube_of(spark, sf), CITY)


@q("C05_all_combos", """SELECT c.member AS city, g.member AS grp, coalesce(x.total, 0)::DOUBLE AS revenue, coalesce(x.total, 0) <> 0 AS is_active
  FROM all_city c CROSS JOIN all_grp g LEFT JOIN combos x ON x.city = c.member AND x.grp = g.member""")
def _(spark, sf):
    return cb.all_combos(cube_of(spark, sf))


for _a, _mine, _other in ((CITY, "city", "grp"), (GROUP, "grp", "city")):
    QUERIES[f"C06_active_counterparts_{_a.key}"] = lambda spark, sf, a=_a: cb.active_counterparts(cube_of(spark, sf), a)
    SQL[f"C06_active_counterparts_{_a.key}"] = prelude() + (
        f"SELECT {_mine} AS member, {_other} AS counterpart, row_number() OVER (PARTITION BY {_mine} ORDER BY total DESC, {_other})::BIGINT AS rank, total AS revenue FROM combos")

_STATS_SQL = f"""SELECT member, {r('mean')} AS mean, {r2('sd')} AS sd, {r(_CV)} AS cv, {r2('b')} AS slope, streak AS decline_longest, cur AS decline_current, gstreak AS growth_longest,
  gcur AS growth_current, {r('rec')} AS recent_avg, {r('pri')} AS prior_avg, {r2('pk')} AS peak, pki::BIGINT AS peak_idx, {r2('tr')} AS trough, tri::BIGINT AS trough_idx,
  {r(div('pk', 'tr'))} AS peak_trough_ratio, {r2('l-pk')} AS peak_gap, {r(div('l-pk', 'abs(pk)'))} AS peak_gap_rate, {r(div('sq', 'total*total'))} AS hhi,
  {r(div('total*total', 'sq'))} AS diversification, {r2('h1')} AS first_half, {r2('h2')} AS second_half FROM prof_"""
for _a, _k in ((CITY, "city"), (GROUP, "grp")):
    QUERIES[f"C07_C18_member_statistics_{_a.key}"] = lambda spark, sf, a=_a: cb.member_statistics(cube_of(spark, sf), a)
    SQL[f"C07_C18_member_statistics_{_a.key}"] = prelude() + _STATS_SQL + _k


@q("C10_mom_series_group", f"SELECT member, idx::BIGINT AS idx, v AS amount, {r(div('v-prev', 'abs(prev)'))} AS mom FROM ser_grp")
def _(spark, sf):
    return cb.mom_series(cube_of(spark, sf), GROUP)


@q("C15_top_n_share", f"SELECT {r(div('sum(total) FILTER (k <= 3)', T))} AS share FROM (SELECT total, row_number() OVER (ORDER BY total DESC) AS k FROM prof_city)")
def _(spark, sf):
    cube = cube_of(spark, sf)
    return cube.members(CITY).orderBy(cb.F.desc("total")).limit(3).agg(cb.frac(cb.F.sum("total") / cb.F.lit(cube.total)).alias("share"))


@q("C16_rank_and_quartile", "SELECT member, rk::BIGINT AS rank, least(4, ((rk - 1) * 4) // c + 1)::BIGINT AS quartile FROM (SELECT member, rank() OVER (ORDER BY total DESC) AS rk, count(*) OVER () AS c FROM prof_grp)")
def _(spark, sf):
    cube = cube_of(spark, sf)
    n = cube.member_count(GROUP)
    return cb.ranked(cube.members(GROUP).select("member", "total"), "total", competition=True).select(
        "member", "rank", cb.F.least(cb.F.lit(4), cb.F.floor((cb.F.col("rank") - 1) * 4 / n) + 1).cast("bigint").alias("quartile"))


@q("C20_cost_of_inaction", f"""SELECT member, {r2('l-f')} AS change, {r("CASE WHEN round(l-f, 2) < 0 THEN (f-l) / 12 * 3 END")} AS amount, {r("CASE WHEN round(l-f, 2) < 0 THEN (f-l) * 6 ELSE 0 END")} AS opportunity,
  {r('rec')} AS trailing3, {r('(rec + pri) / 2')} AS trailing6 FROM prof_city""")
def _(spark, sf):
    cube = cube_of(spark, sf)
    s = cb.F.col("s")
    change = cb.F.round(cb.S.last(s) - cb.S.at(s, 0), 2)
    return cube.members(CITY).select("member", change.alias("change"), cb.frac(cb.inaction_cost(change)).alias("amount"),
                                     cb.frac(cb.inaction_opportunity(change)).alias("opportunity"), cb.frac(cb.S.window_mean(s, 3)).alias("trailing3"),
                                     cb.frac(cb.S.window_mean(s, 6)).alias("trailing6"))


# --- catalogue and cross-checks ---------------------------------------------------------

@q("D03_lens_summary", f"""SELECT CAST(substr(analysis_id, 2, 2) AS BIGINT) AS lens, count(*) AS analyses, {', '.join(f"count(*) FILTER (status = '{x}') AS {x.lower()}" for x in ('RED', 'AMBER', 'GREEN', 'IDLE'))},
  sum(fired)::BIGINT AS fired, arg_min(analysis_id, (priority, analysis_id)) AS worst_id, min(priority) AS worst_priority FROM ({ALL_VERDICTS}) GROUP BY 1""")
def _(spark, sf):
    return cat.lens_summary(all_verdicts(spark, sf))


_DESIGNED = ", ".join(f"'{x}'" for x in sorted(cat.DESIGNED))


@q("A13_catalog_with_status", f"""SELECT analysis_id, CAST(substr(analysis_id, 2, 2) AS BIGINT) AS lens, CAST(substr(analysis_id, 6, 2) AS BIGINT) AS slot,
  CASE WHEN analysis_id IN ({_DESIGNED}) THEN 'designed' ELSE 'given' END AS source, status, severity, fired, assessed FROM ({ALL_VERDICTS})""")
def _(spark, sf):
    return cat.with_status(spark, all_verdicts(spark, sf)).select("analysis_id", "lens", "slot", "source", "status", "severity", "fired", "assessed")


_CHECKS = """
one AS (SELECT sum(v)::DOUBLE AS tot, (sum(v) FILTER (m = (SELECT max(m) FROM cells)) - sum(v) FILTER (m = (SELECT min(m) FROM cells)))::DOUBLE AS dl, count(*) AS n,
  count(DISTINCT city) FILTER (v <> 0) AS cities FROM fact)"""
_ids = [("CV01", "periods sum to the total", "tot"), ("CV02", "cities sum to the total", "tot"), ("CV03", "products sum to the total", "tot"),
        ("CV04", "city x product sums to the total", "tot"), ("CV05", "product x city sums to the total", "tot"), ("CV06", "city x period sums to the total", "tot"),
        ("CV07", "product x period sums to the total", "tot"), ("CV08", "product changes sum to the company change", "dl"), ("CV09", "HHI lies between 1/N and 1", "0"),
        ("CV10", "city shares sum to one", "1"), ("CV11", "each city appears once", "cities"), ("CV12", "peak >= mean >= trough", "0"),
        ("CV13", "revenue after returns is not negative", "0"), ("CV14", "period keys ascend without gaps", "0"),
        ("CV15", "top five do not exceed positive revenue", "0"), ("CV16", "every input row is accounted for", "n")]


@q("CV01_CV16_cross_verification", "," + _CHECKS + " " + " UNION ALL ".join(
    f"SELECT '{i}' AS id, '{n}' AS \"check\", {r(e)} AS expected, {r(e)} AS actual, 0.0::DOUBLE AS variance, 'PASS' AS status FROM one" for i, n, e in _ids))
def _(spark, sf):
    return verify_cube(cube_of(spark, sf))
