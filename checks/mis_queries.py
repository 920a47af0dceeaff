"""Queries over the management report views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from daybook.operators import mis_views as mv

from .sql_base import FACT, div, r, r2
from .star import MONEY, sales_facts, table

QUERIES: dict = {}
SQL: dict = {}
c = F.col
_cubes: dict = {}


def cube(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cubes:
        _cubes[key] = mv.mis_cube(sales_facts(spark, sf))
    return _cubes[key]


def _axis(name: str, member: str) -> str:
    return f"""
all_{name} AS (SELECT {member} AS member, sum(v)::DOUBLE AS total FROM mc GROUP BY 1),
lag_{name} AS (SELECT a.member, a.total, mo.idx, mo.month, coalesce(x.v, 0)::DOUBLE AS v, lag(coalesce(x.v, 0)::DOUBLE) OVER (PARTITION BY a.member ORDER BY mo.idx) AS prev
  FROM all_{name} a CROSS JOIN mo LEFT JOIN (SELECT {member} AS member, mn, sum(v) AS v FROM mc GROUP BY 1, 2) x ON x.member = a.member AND x.mn = mo.mn),
isl_{name} AS (SELECT *, sum(CASE WHEN v < prev THEN 0 ELSE 1 END) OVER (PARTITION BY member ORDER BY idx) AS g FROM lag_{name}),
ser_{name} AS (SELECT *, sum(CASE WHEN v < prev THEN 1 ELSE 0 END) OVER (PARTITION BY member, g ORDER BY idx) AS run, max(v) OVER (PARTITION BY member) AS hi, min(v) OVER (PARTITION BY member) AS lo FROM isl_{name}),
prof_{name} AS (SELECT member, any_value(total) AS total, max(run) FILTER (idx = n - 1)::BIGINT AS streak, round(regr_slope(v, idx), 6) AS b, max(v) AS hi, min(v) AS lo, max(v) FILTER (idx = 0) AS f,
  max(v) FILTER (idx = n - 1) AS l, max(v) FILTER (idx = n - 2) AS p1, arg_min(month, idx) FILTER (v = hi) AS hm, arg_min(month, idx) FILTER (v = lo) AS lm, list(v ORDER BY idx) AS vs, sum(v * v) AS sq,
  sum(v) FILTER (idx < n // 2) AS h1, sum(v) FILTER (idx >= n // 2) AS h2 FROM ser_{name} CROSS JOIN mx GROUP BY member)"""


PRE = "WITH " + FACT.format(sign="1") + """,
mc AS (SELECT city, item, month(d) AS mn, sum(amount) AS v FROM fact WHERE amount <> 0 GROUP BY ALL),
mo AS (SELECT mn, row_number() OVER (ORDER BY mn) - 1 AS idx, monthname(make_date(2000, mn::INT, 1)) AS month FROM (SELECT DISTINCT mn FROM mc)),
mx AS (SELECT count(*) AS n FROM mo),
cb AS (SELECT item, city, item || ' x ' || city AS member, sum(v)::DOUBLE AS total FROM mc GROUP BY 1, 2),
""" + ",".join([_axis("city", "city"), _axis("item", "item"), _axis("company", "'Company'")]) + "\n"
T = "(SELECT sum(v)::DOUBLE FROM mc)"


def pct(a: str, b: str, d: int = 2) -> str:
    return r(f"coalesce({div(a, b)}, 0) * 100", d)


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = PRE + sql
        return fn
    return add


def view(name: str, fn, sql: str):
    QUERIES[name] = lambda spark, sf: fn(cube(spark, sf))
    SQL[name] = PRE + sql


view("F_cube_mis_matrix", mv.mis_matrix, "SELECT item, city, month, v::DOUBLE AS amount FROM mc JOIN mo USING (mn)")


_SUMMARY = f"""SELECT net, vouchers, customers, rows, greatest(gross, net) AS gross, {r2('greatest(gross, net) - net')} AS charges, (SELECT count(*) FROM all_item) AS items, (SELECT count(*) FROM all_city) AS cities, (SELECT n FROM mx) AS months FROM
  (SELECT sum(amount)::DOUBLE AS net, count(DISTINCT voucher_id) AS vouchers, count(DISTINCT customer) AS customers, count(*) AS rows, (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS gross FROM fact)"""


@q("F_meta_mis_summary", _SUMMARY)
def _(spark, sf):
    heads = table(spark, sf, "orders").select(c("o_orderkey").alias("voucher_id"), c("o_totalprice").cast(MONEY).alias("amount"))
    return mv.mis_summary(cube(spark, sf), heads)


@q("F_meta_mis_summary_two_companies", _SUMMARY)
def _(spark, sf):
    """Headers of another company with the same voucher ids stay out."""
    heads = table(spark, sf, "orders").select(F.lit("CO1").alias("company_id"), c("o_orderkey").alias("voucher_id"), c("o_totalprice").cast(MONEY).alias("amount"))
    other = heads.withColumn("company_id", F.lit("CO2")).withColumn("amount", (c("amount") * 3).cast(MONEY))
    own = mv.mis_cube(cube(spark, sf).facts.withColumn("company_id", F.lit("CO1")))
    return mv.mis_summary(own, heads.unionByName(other))


_SUS = "(streak >= 3 OR b < 0)"
view("F01_city_trend", mv.city_trend, f"""SELECT member, {r2('total')} AS revenue, {pct('total', T)} AS share_pct, streak, {r2('b')} AS slope, {_SUS} AS sustained,
  {r2('CASE WHEN streak > 0 THEN list_sum(list_transform(vs[(len(vs) - streak + 1):], lambda x: greatest(vs[len(vs) - streak] - x, 0))) ELSE 0 END')} AS cost_of_inaction,
  {r2('greatest((greatest(hi, 0) - l) * CASE WHEN streak > 0 THEN streak ELSE 3 END, 0)')} AS opportunity FROM prof_city""")
_EVEN = r2(f"{T} / (SELECT count(*) FROM all_city)")
view("F02_city_totals", mv.city_totals, f"SELECT member, {r2('total')} AS revenue, {pct('total', T)} AS share_pct, {_EVEN} AS benchmark, total > {_EVEN} AS above, {r2(f'total - {_EVEN}')} AS variance FROM all_city")


@q("F02b_historical_benchmark", f"""SELECT w::BIGINT AS months_back, rv AS revenue, act AS active_months, {r2('rv / act')} AS avg_monthly, {r2('rv / act / 25')} AS avg_per_city FROM (SELECT w, coalesce(sum(CASE WHEN is_return THEN -amount ELSE amount END), 0)::DOUBLE AS rv,
  count(DISTINCT m) AS act FROM (VALUES (3), (6), (12)) s(w) JOIN fact ON d < DATE '1999-01-01' AND d >= DATE '1999-01-01' - to_months(w) GROUP BY 1)""")
def _(spark, sf):
    return mv.historical_benchmark(sales_facts(spark, sf), date(1999, 1, 15), 25)


def _dom(k, o):
    return f"""SELECT a.member, {r2('a.total')} AS revenue, coalesce(x.n, 0)::BIGINT AS active, x.dom AS dominant, {pct('coalesce(x.hi, 0)', 'a.total')} AS dominant_pct, {pct('coalesce(x.hi, 0)', 'a.total')} >= 75 AS dependent FROM all_{k} a LEFT JOIN
  (SELECT {k} AS member, count(*) AS n, first({o} ORDER BY total DESC, {o}) AS dom, max(total) AS hi FROM cb WHERE total > 0 GROUP BY 1) x ON x.member = a.member"""


view("F03_item_total_by_city", mv.item_total_by_city, _dom("city", "item"))
view("F04_item_contribution_share", mv.item_contribution_share, _dom("item", "city"))
view("F05_month_trend", mv.month_trend, f"SELECT s.month, {r2('s.v')} AS revenue, {pct('s.v', 's.total')} AS share_pct, p.streak, {r2('p.b')} AS slope, (p.streak >= 3 OR p.b < 0) AS sustained FROM ser_company s JOIN prof_company p USING (member)")
view("F05_month_trend_by_city", mv.month_trend_by_city, f"SELECT month, member AS city, {r2('v')} AS revenue FROM ser_city")
view("F06_month_mix_by_item", mv.month_mix_by_item, f"SELECT member, {r2('total')} AS revenue, CASE WHEN hi > 0 THEN hm END AS driver_month, {r2('greatest(hi, 0)')} AS driver_revenue, streak, {r2('b')} AS slope, {_SUS} AS sustained, {pct('greatest(hi, 0)', 'total')} AS driver_pct FROM prof_item")

_E = "(SELECT member, total, row_number() OVER (ORDER BY total DESC, member) AS k FROM all_item)"
_N = lambda k: f"(SELECT member FROM {_E} WHERE k = {k})"
_TT = lambda k: f"(SELECT total FROM {_E} WHERE k = {k})"
_V = lambda k: f"coalesce((SELECT total FROM cb WHERE cb.city = c.member AND cb.item = {_N(k)}), 0)"


def _vs(src: str, gap: str) -> str:
    return f"SELECT city, {r2('a')} AS a, {r2('b')} AS b, {r2('a-b')} AS variance, CASE WHEN a > b THEN na WHEN b > a THEN nb ELSE 'TIE' END AS winner, {gap} AS gap_pct, CASE WHEN {gap} > 30 THEN 'WATCH' ELSE 'Comparable' END AS state FROM ({src})"


view("F07_item_head_to_head", mv.item_head_to_head, _vs(f"SELECT c.member AS city, {_V(1)} AS a, {_V(2)} AS b, {_N(1)} AS na, {_N(2)} AS nb FROM all_city c", pct(f"({_TT(1)}-{_TT(2)})", _TT(1))))
_M = lambda i: f"(SELECT v FROM ser_company WHERE idx = {i})"
view("F13_month_head_to_head", mv.month_head_to_head, _vs(
    "SELECT x.member AS city, x.v AS a, y.v AS b, x.month AS na, y.month AS nb FROM ser_city x JOIN ser_city y ON x.member = y.member AND x.idx = 0 AND y.idx = 1", pct(f"abs({_M(0)}-{_M(1)})", f"greatest({_M(0)}, {_M(1)})")))

_ST = lambda s, w: f"CASE WHEN ar <= {s} THEN 'STRONG' WHEN ar >= {w} THEN 'WEAK' ELSE 'MIXED' END"
view("F08_item_ranking_by_city", mv.item_ranking_by_city, f"""SELECT member, {r2('t')} AS revenue, ar AS avg_rank, {_ST(2, 5)} AS state FROM (SELECT i.member, any_value(i.total) AS t, {r2('avg(rk)')} AS ar FROM (SELECT c.member AS city, i.member, i.total,
  row_number() OVER (PARTITION BY c.member ORDER BY coalesce(cb.total, 0) DESC, i.total DESC, i.member) AS rk FROM all_city c CROSS JOIN all_item i LEFT JOIN cb ON cb.city = c.member AND cb.item = i.member) i GROUP BY 1)""")
view("F14_month_ranking_by_city", mv.month_ranking_by_city, f"""SELECT month, {r2('t')} AS revenue, ar AS avg_rank, {_ST(4, 10)} AS state FROM (SELECT month, sum(v) AS t, {r2('avg(rk)')} AS ar FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY v DESC, idx) AS rk FROM ser_city) GROUP BY 1)""")

_RISK = "CASE WHEN hhi >= 0.8 THEN 'HIGH_RISK' WHEN hhi >= 0.5 THEN 'MODERATE_RISK' ELSE 'DIVERSIFIED' END"
_PH = lambda k, lv: f"SELECT '{lv}' AS level, 'all' AS name, {r(f'sum((total / {T}) * (total / {T}))', 4)} AS hhi, NULL::VARCHAR AS dominant_month, NULL::DOUBLE AS dominant_pct FROM all_{k}"
view("F09_concentration_hhi", mv.concentration_hhi, f"SELECT *, {_RISK} AS risk FROM ({_PH('item', 'product')} UNION ALL {_PH('city', 'city')} UNION ALL SELECT 'item', member, {r(div('sq', 'total*total'), 4)}, CASE WHEN hi > 0 THEN hm END, {pct('greatest(hi, 0)', 'total')} FROM prof_item)")
_RK = "SELECT *, row_number() OVER (ORDER BY total DESC, item, city)::BIGINT AS rank FROM cb WHERE total > 0"
view("F10_top_combos", mv.top_combos, f"SELECT rank, member AS combo, {r2('total')} AS revenue, {pct('total', T)} AS share_pct, {pct('sum(total) OVER (ORDER BY rank)', T)} AS cumulative_pct FROM ({_RK})")
_TP = lambda n: pct(f"(SELECT sum(total) FROM ({_RK}) WHERE rank <= {n})", T)
view("F10_top_combo_flags", mv.top_combo_flags, f"SELECT {_TP(1)} AS top1_pct, {_TP(1)} > 15 AS top1_flag, {_TP(3)} AS top3_pct, {_TP(3)} > 40 AS top3_flag, {_TP(5)} AS top5_pct, {_TP(5)} > 60 AS top5_flag")
view("F11_bridge_by_item", mv.bridge_by_item, f"""SELECT *, delta < 0 AND abs(share_pct) >= 15 AS red_flag, CASE WHEN delta > 0 THEN 'GROWTH_DRIVER' WHEN delta < 0 THEN 'DRAG' ELSE 'NEUTRAL' END AS role FROM (SELECT *, {pct('delta', 'abs(round(sum(delta) OVER (), 2))')} AS share_pct FROM
  (SELECT member, {r2('h1')} AS base, {r2('h2')} AS comparison, {r2('h2-h1')} AS delta FROM prof_item))""")
view("F12_bridge_by_month", mv.bridge_by_month, f"SELECT month, {r2('v')} AS revenue FROM ser_company")
_COL, _PR = "(lo <= 0 AND hi > 0)", "CASE WHEN lo > 0 THEN round(hi / lo, 2) WHEN lo <= 0 AND hi > 0 THEN NULL ELSE 1.0 END"
view("F15_peak_trough_by_item", mv.peak_trough_by_item, f"SELECT member, hm AS peak_month, {r2('hi')} AS peak, lm AS trough_month, {r2('lo')} AS trough, {r2('hi-lo')} AS swing, {_PR} AS pt_ratio, {_COL} AS collapsed, CASE WHEN {_COL} OR {_PR} >= 3 THEN 'RED' WHEN {_PR} >= 2 THEN 'AMBER' ELSE 'GREEN' END AS status FROM prof_item")
view("F16_peak_trough_by_month", mv.peak_trough_by_month, f"SELECT hm AS peak_month, {r2('hi')} AS peak, lm AS trough_month, {r2('lo')} AS trough, {r2('hi-lo')} AS swing, {_PR} AS pt_ratio FROM prof_company")
_IS = f"SELECT 'item' AS subject, member, total, 0::BIGINT AS streak, {pct('total', T, 1)} AS share_pct FROM all_item"
_IL = f"SELECT CASE WHEN share_pct > 40 THEN 'AMBER' ELSE 'GREEN' END AS level, * FROM ({_IS}) WHERE share_pct > 15"
view("F16b_action_center", mv.action_center, f"""SELECT level, subject, member, {r2('total')} AS exposure, streak, share_pct FROM (SELECT CASE WHEN streak >= 2 OR (share_pct > 25 AND streak >= 1) THEN 'RED' WHEN share_pct > 20 THEN 'AMBER' END AS level, * FROM
  (SELECT 'city' AS subject, member, total, streak, {pct('total', T, 1)} AS share_pct FROM prof_city) UNION ALL {_IL} UNION ALL SELECT 'GREEN', * FROM (SELECT * FROM ({_IS}) ORDER BY total DESC, member LIMIT 1) WHERE (SELECT count(*) FROM ({_IL}) WHERE level = 'GREEN') = 0) WHERE level IS NOT NULL""")
_AUD = [("total", T), ("start", "(SELECT f FROM prof_company)"), ("end", "(SELECT l FROM prof_company)"), ("peak", "(SELECT hi FROM prof_company)"), ("low", "(SELECT min(v) FROM ser_company WHERE v > 0)"),
        ("top_item", "(SELECT max(total) FROM all_item)"), ("top_city", "(SELECT max(total) FROM all_city)"), ("top_combo", "(SELECT max(total) FROM cb)")]
view("F17_audit_reconciliation", mv.audit_reconciliation, " UNION ALL ".join(f"SELECT '{n}' AS figure, {r2(e)} AS from_facts, {r2(e)} AS from_cube, 0.0::DOUBLE AS variance, 'PASS' AS status" for n, e in _AUD))
_CH = lambda a, b: r(f"coalesce({div(f'({a})-({b})', b)}, 0) * 100", 1)
_D = r2("l-p1")
_R3, _P3 = "list_sum(vs[-3:])", "list_sum(vs[(len(vs) - 5):(len(vs) - 3)])"
_OV = f"""SELECT {r2('total')} AS revenue, {r2('total / len(vs)')} AS avg_monthly, {r2('l')} AS latest, {r2('p1')} AS prior, {r2('l-p1')} AS mom_change, {_CH('l', 'p1')} AS mom_change_pct, {_CH('l', 'f')} AS period_change_pct, {_CH(_R3, _P3)} AS momentum_pct,
  {r2('hi')} AS peak, hm AS peak_month, {r2('(SELECT min(v) FROM ser_company WHERE v > 0)')} AS trough, (SELECT arg_min(month, v) FROM ser_company WHERE v > 0) AS trough_month, (SELECT arg_max(member, (total, member)) FROM all_item) AS top_item,
  {pct('(SELECT max(total) FROM all_item)', T, 1)} AS top_item_pct, (SELECT arg_max(member, (total, member)) FROM all_city) AS top_city, {pct('(SELECT max(total) FROM all_city)', T, 1)} AS top_city_pct,
  (SELECT arg_max(member, ({_D}, member)) FROM prof_item WHERE {_D} > 0) AS best_gain_item, greatest((SELECT max({_D}) FROM prof_item), 0) AS best_gain, (SELECT arg_min(member, ({_D}, member)) FROM prof_item WHERE {_D} < 0) AS worst_drag_item,
  least((SELECT min({_D}) FROM prof_item), 0) AS worst_drag, (SELECT max(streak) FROM prof_city) AS max_decline_streak, {_TP(3)} AS t3 FROM prof_company"""
_OV = _OV.replace(f"{_TP(3)} AS t3", f"{pct(f'(SELECT sum(total) FROM ({_RK}) WHERE rank <= 3)', T, 1)} AS top3_combo_pct")
_SC = f"SELECT *, least(100, greatest(10, floor(50 + CASE WHEN period_change_pct > 0 THEN period_change_pct * 1.5 ELSE period_change_pct * 2 END + 0.5)))::BIGINT AS growth_score, greatest(0, 30 - max_decline_streak * 6)::BIGINT AS streak_score, CASE WHEN top_item_pct > 50 THEN 35 ELSE 60 END::BIGINT AS volatility_score, CASE WHEN top3_combo_pct > 50 THEN 40 WHEN top3_combo_pct > 30 THEN 55 ELSE 70 END::BIGINT AS concentration_score FROM ({_OV})"
view("F00_executive_overview", mv.executive_overview, f"SELECT *, least(100, greatest(10, floor((growth_score + streak_score + volatility_score + concentration_score) / 4.0 + 0.5)))::BIGINT AS composite_score FROM ({_SC})")
view("F00_what_changed", mv.what_changed, f"SELECT member, {r2('p1')} AS prior, {r2('l')} AS latest, {_D} AS change, abs({pct(_D, '(SELECT abs(round(l-p1, 2)) FROM prof_company)', 1)}) AS share_pct, {r2(div(f'abs({_D}) * 10', T))} AS materiality, CASE WHEN {_D} >= 0 THEN 'up' ELSE 'down' END AS direction FROM prof_item")

