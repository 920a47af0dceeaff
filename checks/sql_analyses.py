"""SQL counterpart of every catalogue operator, keyed by operator name."""

from __future__ import annotations

from .sql_base import N, T, One, Rows, a_only, ar, div, lbl, pos, r, r2

PROD, MONTH = "product", "month"


def ax(p: dict) -> str:
    return "city" if p["axis"].key == "city" else "grp"


def prof(p: dict) -> str:
    return f"prof_{ax(p)}"


def inact(change: str) -> str:
    return f"(CASE WHEN {change} < 0 THEN -({change}) / 12 * 3 END)"


def way(x: str, flat: str = "Flat") -> str:
    return f"(CASE WHEN {x} > 0 THEN 'Growing' WHEN {x} < 0 THEN 'Declining' ELSE '{flat}' END)"


def amber_if(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 'AMBER' ELSE 'GREEN' END)"


S: dict = {}


def op(fn):
    S[fn.__name__] = fn
    return fn


NOB: list = []

# --- trend -----------------------------------------------------------------------------


@op
def decline_streak(p):
    return Rows(f"SELECT member, {r2('total')} AS revenue, streak, {r2('b')} AS slope, {r(inact('(l-f)'))} AS coi FROM {prof(p)}",
                "streak", ar(2, 3), "max(streak)", r2("sum(coi)"))


@op
def latest_growth(p):
    return Rows(f"SELECT member, {r2('total')} AS revenue, {r('g')} AS growth, CASE WHEN g IS NULL THEN 'No prior month' ELSE {way('g')} END AS direction, g "
                f"FROM (SELECT *, {div('l-p1', 'abs(p1)')} AS g FROM {prof(p)})", pos("-g"), ar(0.05, 0.10),
                r("min(CASE WHEN g < 0 THEN g END)"), drop=("g",))


@op
def rolling_momentum(p):
    return Rows(f"SELECT member, {r2('rec')} AS recent, {r2('pri')} AS prior, {r('ch')} AS change, ch FROM "
                f"(SELECT *, {div('rec-pri', 'abs(pri)')} AS ch FROM {prof(p)})", pos("-ch"), ar(0.05, 0.10), r("min(ch)"), drop=("ch",))


@op
def peak_gap(p):
    return Rows(f"SELECT member, {r2('pk')} AS peak, {lbl('pki')} AS peak_month, {r2('l')} AS current, {r2('l-pk')} AS gap, {r('gp')} AS gap_pct, gp "
                f"FROM (SELECT *, {div('l-pk', 'abs(pk)')} AS gp FROM {prof(p)})", pos("-gp"), ar(0.2, 0.4, 0.6), r("min(gp)"),
                r2("sum(CASE WHEN gap < 0 THEN -gap END)"), drop=("gp",))


@op
def share_shift(p):
    q = (f"SELECT member, {r('a')} AS start_share, {r('b2')} AS end_share, {r('b2-a')} AS shift, b2-a AS d FROM (SELECT q.member, "
         f"{div('q.f', 'c.f')} AS a, {div('q.l', 'c.l')} AS b2 FROM {prof(p)} q CROSS JOIN any_company c)")
    return Rows(q, pos("-d"), ar(0.05, 0.10), r("CASE WHEN min(d) < 0 THEN max(abs(d)) END"), drop=("d",))


@op
def volatility_cv(p):
    cv = div("sd", "abs(mean)")
    return Rows(f"SELECT member, {r('mean')} AS mean, {r2('sd')} AS std_dev, {r('cv0')} AS cv, CASE WHEN cv0 IS NULL THEN 'Not assessed' "
                f"WHEN cv0 >= 0.3 THEN 'HIGH VOLATILITY' WHEN cv0 >= 0.15 THEN 'MODERATE' ELSE 'STABLE' END AS flag, cv0 FROM (SELECT *, {cv} AS cv0 FROM {prof(p)})",
                "cv0", ar(0.15, 0.30), r("max(cv0)"), drop=("cv0",))


@op
def top_n_dependency(p):
    n = p["n"]
    bands = ar(0.70, 0.80) if p["threshold"] == "TOP2_DEPENDENCY" else ar(0.60, 0.75)
    rk = f"SELECT *, row_number() OVER (ORDER BY total DESC, member) AS k, count(*) OVER () AS c FROM {prof(p)}"
    return One(f"SELECT member, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct, CASE WHEN k <= {n} THEN 'Yes' ELSE 'No' END AS in_top_n FROM ({rk})",
               f"SELECT CASE WHEN max(c) >= 2 THEN {div(f'sum(total) FILTER (k <= {n})', T)} END AS m FROM ({rk})", "m", bands, r("m"))


@op
def trend_slope(p):
    m = div(pos("-b"), "abs(mean)")
    return Rows(f"SELECT member, {r2('b')} AS slope, {r2(f'b*{N}')} AS projected, CASE WHEN b = 0 THEN 'Flat' WHEN b > 0 THEN 'Upward' WHEN {m} >= 0.005 "
                f"THEN 'Steep Decline' ELSE 'Declining' END AS direction, {m} AS mm, b AS bb FROM {prof(p)}", "mm", ar(0.005, 0.01), r2("min(bb)"), drop=("mm", "bb"))


MONTHS = "SELECT s.idx, mon.key AS period, mon.lbl AS month, s.v AS revenue, s.prev FROM ser_company s JOIN mon ON mon.idx = s.idx"


@op
def company_trend(p):
    return One(f"SELECT month, {r2('revenue')} AS revenue, {r(div('revenue-prev', 'abs(prev)'))} AS mom, {amber_if('revenue < prev')} AS status FROM ({MONTHS})",
               f"SELECT l-f AS c, {div('l-f', 'abs(f)')} AS g FROM any_company", pos("-g"), ar(0.05, 0.10, 0.20), r2("c"), r2(inact("c")))


@op
def growth_decline_balance(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct, {way('b')} AS direction, {amber_if('b < 0')} AS status FROM {prof(p)}",
               f"SELECT {div('count(*) FILTER (b < 0)', 'count(*)')} AS m, count(*) FILTER (b > 0) AS up FROM {prof(p)}", "m", ar(0.5, 0.75), "up")


@op
def monthly_concentration(p):
    m = "(CASE WHEN tr > 0 THEN pk / tr WHEN pk > 0 THEN 99 ELSE 1 END)"
    return One(f"SELECT month, {r2('revenue')} AS revenue, {r(f'CASE WHEN {T} > 0 THEN revenue / {T} ELSE 0 END')} AS share_pct FROM ({MONTHS})",
               f"SELECT {m} AS m FROM any_company", "m", ar(1.5, 2.0), r2("m"))


@op
def front_vs_back(p):
    f = (f"SELECT *, CASE WHEN a1 > 0 THEN (a2 - a1) / a1 ELSE 0 END AS d FROM (SELECT h1, h2, h1 / ceil({N} / 2.0) AS a1, "
         f"h2 / ({N} - ceil({N} / 2.0)) AS a2 FROM any_company)")
    t = (f"SELECT 'First Half (P1-P' || ceil({N}/2.0)::INT || ')' AS period, {r2('h1')} AS revenue, {r('a1')} AS avg_monthly, {r(div('h1', T))} AS share_pct FROM ({f}) "
         f"UNION ALL SELECT 'Second Half (P' || (ceil({N}/2.0)::INT + 1) || '-P' || {N} || ')', {r2('h2')}, {r('a2')}, {r(div('h2', T))} FROM ({f})")
    return One(t, f, "d", ar(-0.05, -0.15), r("d"), r2("CASE WHEN d < 0 THEN a1 - a2 END"), lower=True)


@op
def monthly_volatility(p):
    return Rows(f"SELECT member, {r('mean')} AS mean, {r2('coalesce(sd, 0)')} AS std_dev, {r('cv0')} AS cv, cv0 FROM (SELECT *, coalesce({div('sd', 'abs(mean)')}, 0) AS cv0 FROM any_{ax(p)})",
                "cv0", ar(0.2, 0.3), r("max(cv0)"), drop=("cv0",))


@op
def latest_vs_average(p):
    f = "SELECT l, mean, CASE WHEN mean > 0 THEN (l - mean) / mean ELSE 0 END AS g FROM any_company"
    return One(f"SELECT {r2('l')} AS latest, {r('mean')} AS average, {r('g')} AS variance_pct FROM ({f})", f, "g", ar(-0.10, -0.20), r("g"),
               r2("CASE WHEN g < 0 THEN mean - l END"), lower=True)


@op
def recent_3m_share(p):
    f = f"SELECT l + p1 + p2 AS t3, CASE WHEN total > 0 THEN (l + p1 + p2) / total ELSE 0 END AS a, 3.0::DOUBLE / {N} AS e FROM any_company"
    return One(f"SELECT {r2('t3')} AS recent_3m, {r('a')} AS share_pct, {r('e')} AS expected_pct, {r('a-e')} AS delta_pp FROM ({f})", f, "a-e",
               ar(-0.03, -0.06), r("a"), lower=True)


@op
def mom_consistency(p):
    f = f"""SELECT up, down, longest, up::DOUBLE / ({N} - 1) AS g FROM (SELECT count(*) FILTER (v > prev) AS up, count(*) FILTER (v < prev) AS down FROM ser_company)
      CROSS JOIN (SELECT coalesce(max(c), 0)::BIGINT AS longest FROM (SELECT k, count(*) FILTER (fell) AS c FROM (SELECT fell, sum(CASE WHEN fell THEN 0 ELSE 1 END)
      OVER (ORDER BY idx) AS k FROM (SELECT idx, v < prev AS fell FROM ser_company WHERE v <> prev)) GROUP BY k))"""
    return One(f"SELECT up, down, longest, {r('g')} AS consistency FROM ({f})", f, "g", ar(0.50, 0.35), r("g"), lower=True)


@op
def rank_stability(p):
    f = (f"SELECT member, row_number() OVER (ORDER BY f DESC, total DESC, member)::BIGINT AS rank_first, "
         f"row_number() OVER (ORDER BY l DESC, total DESC, member)::BIGINT AS rank_latest FROM any_{ax(p)}")
    return One(f"SELECT *, rank_first - rank_latest AS rank_change, {amber_if('rank_latest > rank_first')} AS status FROM ({f})",
               f"SELECT greatest(max(rank_latest - rank_first), 0) AS m FROM ({f})", "m", ar(1, 2), "m")


@op
def quarterly_trajectory(p):
    f = "SELECT *, CASE WHEN lag(v) OVER (ORDER BY q) > 0 THEN (v - lag(v) OVER (ORDER BY q)) / lag(v) OVER (ORDER BY q) END AS c FROM (SELECT idx // 3 AS q, sum(v) AS v FROM ser_company GROUP BY 1)"
    return One(f"SELECT (q + 1)::BIGINT AS quarter, {r2('v')} AS revenue, {r('c')} AS qoq, {amber_if('c < 0')} AS status FROM ({f})",
               f"SELECT count(*) FILTER (c < 0) AS m FROM ({f})", "m", ar(1, 2), "m")


@op
def cross_city_sync(p):
    f = f"SELECT member, {way('(l-p1)')} AS latest_direction, {way('(p1-p2)')} AS prior_direction FROM any_{ax(p)}"
    return One(f"SELECT *, CASE WHEN latest_direction <> prior_direction THEN 'Yes' ELSE 'No' END AS changed, {amber_if(chr(39).join(['latest_direction = ', 'Declining', '']))} AS status FROM ({f})",
               f"SELECT (count(*) FILTER (latest_direction = 'Growing') > 0 AND count(*) FILTER (latest_direction = 'Declining') > 0)::INT::DOUBLE AS m FROM ({f})",
               "m", a_only(1), "m")


@op
def latest_vs_peak(p):
    f = "SELECT pk, pki, l, CASE WHEN pk > 0 THEN l / pk ELSE 1 END AS m FROM any_company"
    return One(f"SELECT {r2('pk')} AS peak, {lbl('pki')} AS peak_month, {r2('l')} AS latest, {r2('pk-l')} AS gap, {r('m')} AS share_of_peak FROM ({f})",
               f, "m", ar(0.85, 0.70), r("m"), r2("pk-l"), lower=True)


@op
def growth_decline_impact(p):
    d = r2("l-f")
    return One(f"SELECT member, {r2('f')} AS start_revenue, {r2('l')} AS end_revenue, {d} AS delta, {way(d)} AS direction, {amber_if(d + ' < 0')} AS status FROM {prof(p)}",
               f"SELECT {r2('sum(l-f)')} AS m FROM {prof(p)}", "m", ar(0, -20000), "m", "CASE WHEN m < 0 THEN -m END", lower=True)


# --- concentration ---------------------------------------------------------------------


@op
def equal_share_benchmark(p):
    q = (f"SELECT member, {r2('total')} AS revenue, {r('e')} AS benchmark, {r('total-e')} AS deviation, {r(div('total-e', 'e'))} AS deviation_pct, "
         f"CASE WHEN total - e > 0 THEN 'ABOVE' ELSE 'BELOW' END AS flag, {div('total-e', 'e')} AS m, e FROM (SELECT *, {T} / count(*) OVER () AS e FROM {prof(p)})")
    return Rows(q, "abs(m)", ar(0.3, 0.5), r("max(e)"), drop=("m", "e"))


@op
def ranking_scale_gap(p):
    m = div("max(total)", "min(total)")
    return One(f"SELECT member, rank() OVER (ORDER BY total DESC)::BIGINT AS rank, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct, "
               f"{r(div('total', 'max(total) OVER ()'))} AS vs_largest FROM {prof(p)}", f"SELECT {m} AS m FROM {prof(p)}", "m", ar(3, 5), r2("m"))


@op
def hhi_index(p):
    sh = div("total", T)
    return One(f"SELECT member, {r2('total')} AS revenue, {r(sh)} AS share_pct, {r(f'{sh}*{sh}')} AS contribution FROM {prof(p)}",
               f"SELECT sum({sh}*{sh}) AS h, count(*) AS n FROM {prof(p)}", "h*n", ar(1.95, 3.25, 10.4), r("h"))


@op
def smallest_vs_largest(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r(div('total', 'max(total) OVER ()'))} AS vs_largest FROM {prof(p)}",
               f"SELECT {div('min(total)', 'max(total)')} AS m FROM {prof(p)}", "1-m", ar(0.6, 0.8), r("m"))


@op
def growth_summary(p):
    d = r2("l-f")
    return One(f"SELECT member, {r2('f')} AS first, {r2('l')} AS last, {d} AS change, {r(div('l-f', 'abs(f)'))} AS change_pct, {way(d)} AS direction, "
               f"{amber_if(d + ' < 0')} AS status FROM {prof(p)}",
               f"SELECT count(*) FILTER (l < f) AS dn, count(*) AS c, coalesce(sum(f-l) FILTER (l < f), 0) AS lost FROM {prof(p)}",
               div("dn", "c"), ar(0.5, 0.75), "dn", f"CASE WHEN lost > 0 THEN {r('lost / 12 * 3')} END")


@op
def average_per_period(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r('mean')} AS average, {r2('pk')} AS best, {r2('tr')} AS worst FROM {prof(p)}",
               "SELECT mean AS m FROM any_company", "0", NOB, r("m"))


@op
def multiple_of_smallest(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r2(div('total', 'min(total) OVER ()'))} AS multiple FROM {prof(p)}",
               f"SELECT {div('max(total)', 'min(total)')} AS m FROM {prof(p)}", "m", ar(2.5, 4), r2("m"))


@op
def revenue_by_direction(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r2('b')} AS slope, {way('b')} AS direction, {amber_if('b < 0')} AS status FROM {prof(p)}",
               f"SELECT {div('coalesce(sum(total) FILTER (b < 0), 0)', T)} AS m FROM {prof(p)}", "m", ar(0.5, 0.7), r("m"))


@op
def median_vs_mean(p):
    f = f"SELECT sum(total) / count(*) AS a, quantile_cont(total, 0.5) AS md FROM {prof(p)}"
    sk = div("a-md", "abs(a)")
    return One(f"SELECT {r('a')} AS mean, {r('md')} AS median, {r('a-md')} AS difference, {r(sk)} AS skew FROM ({f})", f, f"abs({sk})", ar(0.2, 0.4), r(sk))


@op
def quartile_classification(p):
    f = f"SELECT *, least(4, ((rk - 1) * 4) // c + 1) AS q FROM (SELECT *, rank() OVER (ORDER BY total DESC) AS rk, count(*) OVER () AS c FROM {prof(p)})"
    return One(f"SELECT member, rk::BIGINT AS rank, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct, ['Q1 Core','Q2 Strong','Q3 Developing','Q4 Marginal'][q] AS quartile, "
               f"{amber_if('q = 4')} AS status FROM ({f})", f"SELECT {div('coalesce(sum(total) FILTER (q = 4), 0)', T)} AS m FROM ({f})", "1-m", ar(0.85, 0.95), r("m"))


def hreg(p) -> str:
    k = ax(p)
    return f"""(SELECT q.*, h.hhi, h.dv FROM prof_{k} q LEFT JOIN (SELECT member, avg(h) AS hhi, avg(1 / nullif(h, 0)) AS dv FROM (
      SELECT {k} AS member, sum(v::DOUBLE * v::DOUBLE) / (sum(v)::DOUBLE * sum(v)::DOUBLE) AS h FROM cells GROUP BY city, grp HAVING sum(v) <> 0) GROUP BY 1) h ON h.member = q.member)"""


def hfacts(p) -> str:
    return (f"SELECT count(*) AS c, avg(hhi) AS av, max(hhi) AS hi, min(hhi) AS lo, sum(hhi) AS sm, sum(total * hhi) AS ex, count(*) FILTER (hhi > 0.1) AS k10, "
            f"count(*) FILTER (hhi > 0.15) AS k15 FROM {hreg(p)}")


@op
def hhi_register(p):
    return Rows(f"SELECT member, {r2('total')} AS revenue, {r('hhi')} AS hhi, {r2('dv')} AS diversification, {lbl('pki')} AS peak_month, "
                f"{r(div('pk', 'total'))} AS peak_share, hhi * {N} AS m FROM {hreg(p)}", "m", ar(1.95, 3.25, 10.4),
                "count(*) FILTER (status = 'RED')", drop=("m",))


@op
def highest_hhi(p):
    return One(f"SELECT member, {r('hhi')} AS hhi, {lbl('pki')} AS peak_month, {r(div('pk', 'total'))} AS peak_share FROM {hreg(p)}",
               hfacts(p), f"hi*{N}", ar(1.95, 2.6), r("hi"))


@op
def average_portfolio_hhi(p):
    return One(f"SELECT member, {r('hhi')} AS hhi, {r('hhi - avg(hhi) OVER ()')} AS vs_average FROM {hreg(p)}", hfacts(p), f"av*{N}",
               [(1.56, "AMBER", "LOW"), (1.95, "RED", "HIGH")], r("av"))


@op
def hhi_spread(p):
    return One(f"SELECT member, {r('hhi')} AS hhi, CASE WHEN hhi = max(hhi) OVER () THEN 'Most concentrated' WHEN hhi = min(hhi) OVER () THEN 'Most diversified' "
               f"ELSE '-' END AS position FROM {hreg(p)}", hfacts(p), f"(hi-lo)*{N}", a_only(0.65), r("hi-lo"))


@op
def above_hhi_limit(p):
    lim = p["limit"]
    return One(f"SELECT member, {r('hhi')} AS hhi, {r2('total')} AS revenue, CASE WHEN hhi > {lim} THEN 'Yes' ELSE 'No' END AS flag, {amber_if(f'hhi > {lim}')} AS status FROM {hreg(p)}",
               f"SELECT count(*) FILTER (hhi > {lim}) AS k, count(*) AS c, count(*) FILTER (hhi > 0.15) AS sv FROM {hreg(p)}",
               f"CASE WHEN sv > 0 THEN 2.0 ELSE {div('k', 'c')} END", [(0.5, "AMBER", "MEDIUM"), (2.0, "RED", "HIGH")], "k")


@op
def most_diversified(p):
    return One(f"SELECT member, {r('hhi')} AS hhi, {r2('dv')} AS diversification, {r2('total')} AS revenue FROM {hreg(p)}", hfacts(p), f"lo*{N}",
               ar(1.95, 3.25, 10.4), r("lo"))


@op
def hhi_weighted_exposure(p):
    return One(f"SELECT member, {r2('total')} AS revenue, {r('hhi')} AS hhi, {r2('total*hhi')} AS exposure FROM {hreg(p)}",
               f"SELECT count(*) FILTER (hhi > av) AS k, count(*) AS c, sum(total * hhi) AS ex FROM (SELECT *, avg(hhi) OVER () AS av FROM {hreg(p)})",
               div("k", "c"), a_only(2 / 3), "k", r2("CASE WHEN ex <> 0 THEN ex / 4 END"))


@op
def diversification_gap(p):
    e = f"(1.0::DOUBLE / {N})"
    return One(f"SELECT member, {r('hhi')} AS hhi, {r(e)} AS ideal, {r(f'hhi-{e}')} AS gap, {amber_if(f'hhi-{e} > 0.15')} AS status FROM {hreg(p)}", hfacts(p),
               div("hi", "lo"), [(1.5, "AMBER", "LOW"), (2.0, "RED", "HIGH")], r(div("hi", "lo")))


@op
def concentration_health(p):
    e = f"(1.0::DOUBLE / {N})"
    sc = f"greatest(0, least(100, 100 - k10 * 10 - (hi - {e}) * 500))"
    return One(f"SELECT {r('av')} AS average_hhi, {r('hi')} AS highest_hhi, {r(e)} AS ideal, k10 AS members_above, {r(sc, 4)} AS score FROM ({hfacts(p)})", hfacts(p),
               f"100-{sc}", ar(40, 50), r(sc, 4))


@op
def concentration_improvement(p):
    e = f"(1.0::DOUBLE / {N})"
    sh = "list_sum(list_transform(vs, lambda x: greatest(mean - x, 0)))"
    return One(f"SELECT member, {r('hhi')} AS hhi, {r(f'hhi-{e}')} AS excess, {r('mean')} AS average, {r2(sh)} AS shortfall FROM {hreg(p)}",
               f"SELECT sum(hhi) - {e} * count(*) AS x, sum({sh}) AS p FROM {hreg(p)}", f"x*{N}", a_only(1.3), r("x"), r2("CASE WHEN p <> 0 THEN p / 4 END"))


RC = "(SELECT *, row_number() OVER (ORDER BY total DESC, grp, city)::BIGINT AS rank FROM combos)"


@op
def top_n_combos(p):
    n = p["n"]
    bands = {1: ar(0.15, 0.25), 3: ar(0.40, 0.55), 5: ar(0.60, 0.75)}[n]
    m = div(f"sum(total) FILTER (rank <= {n})", T)
    return One(f"SELECT rank, member AS combo, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct, {r(div('sum(total) OVER (ORDER BY rank)', T))} AS cumulative "
               f"FROM {RC} QUALIFY rank <= {max(n, 10)}", f"SELECT {m} AS m FROM {RC}", "m", bands, r("m"))


@op
def adjacent_dropoff(p):
    f = f"SELECT *, lead(total) OVER (ORDER BY rank) AS nx FROM {RC} WHERE rank <= 10"
    return One(f"SELECT rank, member AS combo, {r2('total')} AS revenue, {r2('total-nx')} AS drop, {r(div('total-nx', 'total'))} AS drop_pct FROM ({f})",
               f"SELECT {div('total-nx', 'total')} AS m FROM ({f}) WHERE rank = 1", "m", ar(0.25, 0.5), r("m"))


@op
def representation_in_top_n(p):
    k = "grp" if p["facet"] == "group" else "city"
    f = f"SELECT a.member, t.c, t.s FROM all_{k} a LEFT JOIN (SELECT {k} AS member, count(*) AS c, sum(total) AS s FROM {RC} WHERE rank <= {p['n']} GROUP BY 1) t ON t.member = a.member"
    return One(f"SELECT member, coalesce(c, 0)::BIGINT AS appearances, {r2('coalesce(s, 0)')} AS revenue, CASE WHEN c IS NULL THEN 'AMBER' ELSE 'GREEN' END AS status FROM ({f})",
               f"SELECT count(c) AS pr, count(*) AS n FROM ({f})", f"1-{div('pr', 'n')}", ar(0.5, 0.7), "pr")


@op
def rank_gap(p):
    f = f"SELECT max(total) FILTER (rank = {p['high']}) AS h, arg_max(total, rank) AS l, count(*) AS c FROM {RC} WHERE rank <= {p['low']}"
    m = f"CASE WHEN c >= 2 THEN {div('h', 'l')} END"
    return One(f"SELECT rank, member AS combo, {r2('total')} AS revenue FROM {RC} WHERE rank <= {p['low']}", f, m, ar(5, 10), r2(m))


@op
def dominance_in_top_n(p):
    k = "grp" if p["facet"] == "group" else "city"
    f = f"SELECT {k} AS member, sum(total) AS t, count(*) AS combos, {div('sum(total)', 'sum(sum(total)) OVER ()')} AS sh FROM {RC} WHERE rank <= {p['n']} GROUP BY 1"
    return One(f"SELECT member, {r2('t')} AS revenue, {r('sh')} AS share_pct, combos FROM ({f})", f"SELECT max(sh) AS m FROM ({f})", "m", ar(0.5, 0.7), r("m"))


@op
def tail_risk(p):
    h = p["head"]
    m = f"CASE WHEN count(*) > {h} THEN {div(f'sum(total) FILTER (rank > {h})', T)} END"
    return One(f"SELECT rank, member AS combo, {r2('total')} AS revenue, {r(div('total', T))} AS share_pct FROM {RC} WHERE rank > {h}",
               f"SELECT {m} AS m FROM {RC}", "1-m", ar(0.75, 0.85), r("m"))


# --- contribution ----------------------------------------------------------------------


def brows(p) -> str:
    k = ax(p) if "axis" in p else "grp"
    return (f"(SELECT member, base, comparison, delta, CASE WHEN delta < 0 THEN {div('-delta', 'sum(CASE WHEN delta < 0 THEN -delta END) OVER ()')} END AS share, "
            f"CASE WHEN delta > 0 THEN 'GROWTH DRIVER' WHEN delta < 0 THEN 'DRAG' ELSE 'NEUTRAL' END AS role FROM (SELECT member, {r2('f')} AS base, {r2('l')} AS comparison, "
            f"{r2('l-f')} AS delta FROM any_{k} WHERE f <> 0 OR l <> 0))")


def bfacts(p) -> str:
    return (f"SELECT coalesce({r2('sum(-delta) FILTER (delta < 0)')}, 0) AS lost, coalesce({r2('sum(delta) FILTER (delta > 0)')}, 0) AS gained, count(*) FILTER (delta < 0) AS dn, "
            f"count(*) FILTER (delta > 0) AS up, count(*) AS c, {r2('sum(base)')} AS bt, {r2('sum(comparison)')} AS ct, {r2('sum(delta)')} AS net, min(delta) AS worst, "
            f"max(delta) AS best, max(abs(delta)) AS lg, {r2('sum(abs(delta))')} AS mv, stddev_samp(delta) AS sd FROM {brows(p)}")


def btable(p) -> str:
    return f"SELECT member, base, comparison, delta, {r('share')} AS share_of_decline, role, {amber_if('delta < 0')} AS status FROM {brows(p)}"


@op
def red_flags(p):
    return Rows(f"SELECT member, base, comparison, delta, {r('share')} AS share_of_decline, role, share FROM {brows(p)}", "share", ar(0.15, 0.30), r2("sum(delta)"),
                r(inact(r2("sum(delta)"))), drop=("share",))


@op
def largest_negative(p):
    w = "least(worst, 0)"
    return One(btable(p), bfacts(p), f"coalesce({div('-' + w, 'lost')}, 0)", ar(0.15, 0.30), w, r(inact(w)))


@op
def largest_positive(p):
    return One(btable(p), bfacts(p), "CASE WHEN up = 0 THEN 1.0 ELSE 0.0 END", ar(0.25, 0.5), "greatest(best, 0)")


@op
def net_movers(p):
    return One(btable(p), bfacts(p), div("dn", "c"), ar(0.5, 0.75), "up")


@op
def positive_vs_negative(p):
    t = (f"SELECT 'Growth' AS side, {r2('gained')} AS amount, up AS members FROM ({bfacts(p)}) UNION ALL SELECT 'Decline', {r2('-lost')}, dn FROM ({bfacts(p)}) "
         f"UNION ALL SELECT 'Net', {r2('net')}, c FROM ({bfacts(p)})")
    return One(t, bfacts(p), f"CASE WHEN lost <> 0 THEN greatest(0, {div('lost-gained', 'lost')}) END", ar(0.25, 0.5), "net", r(inact("net")))


@op
def contribution_imbalance(p):
    return One(btable(p), bfacts(p), div("lg", "mv"), ar(0.3, 0.5), r(div("lg", "mv")))


@op
def top_negative(p):
    f = f"SELECT sum(-delta) AS cc FROM (SELECT * FROM {brows(p)} WHERE delta < 0 ORDER BY delta, member LIMIT {p['n']})"
    f = f"SELECT cc, {div('cc', f'(SELECT lost FROM ({bfacts(p)}))')} AS m FROM ({f})"
    return One(btable(p), f, "m", [(0.70, "AMBER", "HIGH")], r("m"), f"CASE WHEN cc > 0 THEN {r('cc / 12 * 3')} END")


@op
def offset_capacity(p):
    cv = div("gained", "lost")
    return One(f"SELECT member, delta, role, {amber_if('delta < 0')} AS status FROM {brows(p)}", bfacts(p), f"CASE WHEN lost <> 0 THEN greatest(0, 1-{cv}) END", ar(0.25, 0.5), r2(cv))


@op
def change_vs_average(p):
    mult = div("abs(delta)", f"(SELECT {div('mv', 'c')} FROM ({bfacts(p)}))")
    m = div("lg", div("mv", "c"))
    return One(f"SELECT member, delta, {r2(mult)} AS multiple, role, {amber_if(f'delta < 0 AND {mult} > 2')} AS status FROM {brows(p)}", bfacts(p), m, ar(2, 3.5), r2(m))


def bsides(p) -> str:
    f = bfacts(p)
    return (f"SELECT 'base' AS side, {lbl('0')} AS period, bt AS revenue FROM ({f}) UNION ALL SELECT 'comparison', {lbl(f'{N}-1')}, ct FROM ({f}) "
            f"UNION ALL SELECT 'change', '', net FROM ({f})")


@op
def company_growth(p):
    g = div("net", "abs(bt)")
    return One(bsides(p), bfacts(p), pos(f"-{g}"), ar(0.05, 0.1, 0.2), r(g), r(inact("net")))


@op
def monthly_direction(p):
    return One(f"SELECT lbl AS month, {r2('v')} AS revenue, drun::BIGINT AS streak, {amber_if('drun >= 3')} AS status FROM ser_company JOIN mon USING (idx)",
               f"SELECT b, {div(pos('-b'), 'abs(mean)')} AS m FROM any_company", "m", ar(0.005, 0.01), r2("b"))


@op
def decline_persistence(p):
    return One(company_trend(p).table(), f"SELECT {r2('l-p1')} AS c FROM any_company", pos("-c"), a_only(0.01), "c")


@op
def break_even_timeline(p):
    f = f"SELECT l, b, CASE WHEN b < 0 THEN l * 0.2::DOUBLE / -b END AS mo, (SELECT net FROM ({bfacts(p)})) AS net FROM any_company"
    return One(f"SELECT {r2('l')} AS latest, {r('l*0.2::DOUBLE')} AS fifth, {r2('b')} AS slope, net AS bridge_change, {r('mo', 4)} AS months_left FROM ({f})", f,
               "CASE WHEN mo IS NOT NULL THEN greatest(0, 12 - mo) END", ar(0.01, 6), r("mo", 4), r(inact("net")))


@op
def change_distribution(p):
    m = f"CASE WHEN c >= 2 THEN {div('sd', div('mv', 'c'))} END"
    return One(btable(p), bfacts(p), m, a_only(1.5), r(m))


@op
def net_position(p):
    return One(bsides(p), bfacts(p), f"CASE WHEN bt = 0 OR net >= 0 THEN 0.0 ELSE {div('abs(net)', 'bt')} END", [(0.0000001, "RED", "HIGH"), (0.10, "RED", "CRITICAL")], "net", r(inact("net")))


@op
def recovery_potential(p):
    return One(btable(p), bfacts(p), f"CASE WHEN dn > 0 THEN {div('lost', 'bt')} END", ar(0.10, 0.20), "CASE WHEN dn > 0 THEN lost END", r2("CASE WHEN dn > 0 THEN lost * 3 END"))


@op
def monthly_bridge(p):
    d = r2("v-prev")
    return One(f"SELECT lbl AS month, {r2('v')} AS revenue, {d} AS delta, {amber_if(d + ' < 0')} AS status FROM ser_company JOIN mon USING (idx) WHERE idx > 0",
               f"SELECT {r2('l-f')} AS c, {div('len(list_filter(vs, lambda x: x = 0))', N)} AS e FROM any_company", "e", ar(0.25, 0.5), "c")


@op
def structural_limits(p):
    items = [(f"{N} < 2", "month-over-month movement: single period"), (f"{N} < 3", "3-month momentum: fewer than three periods"),
             (f"{N} < 6", "half-over-half comparison: fewer than six periods"),
             ("(SELECT count(*) FROM ser_company WHERE v = 0) > 0", "monthly bridge: months without revenue"),
             ("(SELECT count(*) FROM all_city) = 0", "city attribution: no city"), ("(SELECT count(*) FROM all_grp) = 0", "product attribution: no stock group")]
    t = " UNION ALL ".join(f"SELECT '{x}' AS limitation, 'Limited' AS state WHERE {cond}" for cond, x in items)
    return One(t, f"SELECT count(*) AS m FROM ({t})", "m", ar(1, 3), "m")


# --- comparison ------------------------------------------------------------------------


def pair(p) -> str:
    """city, a, b, city_total plus the names and totals of the two largest entities."""
    if p.get("mode") == MONTH:
        ents = "(SELECT idx, v AS total, row_number() OVER (ORDER BY v DESC, idx) AS k FROM ser_company)"
        one = lambda k: (f"(SELECT idx FROM {ents} WHERE k = {k})", f"(SELECT lbl FROM mon WHERE idx = (SELECT idx FROM {ents} WHERE k = {k}))", f"(SELECT total FROM {ents} WHERE k = {k})")
        (ka, na, ta), (kb, nb, tb) = one(1), one(2)
        val = lambda k: f"(SELECT v FROM ser_city s WHERE s.member = c.member AND s.idx = {k})"
        src = f"SELECT c.member AS city, {val(ka)} AS a, {val(kb)} AS b"
    else:
        ents = "(SELECT member, total, row_number() OVER (ORDER BY total DESC, member) AS k FROM all_grp)"
        one = lambda k: (f"(SELECT member FROM {ents} WHERE k = {k})", f"(SELECT member FROM {ents} WHERE k = {k})", f"(SELECT total FROM {ents} WHERE k = {k})")
        (ka, na, ta), (kb, nb, tb) = one(1), one(2)
        val = lambda k: f"coalesce((SELECT sum(v)::DOUBLE FROM cells x WHERE x.city = c.member AND x.grp = {k}), 0)"
        src = f"SELECT c.member AS city, {val(ka)} AS a, {val(kb)} AS b"
    return f"({src}, c.total AS city_total, {na} AS na, {nb} AS nb, {ta} AS ta, {tb} AS tb FROM all_city c)"


WIN = "(CASE WHEN a = b THEN 'Tie' WHEN a > b THEN na ELSE nb END)"
GAPC = r2("abs(a-b)")


def prow(p) -> str:
    return f"SELECT city, {r2('a')} AS a, {r2('b')} AS b, {r2('a-b')} AS delta, {WIN} AS winner FROM {pair(p)}"


def pfact(p, extra="") -> str:
    return f"SELECT any_value(ta) AS hi, any_value(tb) AS lo, count(*) AS c{extra} FROM {pair(p)}"


@op
def h2h_gap(p):
    return One(prow(p), pfact(p), div("hi-lo", "hi"), ar(0.3, 0.6), r2("hi-lo"), r(f"CASE WHEN hi <> lo THEN {r2('hi-lo')} / 4 END"))


@op
def h2h_ratio(p):
    return One(prow(p), pfact(p), div("hi", "lo"), ar(2, 4), r2(div("hi", "lo")))


@op
def dominance_pattern(p):
    return One(prow(p), pfact(p, ", count(*) FILTER (a > b) AS wa, count(*) FILTER (b > a) AS wb"), div("greatest(wa, wb)", "c"), ar(0.75, 1.0), "wa")


@op
def gap_magnitude(p):
    return One(f"SELECT city, {GAPC} AS gap, {r(div('abs(a-b)', 'greatest(a, b)'))} AS gap_pct, {WIN} AS leader FROM {pair(p)}", pfact(p), div("hi-lo", "hi"), ar(0.3, 0.6), r(div("hi-lo", "hi")))


@op
def largest_gap_city(p):
    return One(f"SELECT city, {r2('a')} AS a, {r2('b')} AS b, {GAPC} AS gap, {amber_if(f'{GAPC} = max({GAPC}) OVER ()')} AS status FROM {pair(p)}",
               f"SELECT max({GAPC}) AS g, sum({GAPC}) AS t FROM {pair(p)}", div("g", "t"), ar(0.5, 0.75), "g")


@op
def underdog_wins(p):
    k = "count(*) FILTER (winner = nb) OVER ()"
    t = f"SELECT city, a, b, delta, winner FROM (SELECT *, {k} AS k FROM (SELECT city, {r2('a')} AS a, {r2('b')} AS b, {r2('a-b')} AS delta, {WIN} AS winner, nb FROM {pair(p)})) WHERE winner = nb OR k = 0"
    return One(t, pfact(p, f", count(*) FILTER ({WIN} = nb) AS k"), f"1-{div('k', 'c')}", ar(0.75, 1.0), "k")


@op
def revenue_weighted_gap(p):
    w = f"coalesce(abs(a-b) * {div('city_total', T)}, 0)"
    return One(f"SELECT city, {GAPC} AS gap, {r(div('city_total', T))} AS weight, {r2(w)} AS weighted FROM {pair(p)}", pfact(p, f", sum({w}) AS w"), div("w", T), ar(0.02, 0.05), r2("w"))


@op
def growth_direction(p):
    f = f"SELECT any_value(na) AS a, any_value(nb) AS b, (SELECT b FROM any_grp WHERE member = any_value(na)) AS x, (SELECT b FROM any_grp WHERE member = any_value(nb)) AS y, {T} / {N} AS m FROM {pair(p)}"
    f = f"SELECT t.a, t.b, ga.b AS x, gb.b AS y, {T} / {N} AS m FROM (SELECT any_value(na) AS a, any_value(nb) AS b FROM {pair(p)}) t JOIN any_grp ga ON ga.member = t.a JOIN any_grp gb ON gb.member = t.b"
    return One(f"SELECT a, b, {r2('x')} AS slope_a, {r2('y')} AS slope_b FROM ({f})", f, div(pos("-least(x, y)"), "abs(m)"), ar(0.005, 0.01), r2("x-y"))


@op
def scale_difference(p):
    f = f"SELECT any_value(na) AS na, any_value(nb) AS nb, any_value(ta) AS ta, any_value(tb) AS tb FROM {pair(p)}"
    row = lambda n, t: f"SELECT {n} AS entity, {r2(t)} AS total, {r(div(t, 'ta+tb'))} AS of_pair, {r(div(t, T))} AS of_company FROM ({f})"
    return One(row("na", "ta") + " UNION ALL " + row("nb", "tb"), f, div("ta", "ta+tb"), ar(0.65, 0.8), r(div("ta-tb", T)))


@op
def h2h_recovery(p):
    sh = f"(CASE WHEN b <> 0 AND a > b THEN {r2('a-b')} ELSE 0 END)"
    return One(f"SELECT city, {r2('a')} AS leader_revenue, {r2('b')} AS trailer_revenue, {r2(sh)} AS recoverable, CASE WHEN b = 0 THEN 'Not stocked' WHEN {sh} = 0 THEN 'Already ahead' ELSE 'Addressable' END AS state FROM {pair(p)}",
               pfact(p, f", {r2(f'sum({sh})')} AS rv"), div("rv", T), ar(0.03, 0.06), r2("hi-lo"), f"CASE WHEN rv > 0 THEN {r('rv / 12 * 3')} END")


@op
def combined_total(p):
    f = f"SELECT any_value(na) AS na, any_value(nb) AS nb, any_value(ta) AS ta, any_value(tb) AS tb FROM {pair(p)}"
    row = lambda n, t: f"SELECT {n} AS entity, {r2(t)} AS total, {r(div(t, T))} AS share_pct FROM ({f})"
    return One(" UNION ALL ".join([row("na", "ta"), row("nb", "tb"), row("'Combined'", "ta+tb")]), f, "0", NOB, r2("ta+tb"))


def rcells(p) -> str:
    """city, label, ord, value, rank among all entities of the city; entities with zero total dropped after ranking."""
    if p.get("mode") == MONTH:
        return ("(SELECT s.member AS city, mon.lbl AS label, s.idx::DOUBLE AS ord, s.v AS value, s.rk AS rank FROM (SELECT *, rank() OVER (PARTITION BY member ORDER BY v DESC)::BIGINT AS rk FROM ser_city) s "
                "JOIN mon ON mon.idx = s.idx JOIN ser_company k ON k.idx = s.idx WHERE round(k.v, 2) <> 0)")
    return ("(SELECT city, label, ord, value, rank FROM (SELECT c.member AS city, g.member AS label, -g.total AS ord, g.total AS gt, coalesce(x.v, 0)::DOUBLE AS value, "
            "rank() OVER (PARTITION BY c.member ORDER BY coalesce(x.v, 0) DESC)::BIGINT AS rank FROM all_city c CROSS JOIN all_grp g "
            "LEFT JOIN (SELECT city, grp, sum(v) AS v FROM cells GROUP BY 1, 2) x ON x.city = c.member AND x.grp = g.member) WHERE round(gt, 2) <> 0)")


def rents(p) -> str:
    tot = ("(SELECT mon.lbl AS label, s.v AS total FROM ser_company s JOIN mon ON mon.idx = s.idx)" if p.get("mode") == MONTH
           else "(SELECT member AS label, total FROM all_grp)")
    return (f"(SELECT label, any_value(t.total) AS total, any_value(ord) AS ord, avg(rank) AS ar, min(rank) AS best, max(rank) AS worst, count(*) AS cities, count(*) FILTER (rank = 1) AS firsts, "
            f"count(*) FILTER (rank <= 2) AS top_two, CASE WHEN count(*) >= 2 THEN max(rank) - min(rank) END AS spread FROM {rcells(p)} rc JOIN {tot} t USING (label) GROUP BY label)")


NC = "(SELECT count(*) FROM all_city)"


def nents(p) -> str:
    return f"(SELECT count(*) FROM {rents(p)})"


@op
def ranking_consistency(p):
    st, wk, bands = (4, 10, ar(7, 10)) if p["mode"] == MONTH else (2, 5, ar(3.5, 5))
    return Rows(f"SELECT label AS member, {r2('total')} AS revenue, {r2('ar')} AS avg_rank, CASE WHEN ar <= {st} THEN 'STRONG' WHEN ar >= {wk} THEN 'WEAK' ELSE 'MIXED' END AS strength, ar AS m FROM {rents(p)}",
                "m", bands, f"count(*) FILTER (m <= {st})", drop=("m",))


@op
def rank_dispersion(p):
    return Rows(f"SELECT label AS member, {r2('total')} AS revenue, best, worst, spread FROM {rents(p)}", "spread", ar(2, 4), "max(spread)")


@op
def most_frequently_top(p):
    return One(f"SELECT label AS member, {r2('total')} AS revenue, firsts, top_two FROM {rents(p)}", f"SELECT max(firsts) AS k FROM {rents(p)}", div("k", NC), ar(0.75, 0.9), "k")


@op
def weakest_overall(p):
    return One(f"SELECT label AS member, {r2('total')} AS revenue, {r2('ar')} AS avg_rank, cities FROM {rents(p)}", f"SELECT max(ar) AS w, count(*) AS n FROM {rents(p)}", div("w", "n"), ar(0.83, 0.95), r2("w"))


@op
def ranking_agreement(p):
    w = f"greatest(1, {nents(p)} - 1)"
    return One(f"SELECT label AS member, {r2('ar')} AS avg_rank, spread, CASE WHEN spread <= 1 THEN 'Yes' ELSE 'No' END AS agreed, {r(f'1 - avg(spread) OVER () / {w}')} AS agreement FROM {rents(p)}",
               f"SELECT count(*) FILTER (spread <= 1) AS k, count(*) AS n FROM {rents(p)}", "n-k", a_only("greatest(1, n - 1)"), "k")


@op
def never_top_n(p):
    n = p["n"]
    return One(f"SELECT label AS member, {r2('total')} AS revenue, best AS best_rank, CASE WHEN best > {n} THEN 'Never top {n}' ELSE 'Yes' END AS flag FROM {rents(p)}",
               f"SELECT count(*) FILTER (best > {n}) AS k, count(*) AS n FROM {rents(p)}", div("k", "n"), ar(0.34, 0.5), "k")


def leaders(p) -> str:
    return f"(SELECT city, label AS leader FROM {rcells(p)} WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY city ORDER BY ord, label) = 1)"


@op
def dominant_concentration(p):
    f = f"SELECT leader AS member, count(*) AS cities FROM {leaders(p)} GROUP BY 1"
    m = div("k", NC)
    return One(f"SELECT member, cities, {amber_if(f'cities > {NC} / 2.0')} AS status FROM ({f})", f"SELECT max(cities) AS k FROM ({f})", m, ar(0.75, 0.9), r(m))


@op
def preference_diversity(p):
    h = "(CASE WHEN round(t, 2) <> 0 THEN sq / (t * t) END)"
    f = (f"SELECT c.member AS city, c.total, l.leader, x.active, {h} AS h FROM all_city c LEFT JOIN (SELECT city, count(*) FILTER (value <> 0) AS active, sum(value) AS t, sum(value*value) AS sq "
         f"FROM {rcells(p)} GROUP BY 1) x ON x.city = c.member LEFT JOIN {leaders(p)} l ON l.city = c.member")
    rr = Rows(f"SELECT *, h * {nents(p)} AS m FROM ({f})", "m", ar(1.95, 3.25, 10.4), "0")
    return One(f"SELECT city, {r2('total')} AS revenue, coalesce(leader, '-') AS leader, active, {r('h')} AS hhi, {r2('1 / nullif(h, 0)')} AS effective, status FROM ({rr.judged()})",
               f"SELECT max(k) AS k, count(*) AS n FROM (SELECT leader, count(*) AS k FROM {leaders(p)} GROUP BY 1)", div("k", NC), ar(0.75, 0.9), "n")


@op
def bottom_ranked_risk(p):
    n = nents(p)
    t = f"SELECT label AS member, {r2('total')} AS revenue, {r2('ar')} AS avg_rank, {r(div('total', T))} AS share_pct FROM (SELECT *, row_number() OVER (ORDER BY ar DESC, ord, label) AS k FROM {rents(p)}) WHERE k <= greatest(1, floor({n} / 3.0 + 0.5))"
    f = f"SELECT max(h) AS h, max(lp) AS lp FROM (SELECT label, count(*) FILTER (rank > ceil({n} * 2 / 3.0)) AS h, count(*) FILTER (rank = lr) AS lp FROM (SELECT *, max(rank) OVER (PARTITION BY city) AS lr FROM {rcells(p)}) GROUP BY 1)"
    return One(t, f, "h", ar(2, 3), "lp")


@op
def rank_revenue_divergence(p):
    f = f"SELECT *, rank() OVER (ORDER BY total DESC)::BIGINT AS rr FROM {rents(p)}"
    return One(f"SELECT label AS member, {r2('total')} AS revenue, rr AS revenue_rank, {r2('ar')} AS avg_rank, {r2('rr-ar')} AS divergence, CASE WHEN rr - ar > 1 THEN 'Wins small markets' WHEN rr - ar < -1 THEN 'Losing where it matters' ELSE 'Consistent' END AS reading FROM ({f})",
               f"SELECT min({r2('rr-ar')}) AS d FROM ({f})", pos("-d"), ar(1.5, 3), "d")


def edge(p, which) -> str:
    return f"(SELECT * FROM {rcells(p)} WHERE ord = (SELECT {which}(ord) FROM {rents(p)}))"


@op
def latest_average_rank(p):
    return One(f"SELECT city, rank, {r2('value')} AS revenue FROM {edge(p, 'max')}", f"SELECT avg(rank) AS m, {nents(p)} AS n FROM {edge(p, 'max')}", div("m", "n"), ar(0.69, 0.85), r("m"))


@op
def strongest_overall(p):
    return One(f"SELECT label AS member, {r2('total')} AS revenue, {r2('ar')} AS avg_rank FROM {rents(p)}", f"SELECT min(ar) AS m FROM {rents(p)}", "0", NOB, r("m"))


def moves(p) -> str:
    return f"(SELECT a.city, a.rank AS first_rank, b.rank AS last_rank, a.rank - b.rank AS improvement FROM {edge(p, 'min')} a JOIN {edge(p, 'max')} b USING (city))"


@op
def first_vs_last_rank(p):
    return One(f"SELECT *, CASE WHEN improvement >= 0 THEN 'GREEN' ELSE 'AMBER' END AS status FROM {moves(p)}", f"SELECT avg(improvement) AS i, {nents(p)} AS n FROM {moves(p)}",
               div(pos("-i"), "n"), ar(0.154, 0.31), r("i"))


@op
def rank_volatility_by_city(p):
    f = f"SELECT city, count(*) AS periods, stddev_samp(rank) AS v FROM {rcells(p)} GROUP BY 1 HAVING count(*) >= 2"
    return One(f"SELECT city, periods, {r2('v')} AS volatility FROM ({f})", f"SELECT max(v) AS v, {nents(p)} AS n FROM ({f})", div("v", "n"), ar(0.31, 0.385), r("v"))


@op
def consistently_top_n(p):
    n = p["n"]
    return One(f"SELECT label AS member, {r2('total')} AS revenue, {r2('ar')} AS avg_rank, CASE WHEN ar <= {n} THEN 'Top {n} everywhere' ELSE 'Mixed' END AS verdict FROM {rents(p)}",
               f"SELECT count(*) FILTER (ar <= {n}) AS k FROM {rents(p)}", "0", NOB, "k")


@op
def recent_vs_historical_rank(p):
    w = p["window"]
    f = f"""SELECT e, rc, rc - e AS d, {nents(p)} AS n FROM (SELECT avg(rank) FILTER (k1 <= {w}) AS e, avg(rank) FILTER (k2 <= {w}) AS rc FROM (
      SELECT rank, dense_rank() OVER (ORDER BY ord) AS k1, dense_rank() OVER (ORDER BY ord DESC) AS k2 FROM {rcells(p)}))"""
    return One(f"SELECT {r2('e')} AS early_rank, {r2('rc')} AS recent_rank, {r('d')} AS drift FROM ({f})", f, f"CASE WHEN n >= {2 * w} THEN {div('greatest(d, 0)', 'n')} END", ar(0.154, 0.31), r("rc"))


@op
def most_improved(p):
    return One(f"SELECT * FROM {moves(p)}", f"SELECT max(improvement) AS i FROM {moves(p)}", "0", NOB, "i")


# --- volatility ------------------------------------------------------------------------


def vp(p) -> str:
    src = prof(p) if "axis" in p else "any_company"
    return (f"(SELECT *, {r2('pk-tr')} AS gap, tr <= 0 AND pk > 0 AS collapsed, CASE WHEN tr <= 0 AND pk > 0 THEN NULL WHEN tr > 0 THEN pk / tr ELSE 1.0 END AS pr, "
            f"coalesce({div('sd', 'abs(mean)')}, 0) AS cv FROM {src})")


REG = f"member, {r2('pk')} AS peak, {r2('tr')} AS trough, {r2('pr')} AS pt_ratio, gap, collapsed"
MOSTV = "CASE WHEN count(*) FILTER (collapsed) = 0 THEN max(pr) END"


@op
def peak_trough_register(p):
    return Rows(f"SELECT {REG}, pr FROM {vp(p)}", "pr", ar(2, 3), r2(MOSTV), drop=("pr",))


@op
def highest_volatility(p):
    return One(f"SELECT {REG} FROM {vp(p)} ORDER BY collapsed DESC, pr DESC, total DESC, member LIMIT 1", f"SELECT {MOSTV} AS m FROM {vp(p)}", "m", ar(2, 2.5), r2("m"))


@op
def most_stable(p):
    return One(f"SELECT {REG} FROM {vp(p)} ORDER BY collapsed, pr, total DESC, member LIMIT 1", f"SELECT min(pr) AS m FROM {vp(p)}", "0", NOB, r2("m"), priority=5)


@op
def average_volatility(p):
    f = f"SELECT coalesce(avg(pr), 1) AS m, count(*) FILTER (collapsed) AS k, count(*) AS n FROM {vp(p)}"
    return One(f"SELECT {r('m')} AS average_ratio, k AS collapsed_members, n AS members FROM ({f})", f, "m", ar(1.75, 2), r2("m"))


@op
def extreme_count(p):
    x = "(coalesce(pr >= 2, false) OR collapsed)"
    return One(f"SELECT member, {r2('pr')} AS pt_ratio, CASE WHEN {x} THEN 'Extreme' ELSE 'Stable' END AS state, {amber_if(x)} AS status FROM {vp(p)}",
               f"SELECT count(*) FILTER ({x}) AS k FROM {vp(p)}", "k", ar(1, 2), "k")


@op
def revenue_at_risk(p):
    return One(f"SELECT member, {r2('pk')} AS peak, {r2('tr')} AS trough, gap FROM {vp(p)}", f"SELECT {r2('sum(gap)')} AS g FROM {vp(p)}", "g", ar(25000, 50000), "g", r(f"g / {N}"))


@op
def peak_month_share(p):
    x = "(CASE WHEN total > 0 THEN pk / total ELSE 0 END)"
    return Rows(f"SELECT member, {r2('total')} AS revenue, {r2('pk')} AS peak, {r(x)} AS peak_pct, {x} AS m FROM {vp(p)}", "m", ar(0.12, 0.15), r("max(m)"), drop=("m",))


@op
def trough_vs_average(p):
    x = "(CASE WHEN mean > 0 THEN (mean - tr) / mean ELSE 0 END)"
    return Rows(f"SELECT member, {r('mean')} AS mean, {r2('tr')} AS trough, {r(x)} AS drop_pct, {x} AS m FROM {vp(p)}", "m", ar(0.4, 0.6), r("max(m)"), drop=("m",))


@op
def current_vs_trough(p):
    x = "(CASE WHEN tr > 0 THEN (l - tr) / tr ELSE 0 END)"
    return Rows(f"SELECT member, {r2('l')} AS current, {r2('tr')} AS trough, {r(x)} AS buffer_pct, {x} AS m FROM {vp(p)}", "m", ar(0.30, 0.15), r("min(m)"), lower=True, drop=("m",))


@op
def volatility_weighted_exposure(p):
    w = "(total * CASE WHEN pr IS NULL THEN 1 ELSE (pr - 1) / greatest(pr, 1) END)"
    return One(f"SELECT member, {r2('total')} AS revenue, {r2('pr')} AS pt_ratio, {r2(w)} AS exposure FROM {vp(p)}", f"SELECT sum({w}) AS w FROM {vp(p)}", "w", ar(250000, 500000), r2("w"), r2(f"w / {N}"))


@op
def monthly_overview(p):
    return One(f"SELECT {r2('pk')} AS peak, {lbl('pki')} AS peak_month, {r2('tr')} AS trough, {lbl('tri')} AS trough_month, gap AS swing, {r2('pr')} AS pt_ratio FROM {vp(p)}", f"SELECT * FROM {vp(p)}", "0", NOB, r2("coalesce(pr, 1)"))


@op
def monthly_range(p):
    return One(f"SELECT lbl AS month, {r2('v')} AS revenue, {r2('pk-v')} AS vs_peak FROM ser_company JOIN mon USING (idx)", f"SELECT * FROM {vp(p)}", "gap", ar(50000, 100000), "gap", r(f"gap / {N}"))


@op
def company_cv(p):
    return One(f"SELECT {r('mean')} AS mean, {r2('sd')} AS std_dev, {r('cv')} AS cv FROM {vp(p)}", f"SELECT * FROM {vp(p)}", "cv", ar(0.15, 0.2), r("cv"))


@op
def best_vs_worst_multiple(p):
    return One(f"SELECT {r2('pk')} AS best, {r2('tr')} AS worst, {r('pr')} AS multiple FROM {vp(p)}", f"SELECT * FROM {vp(p)}", "pr", ar(1.5, 2), r2("coalesce(pr, 1)"))


@op
def months_below_average(p):
    g = r(f"v - {T} / {N}")
    return One(f"SELECT lbl AS month, {r2('v')} AS revenue, {g} AS vs_average, CASE WHEN {g} < 0 THEN 'Below Average' ELSE 'Above Average' END AS state, {amber_if(g + ' < 0')} AS status FROM ser_company JOIN mon USING (idx)",
               f"SELECT count(*) FILTER ({g} < 0) AS k, ceil(round(any_value(n) * 0.55, 9)) AS t1, ceil(round(any_value(n) * 0.7, 9)) AS t2 FROM ser_company CROSS JOIN ax", "k", ar("t1", "t2"), "k")


@op
def trend_strength(p):
    return One(f"SELECT {r2('b')} AS slope, {r2(f'b*{N}')} AS projected FROM any_company", "SELECT b FROM any_company", "b", ar(-500, -2000), r2("b"), r2("CASE WHEN b < 0 THEN -b END"), lower=True)


@op
def predictability(p):
    return One(f"SELECT {r('cv')} AS cv, {r('greatest(0, 1-cv)')} AS predictability FROM {vp(p)}", f"SELECT greatest(0, 1-cv) AS m FROM {vp(p)}", "m", ar(0.85, 0.70), r("m"), lower=True)


@op
def acceleration(p):
    f = f"SELECT {r2('l-p1')} AS x, {r2('p1-p2')} AS y, {r2('(l-p1)-(p1-p2)')} AS a FROM any_company"
    return One(f"SELECT x AS latest_change, y AS prior_change, a AS acceleration FROM ({f})", f, "a", ar(-2000, -10000), "a", lower=True)


@op
def peak_month_concentration(p):
    x = "(CASE WHEN total > 0 THEN pk / total ELSE 0 END)"
    return One(f"SELECT {lbl('pki')} AS peak_month, {r2('pk')} AS peak, {r(x)} AS peak_share FROM {vp(p)}", f"SELECT {x} AS m FROM {vp(p)}", "m", ar(0.12, 0.15), r("m"))


# --- coverage --------------------------------------------------------------------------


def cp(p) -> str:
    k = ax(p)
    o = "grp" if k == "city" else "city"
    return (f"(SELECT q.member, q.total AS revenue, x.* EXCLUDE (mm) FROM {prof(p)} q LEFT JOIN (SELECT {k} AS mm, count(*) AS active, max(total) AS hi, min(total) AS lo, sum(total*total) AS sq, "
            f"first({o} ORDER BY total DESC, {o}) AS leader, (list(total ORDER BY total DESC))[2] AS second FROM combos GROUP BY 1) x ON x.mm = q.member)")


@op
def dependency_risk(p):
    x = div("hi", "revenue")
    return Rows(f"SELECT member, {r2('revenue')} AS revenue, active, leader, {r(x)} AS dependency_pct, {x} AS m FROM {cp(p)}", "m", ar(0.6, 0.75), r("max(m)"), drop=("m",))


@op
def portfolio_strength(p):
    return One(f"SELECT member, {r2('revenue')} AS revenue, active, {r2('revenue*active')} AS strength, {r('revenue/active')} AS avg_per_product FROM {cp(p)}", f"SELECT max(revenue*active) AS m FROM {cp(p)}", "0", NOB, r2("m"))


@op
def revenue_parity(p):
    x = div("total", T)
    return One(f"SELECT member, {r2('total')} AS revenue, {r(x)} AS share_pct, {r(f'{x} - 1.0::DOUBLE / count(*) OVER ()')} AS vs_equal_share FROM {prof(p)}", f"SELECT max({x}) AS m FROM {prof(p)}", "m", a_only(0.30), r("m"))


@op
def range_within(p):
    x = div(r2("hi-lo"), "hi")
    return Rows(f"SELECT member, {r2('hi')} AS highest, {r2('lo')} AS lowest, {r2('hi-lo')} AS gap, {r(x)} AS gap_pct, {x} AS m, active AS act FROM {cp(p)}", "(CASE WHEN act >= 2 THEN m END)", a_only(0.40), r("max(m)"), drop=("m", "act"))


@op
def coverage_gap(p):
    k = ax(p)
    o = "grp" if k == "city" else "city"
    f = f"SELECT a.member, coalesce(x.c, 0)::BIGINT AS active, (SELECT count(*) FROM all_{o})::BIGINT AS possible FROM all_{k} a LEFT JOIN (SELECT {k} AS mm, count(*) AS c FROM combos GROUP BY 1) x ON x.mm = a.member"
    m = f"1 - {div('sum(active)', 'sum(possible)')}"
    return One(f"SELECT member, active, possible, {r(div('active', 'possible'))} AS coverage_pct FROM ({f})", f"SELECT {m} AS m FROM ({f})", "m", ar(0.4, 0.6), r("m"))


@op
def largest_single_combo(p):
    x = div("total", T)
    return One(f"SELECT member AS combo, {r2('total')} AS revenue, {r(x)} AS share_pct FROM {RC} WHERE rank = 1", f"SELECT {x} AS m FROM {RC} WHERE rank = 1", "m", ar(0.2, 0.3), r("m"))


@op
def cross_ranking(p):
    return One(f"SELECT member, {r2('total')} AS revenue, rank() OVER (ORDER BY total DESC)::BIGINT AS rank FROM {prof(p)}", f"SELECT count(*) AS n FROM {prof(p)}", "0", NOB, "n")


@op
def cross_diversification(p):
    x = div("sq", "revenue*revenue")
    q = f"SELECT member, active, {r(x)} AS hhi, {r2(f'1 / nullif({x}, 0)')} AS effective, {x} AS m FROM {cp(p)}"
    if ax(p) == "city":
        return Rows(q, "m", ar(0.5, 0.7), r("max(m)"), drop=("m",))
    return Rows(q, "active", ar(2.5, 1.5), "min(active)", lower=True, drop=("m",))


@op
def dominant_counterpart(p):
    return One(f"SELECT member, leader, {r2('hi')} AS leader_revenue, {r2('hi-second')} AS lead, {r(div('hi', 'revenue'))} AS dominance_ratio FROM {cp(p)}", f"SELECT count(DISTINCT leader) AS k FROM {cp(p)}", "0", NOB, "k")


@op
def bottom_combos(p):
    return One(f"SELECT member AS combo, {r2('total')} AS revenue, {r(div('total', '(SELECT avg(total) FROM combos)'))} AS of_average FROM combos ORDER BY total, grp, city LIMIT {p['n']}",
               "SELECT min(total) AS lo, avg(total) AS a FROM combos", div("lo", "a"), a_only(0.25), r2("lo"), lower=True)


@op
def share_within(p):
    k = ax(p)
    o = "grp" if k == "city" else "city"
    f = f"SELECT c.{k} AS member, c.{o} AS counterpart, c.total, {div('c.total', 'q.total')} AS sh FROM combos c JOIN {prof(p)} q ON q.member = c.{k}"
    return One(f"SELECT member, counterpart, {r2('total')} AS revenue, {r('sh')} AS share_pct FROM ({f})", f"SELECT max(sh) AS m FROM ({f})", "0", NOB, r("m"))


@op
def contribution_skew(p):
    from daybook.operators.cube import CITY, GROUP
    q = {"axis": CITY if ax(p) == "grp" else GROUP}
    x = div("hi", "revenue")
    return One(f"SELECT member, leader, {r(x)} AS highest_pct, CASE WHEN {x} > 0.5 THEN 'Yes' ELSE 'No' END AS concentrated, {amber_if(x + ' > 0.5')} AS status FROM {cp(q)}",
               f"SELECT count(*) FILTER ({x} > 0.5) AS k FROM {cp(q)}", "k", a_only(2), "k")


@op
def classify_by_share(p):
    x = div("total", T)
    return One(f"SELECT member, {r2('total')} AS revenue, {r(x)} AS share_pct, CASE WHEN {x} > 0.2 THEN 'Core' WHEN {x} >= 0.1 THEN 'Support' ELSE 'Marginal' END AS tier FROM {prof(p)}",
               f"SELECT count(*) FILTER ({x} > 0.2) AS k FROM {prof(p)}", "0", NOB, "k")
