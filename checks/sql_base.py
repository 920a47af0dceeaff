"""Shared pieces of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations


def r(x: str, d: int = 6) -> str:
    """Round a double; a rounded zero is always plain 0.0."""
    return f"(CASE WHEN round(({x})::DOUBLE, {d}) = 0 THEN 0.0::DOUBLE ELSE round(({x})::DOUBLE, {d}) END)"


def r2(x: str) -> str:
    return r(x, 2)


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def pos(x: str) -> str:
    """max(x, 0) keeping NULL."""
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN ({x}) ELSE 0 END)::DOUBLE"


def status(m: str, bands: list, lower: bool = False) -> str:
    op = "<" if lower else ">="
    whens = " ".join(f"WHEN ({m}) {op} {at} THEN '{st}'" for at, st, _ in reversed(bands))
    return f"(CASE WHEN ({m}) IS NULL THEN 'IDLE' {whens} ELSE 'GREEN' END)"


def severity(m: str, bands: list, lower: bool = False) -> str:
    op = "<" if lower else ">="
    whens = " ".join(f"WHEN ({m}) {op} {at} THEN '{sv}'" for at, _, sv in reversed(bands))
    return f"(CASE WHEN ({m}) IS NULL THEN 'LOW' {whens} ELSE 'LOW' END)"


def ar(a, b, c=None) -> list:
    out = [(a, "AMBER", "MEDIUM"), (b, "RED", "HIGH")]
    return out + [(c, "RED", "CRITICAL")] if c is not None else out


def a_only(a) -> list:
    return [(a, "AMBER", "MEDIUM")]


PRIORITY = ("(CASE WHEN status='IDLE' THEN 5 WHEN status='RED' AND severity='CRITICAL' THEN 1 WHEN status='RED' THEN 2 "
            "WHEN status='AMBER' THEN 3 ELSE 4 END)::BIGINT")

FACT = """
fact AS (
  SELECT n.n_name AS city, g.r_name AS state, p.p_brand AS grp, p.p_name AS item, c.c_name AS customer, s.s_name AS salesman,
         CAST(o.o_orderdate AS DATE) AS d, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS m, o.o_orderkey AS voucher_id,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount, l.l_returnflag = 'R' AS is_return,
         {sign} * CAST(l.l_extendedprice AS DECIMAL(18,2)) AS v
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region g ON n.n_regionkey = g.r_regionkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def _axis(name: str, member: str, source: str = "cells") -> str:
    """Member totals, dense series and series statistics of one axis."""
    return f"""
all_{name} AS (SELECT {member} AS member, sum(v)::DOUBLE AS total FROM {source} GROUP BY 1),
raw_{name} AS (SELECT a.member, a.total, mon.idx, coalesce(x.v, 0)::DOUBLE AS v
  FROM all_{name} a CROSS JOIN mon LEFT JOIN (SELECT {member} AS member, m, sum(v) AS v FROM {source} GROUP BY 1, 2) x
  ON x.member = a.member AND x.m = mon.m),
lag_{name} AS (SELECT *, lag(v) OVER w AS prev, max(v) OVER q AS pk, min(v) OVER q AS tr FROM raw_{name}
  WINDOW w AS (PARTITION BY member ORDER BY idx), q AS (PARTITION BY member)),
isl_{name} AS (SELECT *, sum(CASE WHEN v < prev THEN 0 ELSE 1 END) OVER w AS di, sum(CASE WHEN v > prev THEN 0 ELSE 1 END) OVER w AS gi
  FROM lag_{name} WINDOW w AS (PARTITION BY member ORDER BY idx)),
ser_{name} AS (SELECT *, sum(CASE WHEN v < prev THEN 1 ELSE 0 END) OVER (PARTITION BY member, di ORDER BY idx) AS drun,
  sum(CASE WHEN v > prev THEN 1 ELSE 0 END) OVER (PARTITION BY member, gi ORDER BY idx) AS grun FROM isl_{name}),
any_{name} AS (SELECT member, any_value(total) AS total, any_value(total) / any_value(n) AS mean, stddev_samp(v) AS sd,
  round(regr_slope(v, idx), 6) AS b, max(v) FILTER (idx = 0) AS f, max(v) FILTER (idx = n - 1) AS l, max(v) FILTER (idx = n - 2) AS p1,
  max(v) FILTER (idx = n - 3) AS p2, max(v) AS pk, min(v) AS tr, min(idx) FILTER (v = pk) AS pki, min(idx) FILTER (v = tr) AS tri,
  max(drun)::BIGINT AS streak, max(drun) FILTER (idx = n - 1)::BIGINT AS cur, max(grun)::BIGINT AS gstreak,
  max(grun) FILTER (idx = n - 1)::BIGINT AS gcur, sum(v) FILTER (idx >= n - 3) / 3 AS rec, sum(v) FILTER (idx >= n - 6 AND idx < n - 3) / 3 AS pri,
  sum(v * v) AS sq, sum(v) FILTER (idx < ceil(n / 2.0)) AS h1, sum(v) FILTER (idx >= ceil(n / 2.0)) AS h2, list(v ORDER BY idx) AS vs
  FROM ser_{name} CROSS JOIN ax GROUP BY member),
prof_{name} AS (SELECT * FROM any_{name} WHERE round(total, 2) <> 0)"""


def prelude(net: bool = True) -> str:
    sign = "(CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END)" if net else "1"
    return "WITH " + FACT.format(sign=sign) + """,
cells AS (SELECT city, grp, m, sum(v) AS v FROM fact WHERE v <> 0 GROUP BY ALL),
ax AS (SELECT min(m) AS m0, CAST(datediff('month', min(m), max(m)) + 1 AS BIGINT) AS n, sum(v)::DOUBLE AS tot FROM cells),
mon AS (SELECT i AS idx, CAST(m0 + to_months(CAST(i AS INTEGER)) AS DATE) AS m, strftime(m0 + to_months(CAST(i AS INTEGER)), '%b-%y') AS lbl,
  strftime(m0 + to_months(CAST(i AS INTEGER)), '%Y-%m') AS key FROM (SELECT m0, unnest(range(n)) AS i FROM ax)),
combos AS (SELECT city, grp, grp || ' x ' || city AS member, sum(v)::DOUBLE AS total FROM cells GROUP BY 1, 2 HAVING sum(v) <> 0),
""" + ",".join([_axis("city", "city"), _axis("grp", "grp"), _axis("company", "'Company'")]) + "\n"


N = "(SELECT n FROM ax)"
T = "(SELECT tot FROM ax)"


def lbl(i: str) -> str:
    return f"(SELECT lbl FROM mon WHERE mon.idx = {i})"


class Rows:
    """Every row judged; the block is the worst row."""

    def __init__(self, sql, metric, bands, head, coi="NULL", lower=False, drop=(), cols=None):
        self.sql, self.metric, self.bands, self.head, self.coi, self.lower, self.drop = sql, metric, bands, head, coi, lower, drop

    def judged(self) -> str:
        return (f"SELECT *, {status(self.metric, self.bands, self.lower)} AS status, "
                f"{severity(self.metric, self.bands, self.lower)} AS severity FROM ({self.sql})")

    def table(self) -> str:
        ex = f" EXCLUDE ({', '.join(self.drop)})" if self.drop else ""
        return f"SELECT *{ex} FROM ({self.judged()})"

    def block(self) -> str:
        return f"""SELECT CASE WHEN assessed = 0 THEN 'IDLE' ELSE ['IDLE','GREEN','AMBER','RED'][w // 10 + 1] END AS status,
 CASE WHEN assessed = 0 THEN 'LOW' ELSE ['LOW','MEDIUM','HIGH','CRITICAL'][w % 10 + 1] END AS severity, fired, assessed, headline, coi FROM (
 SELECT max(CASE status WHEN 'RED' THEN 30 WHEN 'AMBER' THEN 20 WHEN 'GREEN' THEN 10 ELSE 0 END +
            CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS w,
  count(*) FILTER (status IN ('AMBER','RED')) AS fired, count(*) FILTER (status <> 'IDLE') AS assessed,
  ({self.head})::DOUBLE AS headline, ({self.coi})::DOUBLE AS coi FROM ({self.judged()}))"""


class One:
    """One metric from one row of facts decides the block."""

    def __init__(self, table, facts, metric, bands, head, coi="NULL", lower=False, priority=None):
        self._table, self.facts, self.metric, self.bands = table, facts, metric, bands
        self.head, self.coi, self.lower, self.priority = head, coi, lower, priority

    def table(self) -> str:
        return self._table

    def block(self) -> str:
        st = status(self.metric, self.bands, self.lower)
        return f"""SELECT {st} AS status, {severity(self.metric, self.bands, self.lower)} AS severity,
 ({st} IN ('AMBER','RED'))::BIGINT AS fired, ({st} <> 'IDLE')::BIGINT AS assessed, ({self.head})::DOUBLE AS headline,
 ({self.coi})::DOUBLE AS coi FROM ({self.facts})"""


def verdict_sql(analysis_id: str, o) -> str:
    prio = f"{o.priority}::BIGINT" if getattr(o, "priority", None) else PRIORITY
    return (f"SELECT '{analysis_id}' AS analysis_id, status, severity, {prio} AS priority, fired::BIGINT AS fired, "
            f"assessed::BIGINT AS assessed, headline, coi FROM ({o.block()})")
