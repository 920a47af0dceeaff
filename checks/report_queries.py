"""Queries over registers, the executive dashboard and the reconciliations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from daybook.operators import dashboard as db
from daybook.operators import fact as ft
from daybook.operators import reconcile as rc
from daybook.operators import register as rg

from .books import CLASS_OF, FLOW_OF, books, books_sql
from .fact_queries import _FACT, facts
from .sql_base import r2
from .star import MONEY, table

QUERIES: dict = {}
SQL: dict = {}
c = F.col


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = books_sql() + sql
        return fn
    return add


def register(spark, sf, direction="SALES", filters=None):
    """The register of a direction. Nothing is kept: a breakdown reads a few columns, and all of them together outgrow the executors' memory."""
    b = books(spark, sf)
    return rg.build_register(b.vouchers, b.stock_by_voucher, b.ledger_lines, b.types, ft.party_profile(b.ledgers), direction, filters)


def reg_sql(direction: str = "SALES", where: str = "true", line_where: str = "true", semi: bool = False) -> str:
    classes, ret = (("'SALES','CREDIT_NOTE'", "CREDIT_NOTE") if direction == "SALES" else ("'PURCHASE','DEBIT_NOTE'", "DEBIT_NOTE"))
    keep = "AND (s.n IS NOT NULL)" if semi else ""
    return f"""
, sl AS (SELECT * FROM stock_lines WHERE {line_where}),
rv AS (SELECT v.*, CASE WHEN cls = '{ret}' THEN -1 ELSE 1 END AS sign, cls = '{ret}' AS is_return, l.country, l.state, l.city, coalesce(l.city_confidence, 'none') AS conf, coalesce(k.tax, 0) AS tax, coalesce(k.cgst, 0) AS cgst,
  coalesce(k.sgst, 0) AS sgst, coalesce(k.igst, 0) AS igst, coalesce(k.ch, 0) AS ch, coalesce(k.ro, 0) AS ro, coalesce(k.di, 0) AS di, coalesce(s.t, 0) AS t, s.t AS sz, s.n, s.q, k.base_ledger,
  CASE WHEN s.n IS NOT NULL THEN s.t WHEN coalesce(k.base, 0) = 0 THEN v.amount - coalesce(k.tax, 0) - coalesce(k.ch, 0) ELSE k.base END AS nu
  FROM (SELECT *, {CLASS_OF} AS cls FROM vouchers WHERE NOT is_cancelled AND NOT is_optional) v LEFT JOIN ledgers l ON lower(l.name) = lower(v.party) LEFT JOIN charges k USING (voucher_id)
  LEFT JOIN (SELECT voucher_id, sum(amount) AS t, count(*) AS n, sum(quantity) AS q FROM sl GROUP BY 1) s USING (voucher_id) WHERE cls IN ({classes}) AND {where} {keep}),
rl AS (SELECT rv.voucher_id, voucher_number, voucher_date, party, country, state, city, is_return, s.item AS product, (sign * s.quantity)::DOUBLE AS quantity, s.unit, (sign * s.amount)::DOUBLE AS amount,
    {r2('sign * tax::DOUBLE * CASE WHEN sz = 0 THEN 1.0 / n ELSE s.amount::DOUBLE / sz::DOUBLE END')} AS gst, {r2('sign * (ch + ro - di)::DOUBLE * CASE WHEN sz = 0 THEN 1.0 / n ELSE s.amount::DOUBLE / sz::DOUBLE END')} AS charges, false AS acct
    FROM rv JOIN sl s USING (voucher_id)
  UNION ALL SELECT voucher_id, voucher_number, voucher_date, party, country, state, city, is_return, coalesce(base_ledger, '(Service / Accounting Invoice)'), 1, 'Service', (sign * nu)::DOUBLE, {r2('sign * tax')}, {r2('sign * (ch + ro - di)')}, true FROM rv WHERE n IS NULL)
"""


@q("L01_voucher_ledger_breakdown", """SELECT voucher_id, cgst::DOUBLE AS cgst, sgst::DOUBLE AS sgst, igst::DOUBLE AS igst, 0.0::DOUBLE AS utgst, 0.0::DOUBLE AS cess, 0.0::DOUBLE AS other_tax, ro::DOUBLE AS round_off, di::DOUBLE AS discount,
  ch::DOUBLE AS charges, base::DOUBLE AS base, base_ledger, tax::DOUBLE AS total_tax FROM charges""")
def _(spark, sf):
    b = books(spark, sf)
    roled = ft.with_roles(b.ledger_lines, b.vouchers)
    out = rg.voucher_ledger_breakdown(roled, ft.first_base_ledger())
    return out.select("voucher_id", "base_ledger", *[c(x).cast("double").alias(x) for x in out.columns if x not in ("company_id", "voucher_id", "base_ledger")])


_LINES = "SELECT voucher_id, party, product, quantity, unit, amount, gst, charges, round(amount + gst + charges, 2) AS total, is_return, acct AS is_accounting_invoice, state FROM rl"
for _d in ("SALES", "PURCHASE"):
    SQL[f"L02_normalize_voucher_lines_{_d.lower()}"] = books_sql() + reg_sql(_d) + _LINES
    QUERIES[f"L02_normalize_voucher_lines_{_d.lower()}"] = lambda spark, sf, d=_d: register(spark, sf, d).lines.select(
        "voucher_id", "party", "product", *[c(x).cast("double").alias(x) for x in ("quantity", "amount")], "unit", "gst", "charges", "total", "is_return",
        "is_accounting_invoice", "state")

_TOTALS = f"""SELECT coalesce(sum(sign * amount), 0)::DOUBLE AS invoiced, coalesce(sum(amount) FILTER (NOT is_return), 0)::DOUBLE AS gross, coalesce(sum(amount) FILTER (is_return), 0)::DOUBLE AS returns, sum(sign * t)::DOUBLE AS item_value,
  sum(sign * nu)::DOUBLE AS net, sum(sign * cgst)::DOUBLE AS cgst, sum(sign * sgst)::DOUBLE AS sgst, sum(sign * igst)::DOUBLE AS igst, 0.0::DOUBLE AS utgst, 0.0::DOUBLE AS cess, sum(sign * tax)::DOUBLE AS total_tax, sum(sign * di)::DOUBLE AS discount,
  sum(sign * ch)::DOUBLE AS charges, sum(sign * ro)::DOUBLE AS round_off, count(*) FILTER (NOT is_return) AS invoices, count(*) FILTER (is_return) AS return_count, sum(sign * coalesce(q, 0))::DOUBLE AS quantity,
  count(DISTINCT party) AS parties, count(*) FILTER (n IS NULL) AS vouchers_without_items, count(*) AS vouchers, {r2('sum(sign * amount)::DOUBLE / count(*) FILTER (NOT is_return)')} AS average_invoice,
  (SELECT count(DISTINCT product) FROM rl WHERE product <> '(Service / Accounting Invoice)') AS items FROM rv"""
for _d in ("SALES", "PURCHASE"):
    SQL[f"L04_register_totals_{_d.lower()}"] = books_sql() + reg_sql(_d) + _TOTALS
    QUERIES[f"L04_register_totals_{_d.lower()}"] = lambda spark, sf, d=_d: rg.register_totals(register(spark, sf, d))


@q("L03_register_filters_place", reg_sql(where="coalesce(l.state, '(no state)') IN ('ASIA', '(no state)') AND coalesce(l.city, '(no city)') <> 'Apur'") + _TOTALS)
def _(spark, sf):
    b = books(spark, sf)
    cities = [chr(65 + i) + "pur" for i in range(1, 26)] + ["(no city)", "EUROPE"]
    return rg.register_totals(rg.build_register(b.vouchers, b.stock_by_voucher, b.ledger_lines, b.types, ft.party_profile(b.ledgers), "SALES",
                                                rg.Filters(state=["ASIA", "(no state)"], city=cities)))


@q("L03_register_filters_search", reg_sql(line_where="contains(lower(item), 'widget')", semi=True) + _TOTALS)
def _(spark, sf):
    return rg.register_totals(register(spark, sf, filters=rg.Filters(search="Widget ".strip())))


@q("L05_register_by_month", reg_sql() + """SELECT strftime(voucher_date, '%Y-%m') AS month, sum(sign * amount)::DOUBLE AS amount, sum(sign * nu)::DOUBLE AS net, coalesce(sum(amount) FILTER (NOT is_return), 0)::DOUBLE AS gross,
  coalesce(sum(amount) FILTER (is_return), 0)::DOUBLE AS returns_amount, count(*) FILTER (NOT is_return) AS invoices, count(*) FILTER (is_return) AS returns, sum(sign * tax)::DOUBLE AS tax, sum(sign * coalesce(q, 0))::DOUBLE AS quantity FROM rv GROUP BY 1""")
def _(spark, sf):
    return rg.register_by_month(register(spark, sf))


@q("L06_register_by_party", reg_sql() + f"""SELECT p.*, coalesce(tp.top_product, '-') AS top_product FROM (SELECT party, max(country) AS country, max(state) AS state, max(city) AS city, sum(sign * amount)::DOUBLE AS amount, sum(sign * nu)::DOUBLE AS net,
  coalesce(sum(amount) FILTER (NOT is_return), 0)::DOUBLE AS gross, count(*) FILTER (NOT is_return) AS invoices, count(*) FILTER (is_return) AS returns, sum(sign * tax)::DOUBLE AS gst, sum(sign * (ch + ro - di))::DOUBLE AS charges,
  sum(sign * coalesce(q, 0))::DOUBLE AS quantity, strftime(min(voucher_date), '%Y-%m-%d') AS first_date, strftime(max(voucher_date), '%Y-%m-%d') AS last_date,
  (CASE WHEN round(sum(sign * amount)::DOUBLE / (SELECT sum(sign * amount)::DOUBLE FROM rv) * 100, 1) = 0 THEN 0.0 ELSE round(sum(sign * amount)::DOUBLE / (SELECT sum(sign * amount)::DOUBLE FROM rv) * 100, 1) END) AS share_pct,
  coalesce(((sum(amount) FILTER (NOT is_return) * 200)::BIGINT + count(*) FILTER (NOT is_return)) // (2 * nullif(count(*) FILTER (NOT is_return), 0)) / 100.0::DOUBLE, 0.0) AS average_invoice FROM rv GROUP BY 1) p
  LEFT JOIN (SELECT party, first(product ORDER BY a DESC, product) AS top_product FROM (SELECT party, product, sum(amount::DECIMAL(18,2)) AS a FROM rl WHERE product <> '(Service / Accounting Invoice)' GROUP BY 1, 2) GROUP BY 1) tp USING (party)""")
def _(spark, sf):
    return rg.register_by_party(register(spark, sf))


@q("L07_register_by_item", reg_sql() + f"""SELECT product, CASE WHEN min(unit) = max(unit) THEN min(unit) END AS unit, sum(amount::DECIMAL(18,2))::DOUBLE AS net, {r2('sum(round(amount + gst + charges, 2))')} AS gross,
  sum(quantity)::DOUBLE AS quantity, count(*) AS lines FROM rl WHERE product <> '(Service / Accounting Invoice)' GROUP BY 1""")
def _(spark, sf):
    return rg.register_by_item(register(spark, sf))


_PLACE = "sum(sign * amount)::DOUBLE AS amount, sum(sign * nu)::DOUBLE AS net, count(*) AS invoices"


@q("L08_register_by_state", reg_sql() + f"SELECT coalesce(state, '(no state)') AS name, {_PLACE} FROM rv GROUP BY 1")
def _(spark, sf):
    return rg.register_by_place(register(spark, sf), "state")


@q("L08_register_by_city", reg_sql("PURCHASE") + f"SELECT coalesce(city, '(no city)') AS name, {_PLACE}, arg_min(conf, list_position(['none','low','medium','high'], conf)) AS confidence FROM rv GROUP BY 1")
def _(spark, sf):
    return rg.register_by_place(register(spark, sf, "PURCHASE"), "city")


def top_other(inner: str, n: int) -> str:
    return (f"SELECT rank, name, amount, members FROM (SELECT least(k, {n + 1})::BIGINT AS rank, CASE WHEN k > {n} THEN 'Other' ELSE name END AS name, {r2('sum(amount)')} AS amount, count(*) AS members FROM (SELECT *, row_number() OVER (ORDER BY amount DESC, name) AS k FROM ({inner})) "
            f"GROUP BY 1, 2)")


@q("L09_rank_with_other", reg_sql() + top_other("SELECT party AS name, sum(sign * amount)::DOUBLE AS amount FROM rv GROUP BY 1", 8))
def _(spark, sf):
    per = rg.register_by_party(register(spark, sf)).select(c("party").alias("name"), "amount")
    return rg.ranked_breakdown(per, "name", "amount", 8).withColumn("amount", F.round("amount", 2))


@q("L10_filter_options", reg_sql() + """SELECT DISTINCT 'party' AS facet, party AS value FROM rv UNION SELECT 'country', coalesce(country, '(no country)') FROM rv UNION SELECT 'state', coalesce(state, '(no state)') FROM rv
  UNION SELECT 'city', coalesce(city, '(no city)') FROM rv UNION SELECT 'product', product FROM rl WHERE NOT acct""")
def _(spark, sf):
    return rg.filter_options(register(spark, sf))


@q("L11_detail_rows", reg_sql("PURCHASE") + "SELECT voucher_number, strftime(voucher_date, '%Y-%m-%d') AS date, party, product, amount FROM rl")
def _(spark, sf):
    return rg.detail_rows(register(spark, sf, "PURCHASE")).select("voucher_number", F.date_format("voucher_date", "yyyy-MM-dd").alias("date"), "party", "product",
                                                                  c("amount").cast("double").alias("amount"))


@q("L12_browse_page", "SELECT voucher_id, party, amount::DOUBLE AS amount FROM vouchers WHERE contains(lower(party), '00001') ORDER BY vouchers.amount DESC, voucher_id LIMIT 20 OFFSET 20")
def _(spark, sf):
    rows, _meta = rg.browse(books(spark, sf).vouchers, "00001", ("party",), sort="amount", descending=True, page=2, page_size=20, tie=("voucher_id",))
    return rows.select("voucher_id", "party", c("amount").cast("double").alias("amount"))


@q("L12_browse_meta", "SELECT count(*) AS total, 2::BIGINT AS page, 20::BIGINT AS page_size, ceil(count(*) / 20.0)::BIGINT AS pages FROM vouchers WHERE contains(lower(party), '00001')")
def _(spark, sf):
    return rg.browse(books(spark, sf).vouchers, "00001", ("party",), page=2, page_size=20)[1]


# --- dashboard --------------------------------------------------------------------------

START, END = date(1998, 1, 1), date(1998, 12, 31)
_FLOWS = f"""
, fl AS (SELECT *, {FLOW_OF} AS flow, voucher_date >= DATE '1998-01-01' AS cur FROM vouchers WHERE NOT is_cancelled AND voucher_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31')
"""


def flows(spark, sf, start=START, end=END):
    b = books(spark, sf)
    w = db.resolve_window(b.vouchers, start, end)
    return db.flows_in(b.vouchers, b.types, w), w, b


def _kpi(name, flow):
    s = lambda t: f"coalesce(sum(amount) FILTER (flow = '{flow}' AND {t}), 0)::DOUBLE"
    n = lambda t: f"count(*) FILTER (flow = '{flow}' AND {t})"
    return f"SELECT '{name}' AS kpi, {s('cur')} AS amount, {n('cur')} AS count, {s('NOT cur')} AS previous_amount, {n('NOT cur')} AS previous_count FROM fl"


_S = lambda f, t: f"coalesce(sum(amount) FILTER (flow = '{f}' AND {t}), 0)::DOUBLE"
_AVG = lambda t: f"coalesce(round(sum(amount) FILTER (flow = 'SALES' AND {t})::DOUBLE / nullif(count(*) FILTER (flow = 'SALES' AND {t}), 0), 2), 0)"
_BILLED = lambda t: f"count(DISTINCT party) FILTER (flow = 'SALES' AND {t})"
_KPIS = " UNION ALL ".join([_kpi(n, f) for n, f in (("sales", "SALES"), ("purchases", "PURCHASE"), ("receipts", "RECEIPT"), ("payments", "PAYMENT"), ("sales_returns", "SALES_RETURN"),
                                                    ("purchase_returns", "PURCHASE_RETURN"))]) + f"""
 UNION ALL SELECT 'net_cash', {r2(_S('RECEIPT', 'cur') + '-' + _S('PAYMENT', 'cur'))}, 0, {r2(_S('RECEIPT', 'NOT cur') + '-' + _S('PAYMENT', 'NOT cur'))}, 0 FROM fl
 UNION ALL SELECT 'avg_invoice', {_AVG('cur')}, count(*) FILTER (flow = 'SALES' AND cur), {_AVG('NOT cur')}, count(*) FILTER (flow = 'SALES' AND NOT cur) FROM fl
 UNION ALL SELECT 'customers_billed', {_BILLED('cur')}::DOUBLE, {_BILLED('cur')}, {_BILLED('NOT cur')}::DOUBLE, {_BILLED('NOT cur')} FROM fl"""


@q("H01_dashboard_kpis", _FLOWS + f"SELECT *, CASE WHEN round((amount - previous_amount) / nullif(abs(previous_amount), 0) * 100, 1) = 0 THEN 0.0 ELSE round((amount - previous_amount) / nullif(abs(previous_amount), 0) * 100, 1) END AS change_pct FROM ({_KPIS})")
def _(spark, sf):
    return db.dashboard_kpis(flows(spark, sf)[0])


@q("H01_window_fallback", "SELECT strftime(min(voucher_date), '%Y-%m-%d') AS start, strftime(max(voucher_date), '%Y-%m-%d') AS \"end\", true AS adjusted, count(*) FILTER (NOT is_cancelled) AS vouchers FROM vouchers")
def _(spark, sf):
    f, w, _b = flows(spark, sf, date(2030, 1, 1), date(2030, 12, 31))
    return f.filter("is_current").agg(F.count(F.lit(1)).alias("vouchers")).select(
        F.lit(str(w.start)).alias("start"), F.lit(str(w.end)).alias("end"), F.lit(w.adjusted).alias("adjusted"), "vouchers")


_MF = lambda f: f"coalesce(sum(amount) FILTER (flow = '{f}'), 0)::DOUBLE"


@q("H02_dashboard_monthly", _FLOWS + f""", mm AS (SELECT strftime(DATE '1998-01-01' + to_months(i::INT), '%Y-%m') AS month FROM range(12) t(i))
  SELECT mm.month, {_MF('SALES')} AS sales, {_MF('PURCHASE')} AS purchases, {_MF('RECEIPT')} AS receipts, {_MF('PAYMENT')} AS payments, count(*) FILTER (flow = 'SALES') AS sales_count
  FROM mm LEFT JOIN fl ON strftime(fl.voucher_date, '%Y-%m') = mm.month AND cur GROUP BY 1""")
def _(spark, sf):
    f, w, _b = flows(spark, sf)
    return db.dashboard_monthly(f, w)


_TOP = {"customers": "SELECT party AS name, sum(amount)::DOUBLE AS amount FROM fl WHERE cur AND flow = 'SALES' GROUP BY 1",
        "states": "SELECT coalesce(l.state, '(no state)') AS name, sum(fl.amount)::DOUBLE AS amount FROM fl LEFT JOIN ledgers l ON lower(l.name) = lower(fl.party) WHERE cur AND flow = 'SALES' GROUP BY 1",
        "items": "SELECT item AS name, sum(s.amount)::DOUBLE AS amount FROM stock_lines s JOIN fl USING (voucher_id) WHERE cur AND flow = 'SALES' GROUP BY 1"}
for _k, _inner in _TOP.items():
    SQL[f"H03_dashboard_top_{_k}"] = books_sql() + _FLOWS + top_other(_inner, 3 if _k == "states" else 7)

    def _top(spark, sf, k=_k):
        f, _w, b = flows(spark, sf)
        return db.dashboard_top(f, ft.party_profile(b.ledgers), b.stock_lines, k, 3 if k == "states" else 7)
    QUERIES[f"H03_dashboard_top_{_k}"] = _top


@q("H04_voucher_mix", _FLOWS + "SELECT flow, count(*) AS count, sum(amount)::DOUBLE AS amount FROM fl WHERE cur GROUP BY 1")
def _(spark, sf):
    return db.voucher_mix(flows(spark, sf)[0])


@q("H04_recent_vouchers", _FLOWS + "SELECT strftime(voucher_date, '%Y-%m-%d') AS date, voucher_number, voucher_type, flow, party, amount::DOUBLE AS amount FROM fl WHERE cur ORDER BY voucher_date DESC, voucher_number DESC LIMIT 20")
def _(spark, sf):
    return db.recent_vouchers(flows(spark, sf)[0], 20)


@q("H05_change_pct", _FLOWS + """SELECT party, CASE WHEN round((a - b) / nullif(abs(b), 0) * 100, 1) = 0 THEN 0.0 ELSE round((a - b) / nullif(abs(b), 0) * 100, 1) END AS change_pct FROM (SELECT party, coalesce(sum(amount) FILTER (cur), 0)::DOUBLE AS a,
  coalesce(sum(amount) FILTER (NOT cur), 0)::DOUBLE AS b FROM fl GROUP BY 1)""")
def _(spark, sf):
    f = flows(spark, sf)[0]
    zero = F.lit(0)
    w = f.groupBy("party").agg(F.coalesce(F.sum(F.when(c("is_current"), c("amount"))), zero).alias("a"), F.coalesce(F.sum(F.when(~c("is_current"), c("amount"))), zero).alias("b"))
    return w.select("party", db.change_pct(c("a"), c("b")).alias("change_pct"))


# --- reconciliations --------------------------------------------------------------------


@q("Q01_sales_control_total", "SELECT 'CO1' AS company_id, sum(abs(closing_balance))::DOUBLE AS expected FROM ledgers WHERE parent IN ('Sales Accounts', 'Direct Income') AND closing_balance IS NOT NULL")
def _(spark, sf):
    return rc.sales_control_total(books(spark, sf).ledgers).select("company_id", c("expected").cast("double").alias("expected"))


@q("Q01_reconcile_fact", _FACT + """SELECT 'CO1' AS company_id, expected, actual, (a - e)::DOUBLE AS difference, CASE WHEN a = e THEN 'RECONCILED' WHEN abs(a - e) <= 0.01 THEN 'WITHIN_TOLERANCE' ELSE 'MATERIAL_DIFFERENCE' END AS status FROM
  (SELECT e::DOUBLE AS expected, a::DOUBLE AS actual, a, e FROM (SELECT sum(amount) AS a FROM facts), (SELECT sum(abs(closing_balance)) AS e FROM ledgers WHERE parent = 'Sales Accounts'))""")
def _(spark, sf):
    return rc.reconcile_fact(facts(spark, sf), books(spark, sf).ledgers)


_FIELDS = ["voucher_date", "customer", "amount", "grp", "item", "salesman", "city", "state", "tier", "customer_type"]


@q("Q02_data_readiness", _FACT + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND {f}::VARCHAR <> '') AS populated, count(*) AS total, round(count(*) FILTER ({f} IS NOT NULL AND {f}::VARCHAR <> '')::DOUBLE / count(*) * 100, 1) AS percent FROM facts" for f in _FIELDS))
def _(spark, sf):
    return rc.data_readiness(facts(spark, sf), _FIELDS)


_CALC = "(CASE WHEN coalesce(s.t, 0) = 0 THEN k.base ELSE s.t END + k.tax + k.ch - k.di + k.ro)"
_Q03 = f"""SELECT v.voucher_id, v.voucher_number, abs(v.amount)::DOUBLE AS header, abs({_CALC})::DOUBLE AS calculated, coalesce(s.t, 0)::DOUBLE AS item_total, k.tax::DOUBLE AS tax_total, (abs(v.amount) - abs({_CALC}))::DOUBLE AS difference,
  CASE WHEN abs(abs(v.amount) - abs({_CALC})) <= 0.05 THEN 'MATCHED' ELSE 'MISMATCH' END AS status FROM vouchers v LEFT JOIN charges k USING (voucher_id) LEFT JOIN (SELECT voucher_id, sum(amount) AS t FROM stock_lines GROUP BY 1) s USING (voucher_id)"""


def _q03(spark, sf):
    b = books(spark, sf)
    return rc.reconcile_vouchers(b.vouchers, b.stock_lines, ft.with_roles(b.ledger_lines, b.vouchers))


@q("Q03_reconcile_vouchers", _Q03)
def _(spark, sf):
    return _q03(spark, sf).drop("company_id")


def _report(direction: str) -> str:
    classes, ret = (("'SALES','CREDIT_NOTE'", "CREDIT_NOTE") if direction == "SALES" else ("'PURCHASE','DEBIT_NOTE'", "DEBIT_NOTE"))
    return f"""SELECT '{direction}' AS direction, sum(sg * amount)::DOUBLE AS invoiced, coalesce(sum(amount) FILTER (sg = 1), 0)::DOUBLE AS gross, coalesce(sum(amount) FILTER (sg = -1), 0)::DOUBLE AS returns, sum(sg * tax)::DOUBLE AS tax,
  count(*) FILTER (sg = 1) AS invoices, count(*) FILTER (sg = -1) AS return_count, sum(sg * coalesce(qty, 0))::DOUBLE AS quantity, sum(sg * amount)::DOUBLE AS ledger_total, 0.0::DOUBLE AS difference, (SELECT count(*) FROM mt) AS vouchers,
  (SELECT count(*) FROM mt WHERE status = 'MATCHED') AS matched FROM (SELECT *, CASE WHEN cls = '{ret}' THEN -1 ELSE 1 END AS sg FROM (SELECT v.*, {CLASS_OF} AS cls, k.tax, s.qty FROM vouchers v LEFT JOIN charges k USING (voucher_id)
  LEFT JOIN (SELECT voucher_id, sum(quantity) AS qty FROM stock_lines GROUP BY 1) s USING (voucher_id) WHERE NOT is_cancelled AND NOT is_optional) WHERE cls IN ({classes}))"""


@q("Q04_reconciliation_report", f", mt AS ({_Q03}) " + _report("SALES") + " UNION ALL " + _report("PURCHASE"))
def _(spark, sf):
    b = books(spark, sf)
    live = rg.resolve_voucher_type(b.vouchers.filter("NOT is_cancelled AND NOT is_optional"), b.types)
    side = F.when(c("voucher_class").isin("SALES", "CREDIT_NOTE"), "SALES").when(c("voucher_class").isin("PURCHASE", "DEBIT_NOTE"), "PURCHASE")
    sign = F.when(c("voucher_class").isin("CREDIT_NOTE", "DEBIT_NOTE"), -1).otherwise(1)
    party = ft.with_roles(b.ledger_lines, live.select("company_id", "voucher_id", "party")).filter("role = 'PARTY'").drop("party")
    totals = party.select(*ft.KEY, c("amount").alias("a")).join(live, ft.KEY).groupBy(side.alias("direction")).agg(F.sum(sign * c("a")).cast("double").alias("ledger_total"))
    return rc.reconciliation_report(register(spark, sf), register(spark, sf, "PURCHASE"), _q03(spark, sf), totals)


_TB = """tb AS (SELECT ledger AS name, sum(amount) FILTER (NOT is_credit) AS debit, sum(amount) FILTER (is_credit) AS credit FROM ledger_lines WHERE ledger <> 'Round Off' GROUP BY 1),
tb2 AS (SELECT name, coalesce(debit, 0) AS debit, coalesce(credit, 0) AS credit, 100 AS opening, true AS od, abs(100 + coalesce(debit, 0) - coalesce(credit, 0)) AS closing, 100 + coalesce(debit, 0) - coalesce(credit, 0) >= 0 AS cd FROM tb)"""


def trial_balance(spark, sf):
    z = F.lit(0).cast(MONEY)
    t = books(spark, sf).ledger_lines.filter("ledger <> 'Round Off'").groupBy(c("ledger").alias("name")).agg(
        F.coalesce(F.sum(F.when(~c("is_credit"), c("amount"))), z).alias("debit"), F.coalesce(F.sum(F.when(c("is_credit"), c("amount"))), z).alias("credit"))
    close = F.lit(100) + c("debit") - c("credit")
    return t.withColumn("opening", F.lit(100).cast(MONEY)).withColumn("opening_is_debit", F.lit(True)).withColumn("closing", F.abs(close)).withColumn("closing_is_debit", close >= 0)


@q("Q05_reconcile_trial_balance", f""", {_TB} SELECT rows, debit, credit, opening_debit, 0.0::DOUBLE AS opening_credit, closing_debit, closing_credit, {r2('abs(debit-credit)')} AS variance, {r2('opening_debit')} AS opening_variance, {r2('abs(closing_debit-closing_credit)')} AS closing_variance,
  CASE WHEN {r2('abs(debit-credit)')} < 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS rows, sum(debit)::DOUBLE AS debit, sum(credit)::DOUBLE AS credit, sum(opening)::DOUBLE AS opening_debit, sum(closing) FILTER (cd)::DOUBLE AS closing_debit, sum(closing) FILTER (NOT cd)::DOUBLE AS closing_credit FROM tb2)""")
def _(spark, sf):
    return rc.reconcile_trial_balance(trial_balance(spark, sf))


AS_OF = date(1998, 7, 1)
_DAYS = "greatest(datediff('day', voucher_date, DATE '1998-07-01'), 0)"
_BUCKET = f"CASE WHEN {_DAYS} > 90 THEN '90_PLUS' WHEN {_DAYS} > 60 THEN '61_90' WHEN {_DAYS} > 30 THEN '31_60' ELSE '0_30' END"


def bills(spark, sf):
    return rc.age_bills(books(spark, sf).vouchers.select("voucher_id", c("voucher_date").alias("bill_date"), c("amount").alias("closing_amount")), AS_OF)


@q("Q06_age_bills", f"SELECT voucher_id, {_DAYS}::BIGINT AS days_old, {_BUCKET} AS bucket FROM vouchers")
def _(spark, sf):
    return bills(spark, sf).select("voucher_id", "days_old", "bucket")


_BS = lambda b: f"coalesce(sum(amount) FILTER (bucket = '{b}'), 0)::DOUBLE AS b_{b.lower()}"


@q("Q07_reconcile_ageing", f"""SELECT *, 0.0::DOUBLE AS bucket_variance, {r2('abs(outstanding - control_total)')} AS variance, CASE WHEN abs(outstanding - control_total) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS bills, sum(amount)::DOUBLE AS outstanding,
  {', '.join(_BS(b) for b in rc.BUCKETS)}, (SELECT sum(amount)::DOUBLE FROM roled WHERE role = 'PARTY') AS control_total FROM (SELECT amount, {_BUCKET} AS bucket FROM vouchers))""")
def _(spark, sf):
    b = books(spark, sf)
    control = ft.with_roles(b.ledger_lines, b.vouchers).filter("role = 'PARTY'").agg(F.sum("amount").alias("x"))
    return rc.reconcile_ageing(bills(spark, sf), control)


@q("Q08_ledger_totals", "SELECT ledger, coalesce(sum(l.amount) FILTER (NOT is_credit), 0)::DOUBLE AS debit, coalesce(sum(l.amount) FILTER (is_credit), 0)::DOUBLE AS credit, (coalesce(sum(l.amount) FILTER (NOT is_credit), 0) - coalesce(sum(l.amount) FILTER (is_credit), 0))::DOUBLE AS net, count(*) AS lines FROM ledger_lines l JOIN vouchers v USING (voucher_id) WHERE NOT is_cancelled GROUP BY 1")
def _(spark, sf):
    b = books(spark, sf)
    return rc.ledger_totals(b.vouchers, b.ledger_lines).drop("company_id")


@q("Q09_reconcile_stock", """SELECT name, o::DOUBLE AS opening_qty, i::DOUBLE AS inward_qty, u::DOUBLE AS outward_qty, (o + i - u)::DOUBLE AS calculated_qty, cl::DOUBLE AS closing_qty, abs(cl - (o + i - u))::DOUBLE AS variance, CASE WHEN abs(cl - (o + i - u)) < 0.001 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT p_name AS name, 10::DECIMAL(18,3) AS o, coalesce(sum(l_quantity::DECIMAL(18,3)) FILTER (l_returnflag = 'R'), 0) AS i, coalesce(sum(l_quantity::DECIMAL(18,3)) FILTER (l_returnflag <> 'R'), 0) AS u,
  10 + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END::DECIMAL(18,3)), 0) + CASE WHEN p_name LIKE 'red%' THEN 0.5 ELSE 0 END AS cl FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)""")
def _(spark, sf):
    qty = c("l_quantity").cast("decimal(18,3)")
    back = c("l_returnflag") == "R"
    z = F.lit(0)
    m = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey")).groupBy(c("p_name").alias("name")).agg(
        F.coalesce(F.sum(F.when(back, qty)), z).alias("inward_qty"), F.coalesce(F.sum(F.when(~back, qty)), z).alias("outward_qty"))
    shift = F.when(c("name").startswith("red"), F.lit("0.5")).otherwise(F.lit("0")).cast("decimal(18,3)")
    m = m.withColumn("opening_qty", F.lit(10).cast("decimal(18,3)")).withColumn("closing_qty", c("opening_qty") + c("inward_qty") - c("outward_qty") + shift)
    return rc.reconcile_stock(m)


@q("Q10_cost_allocation_summary", """SELECT category, count(*) AS allocations, sum(amount)::DOUBLE AS amount, count(*) FILTER (k IS NULL) AS orphans, coalesce(sum(amount) FILTER (k IS NULL), 0)::DOUBLE AS orphan_amount, CASE WHEN count(*) FILTER (k IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT a.*, s.name AS k FROM (SELECT unit AS category, cost_centre, amount FROM stock_lines WHERE cost_centre IS NOT NULL UNION ALL SELECT 'Primary Cost Category', cost_centre, amount FROM ledger_lines WHERE cost_centre IS NOT NULL) a LEFT JOIN cost_centres s ON s.name = a.cost_centre) GROUP BY 1""")
def _(spark, sf):
    b = books(spark, sf)
    a = b.stock_lines.filter("cost_centre IS NOT NULL").select("company_id", c("unit").alias("category"), "cost_centre", "amount").unionByName(
        b.ledger_lines.filter("cost_centre IS NOT NULL").select("company_id", F.lit(None).cast("string").alias("category"), "cost_centre", "amount"))
    return rc.cost_allocation_summary(a, b.cost_centres)


@q("Q11_master_counts", """SELECT *, canonical_count - raw_count AS variance, CASE WHEN canonical_count = raw_count THEN 'PASS' ELSE 'MISMATCH' END AS status FROM (SELECT 'items' AS domain, (SELECT count(*) FROM part) AS raw_count, (SELECT count(*) FROM items) AS canonical_count
  UNION ALL SELECT 'cost_centres', (SELECT count(*) FROM supplier), (SELECT count(*) FROM cost_centres))""")
def _(spark, sf):
    b = books(spark, sf)
    return rc.master_counts({"items": b.t("part"), "cost_centres": b.t("supplier")}, {"items": b.items, "cost_centres": b.cost_centres})


@q("Q11_missing_parents", "SELECT 'CO1' AS company_id, 'items' AS domain, name, parent AS missing_parent FROM items WHERE lower(parent) NOT IN (SELECT lower(name) FROM groups)")
def _(spark, sf):
    b = books(spark, sf)
    elsewhere = b.t("part").select(F.lit("CO2").alias("company_id"), c("p_brand").alias("name")).distinct()
    return rc.missing_parents(b.items, b.groups.select("company_id", "name").unionByName(elsewhere), "items")


@q("Q11_id_collisions", """SELECT co AS company_id, 'lines' AS domain, entry_id AS source_object_id, count(*) AS copies FROM stock_lines, (VALUES ('CO1'), ('CO2')) v(co)
  WHERE co = 'CO1' OR quantity > 10 GROUP BY co, entry_id HAVING count(*) > 1""")
def _(spark, sf):
    lines = books(spark, sf).stock_lines.select("company_id", c("entry_id").alias("source_object_id"), "quantity")
    both = lines.unionByName(lines.filter("quantity > 10").withColumn("company_id", F.lit("CO2")))
    return rc.id_collisions(both, "lines")


@q("Q12_compare_runs", "SELECT (SELECT count(*) FROM events) AS rows, (SELECT count(*) FROM events) AS other_rows, 'PASS' AS status")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return rc.compare_runs(e, e.repartition(7, "user_id").withColumn("run_id", F.lit("second"))).select("rows", "other_rows", "status")


_COV = ["name", "parent", "state", "closing_balance", "email"]


@q("Q13_field_coverage", " UNION ALL ".join(
    (f"SELECT 'ledger.{f}' AS field, count({f}) AS populated, count(*) AS rows, false AS absent, count(*) - count({f}) AS nulls, round(count({f})::DOUBLE / count(*) * 100, 2) AS coverage FROM ledgers" if f != "email" else
     "SELECT 'ledger.email', 0, count(*), true, 0, 0.0 FROM ledgers") for f in _COV))
def _(spark, sf):
    return rc.field_coverage(books(spark, sf).ledgers, "ledger", _COV)


@q("Q14_statutory_profile", """SELECT 'gst' AS capability, g > 0 AS available, CASE WHEN g > 0 THEN 'PARTIAL' ELSE 'NOT_PRESENT' END AS confidence, g AS evidence FROM (SELECT count(*) FILTER (ledger LIKE '%GST%') AS g FROM (SELECT DISTINCT ledger FROM ledger_lines))
  UNION ALL SELECT 'tds', false, 'NOT_PRESENT', 0 UNION ALL SELECT 'multi_currency', true, 'PROVEN', count(*) FROM (SELECT DISTINCT ledger FROM ledger_lines) WHERE ledger LIKE 'Freight%'""")
def _(spark, sf):
    led = books(spark, sf).ledger_lines.select(c("ledger").alias("name")).distinct().withColumn("parent", F.when(c("name").contains("GST"), "Duties & Taxes").otherwise("Suspense")).withColumn(
        "currency", F.when(c("name").startswith("Freight"), "USD").otherwise("INR"))
    return rc.statutory_profile(led)


@q("Q15_tenant_isolation", """SELECT coalesce(state, 'none') AS tenant, count(*) AS rows, count(*) FILTER (country IS NULL) AS violations, min(source_object_id) FILTER (country IS NULL) AS first_violation, CASE WHEN count(*) FILTER (country IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ledgers GROUP BY 1""")
def _(spark, sf):
    led = books(spark, sf).ledgers.withColumn("part", F.coalesce("state", F.lit("none")))
    stamped = rc.tenancy_lineage(led, F.when(c("country").isNull(), F.lit("other")).otherwise(c("part")))
    return rc.tenant_isolation(stamped, "part")


@q("Q15_tenancy_lineage", "SELECT source_object_id, 'T_' || company_id AS tenant_id, 'LE_CO1' AS legal_entity_id, '2024-2025' AS accounting_period FROM ledgers")
def _(spark, sf):
    led = books(spark, sf).ledgers
    return rc.tenancy_lineage(led, F.concat(F.lit("T_"), c("company_id"))).select("source_object_id", "tenancy.tenant_id", "tenancy.legal_entity_id", "tenancy.accounting_period")


