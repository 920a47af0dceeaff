"""Queries over the canonical accounting tables: row-level expressions, joins, the fact build."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import classify as cl
from daybook.functions import identity as idn
from daybook.functions.places import canonical_city, parse_cities
from daybook.operators import fact as ft
from daybook.operators.cube import modal_year, resolve_period
from daybook.session import written_down

from .books import CLASS_OF, FLOW_OF, books, books_sql
from .sql_base import r, r2
from .star import MONEY, table

QUERIES: dict = {}
SQL: dict = {}
c = F.col


def q(name: str, sql: str | None = None, books_prelude: bool = True):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = (books_sql() if books_prelude else "") + sql
        return fn
    return add


def dbl(*names):
    return [c(n).cast("double").alias(n) for n in names]


# --- row-level expressions --------------------------------------------------------------

_LC = """CASE parent WHEN 'Bank Accounts' THEN 'BANK' WHEN 'Cash-in-Hand' THEN 'CASH' WHEN 'Sundry Debtors' THEN 'SUNDRY_DEBTOR' WHEN 'Sundry Creditors' THEN 'SUNDRY_CREDITOR'
 WHEN 'Duties & Taxes' THEN 'TAX' WHEN 'Indirect Expenses' THEN 'EXPENSE' WHEN 'Direct Income' THEN 'INCOME' WHEN 'Sales Accounts' THEN 'INCOME' WHEN 'Fixed Assets' THEN 'ASSET'
 WHEN 'Capital Account' THEN 'LIABILITY' WHEN 'Loans (Liability)' THEN 'LIABILITY' ELSE 'GENERAL' END"""


@q("E01_classify_ledger", f"SELECT source_object_id, name, {_LC} AS classification FROM ledgers")
def _(spark, sf):
    return cl.classify_ledger(books(spark, sf).ledgers).select("source_object_id", "name", "classification")


@q("E02_classify_voucher_type", f"SELECT voucher_type AS name, {CLASS_OF} AS voucher_class, count(*) AS vouchers FROM vouchers GROUP BY 1, 2")
def _(spark, sf):
    v = books(spark, sf).vouchers.groupBy(c("voucher_type").alias("name")).agg(F.count(F.lit(1)).alias("vouchers"))
    return cl.classify_voucher_type(v.withColumn("parent", F.lit(None).cast("string"))).select("name", "voucher_class", "vouchers")


@q("E03_resolve_voucher_type", f"SELECT voucher_id, voucher_type, {CLASS_OF} AS voucher_class FROM vouchers")
def _(spark, sf):
    b = books(spark, sf)
    return cl.resolve_voucher_type(b.vouchers, b.types).select("voucher_id", "voucher_type", "voucher_class")


# Another company whose types have the same names and other parents; a type it lacks goes by its name.
_OTHER_PARENTS = [("Cash Payment", "Receipt"), ("Bank Receipt", "Sales"), ("Export Sales", "Credit Note")]


def two_companies(spark, sf):
    b = books(spark, sf)
    vouchers = b.vouchers.unionByName(b.vouchers.withColumn("company_id", F.lit("CO2")))
    other = F.array(*[F.struct(F.lit("CO2").alias("company_id"), F.lit(n).alias("name"), F.lit(p).alias("parent")) for n, p in _OTHER_PARENTS])
    return vouchers, b.types.select(F.lit("CO1").alias("company_id"), "name", "parent").unionByName(spark.range(1).select(F.inline(other)))


@q("E03_resolve_voucher_type_two_companies", f"""SELECT 'CO1' AS company_id, voucher_id, {CLASS_OF} AS voucher_class FROM vouchers UNION ALL SELECT 'CO2', voucher_id, CASE voucher_type
  WHEN 'Cash Payment' THEN 'RECEIPT' WHEN 'Bank Receipt' THEN 'SALES' WHEN 'Export Sales' THEN 'CREDIT_NOTE' ELSE {CLASS_OF} END FROM vouchers""")
def _(spark, sf):
    return cl.resolve_voucher_type(*two_companies(spark, sf)).select("company_id", "voucher_id", "voucher_class")


@q("E05_resolve_flow_two_companies", f"""SELECT 'CO1' AS company_id, voucher_id, {FLOW_OF} AS flow FROM vouchers UNION ALL SELECT 'CO2', voucher_id, CASE voucher_type
  WHEN 'Cash Payment' THEN 'RECEIPT' WHEN 'Bank Receipt' THEN 'SALES' WHEN 'Export Sales' THEN 'SALES_RETURN' ELSE {FLOW_OF} END FROM vouchers""")
def _(spark, sf):
    return cl.resolve_flow(*two_companies(spark, sf)).select("company_id", "voucher_id", "flow")


@q("E04_classify_ledger_role", "SELECT ledger, role, count(*) AS lines, sum(amount)::DOUBLE AS amount FROM roled WHERE role <> 'PARTY' GROUP BY 1, 2 UNION ALL SELECT 'party', 'PARTY', count(*), sum(amount)::DOUBLE FROM roled WHERE role = 'PARTY'")
def _(spark, sf):
    b = books(spark, sf)
    roled = cl.classify_ledger_role(b.ledger_lines.join(b.vouchers.select("voucher_id", "party"), "voucher_id"))
    name = F.when(c("role") == "PARTY", "party").otherwise(c("ledger"))
    return roled.groupBy(name.alias("ledger"), "role").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").cast("double").alias("amount"))


@q("E05_resolve_flow", f"SELECT voucher_id, {FLOW_OF} AS flow FROM vouchers")
def _(spark, sf):
    b = books(spark, sf)
    return cl.resolve_flow(b.vouchers, b.types).select("voucher_id", "flow")


@q("E06_parse_city", "SELECT source_object_id, city, city_confidence, city_reason, array_to_string(address_lines, ', ') AS raw_address FROM ledgers")
def _(spark, sf):
    return parse_cities(books(spark, sf).ledgers).select("source_object_id", "city", "city_confidence", "city_reason", "raw_address")


@q("E07_canonical_city", "SELECT source_object_id, coalesce(CASE city WHEN 'Apur' THEN 'Anand' WHEN 'EUROPE' THEN 'Europe' ELSE city END, state, country, 'Unknown') AS city_canonical FROM ledgers")
def _(spark, sf):
    places = parse_cities(books(spark, sf).ledgers).withColumn("city", F.concat(F.upper("city"), F.lit(" (old)")))
    alias = table(spark, sf, "nation").filter("n_nationkey = 0").select(F.lit("apur").alias("alias"), F.lit("Anand").alias("canonical"))
    return canonical_city(places, alias).select("source_object_id", "city_canonical")


@q("E08_resolve_period", """SELECT voucher_id, strftime(CASE WHEN amount < 100000 THEN make_date((SELECT y FROM (SELECT year(voucher_date) AS y, count(*) AS n FROM vouchers WHERE amount >= 100000 GROUP BY 1 ORDER BY n DESC, y LIMIT 1))::BIGINT,
  month(voucher_date), 1) ELSE date_trunc('month', voucher_date)::DATE END, '%Y-%m') AS period, amount < 100000 AS period_fallback FROM vouchers""")
def _(spark, sf):
    v = books(spark, sf).vouchers.withColumn("month_name", F.date_format("voucher_date", "MMMM")).withColumn("month_num", F.lit(None).cast("int"))
    v = v.withColumn("voucher_date", F.when(c("amount") >= 100000, c("voucher_date")))
    return resolve_period(v).select("voucher_id", F.date_format("month", "yyyy-MM").alias("period"), "period_fallback")


@q("E08_modal_year", "SELECT y::BIGINT AS modal_year FROM (SELECT year(voucher_date) AS y, count(*) AS n FROM vouchers GROUP BY 1 ORDER BY n DESC, y LIMIT 1)")
def _(spark, sf):
    return modal_year(books(spark, sf).vouchers).select(c("modal_year").cast("bigint").alias("modal_year"))


@q("E09_name_key", "SELECT c_custkey, lower(c_name) AS k FROM customer", books_prelude=False)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", idn.name_key(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).alias("k"))


@q("E10_content_hash", """SELECT event_id, sha256(to_json({'event_type': event_type, 'props': props, 'user_id': user_id::VARCHAR})) AS content_hash FROM events""", books_prelude=False)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("run_id", F.lit("r1"))
    return e.select("event_id", idn.content_hash(e, exclude={"event_id", "ts", "value"}).alias("content_hash"))


@q("E11_fiscal_year", "SELECT fy, count(*) AS vouchers FROM (SELECT CASE WHEN month(voucher_date) >= 4 THEN year(voucher_date) || '-' || (year(voucher_date) + 1) ELSE (year(voucher_date) - 1) || '-' || year(voucher_date) END AS fy FROM vouchers) GROUP BY 1")
def _(spark, sf):
    return books(spark, sf).vouchers.groupBy(idn.fiscal_year(c("voucher_date")).alias("fy")).agg(F.count(F.lit(1)).alias("vouchers"))


@q("E12_stable_id", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'guid-' || o_orderkey WHEN 'O' THEN 'MID_' || o_orderkey ELSE 'HASH_' || substr(sha256('SALES_' || o_orderkey), 1, 16) END AS stable_id FROM orders WHERE o_orderkey <> 0
  UNION ALL SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'guid-0' ELSE 'HASH_' || substr(sha256('SALES_0'), 1, 16) END FROM orders WHERE o_orderkey = 0""", books_prelude=False)
def _(spark, sf):
    o = table(spark, sf, "orders")
    st = c("o_orderstatus")
    return o.select("o_orderkey", idn.stable_id(F.when(st == "F", F.concat(F.lit("guid-"), c("o_orderkey"))), F.when(st == "O", c("o_orderkey")),
                                                F.concat(F.lit("SALES_"), c("o_orderkey"))).alias("stable_id"))


# --- joins and the fact build -----------------------------------------------------------


@q("J01_lookup_master", "SELECT v.voucher_id, l.source_object_id AS ledger_id, l.state AS ledger_state FROM vouchers v LEFT JOIN ledgers l ON lower(l.name) = lower(v.party)")
def _(spark, sf):
    b = books(spark, sf)
    return ft.lookup_master(b.vouchers, b.ledgers, "party", "ledger").select("voucher_id", c("ledger_source_object_id").alias("ledger_id"), "ledger_state")


@q("J01_lookup_master_by_id", "SELECT v.voucher_id, l.name AS ledger_name FROM (SELECT 'V' || o_orderkey AS voucher_id, 'L' || o_custkey AS party_id FROM orders) v LEFT JOIN ledgers l ON l.source_object_id = v.party_id")
def _(spark, sf):
    b = books(spark, sf)
    keyed = table(spark, sf, "orders").select(F.lit("CO1").alias("company_id"), F.concat(F.lit("V"), c("o_orderkey")).alias("voucher_id"),
                                              F.concat(F.lit("L"), c("o_custkey")).alias("party_id"), F.lit("none").alias("party"))
    return ft.lookup_master(keyed, b.ledgers, "party", "ledger", ident="party_id").select("voucher_id", "ledger_name")


_ELIGIBLE = "voucher_type IN ('Export Sales','Sales Return Note','Tax Invoice GST','Sales Order')"
_FACT = f"""
, head AS (SELECT *, {CLASS_OF} AS voucher_class FROM vouchers WHERE {_ELIGIBLE} AND NOT is_cancelled AND NOT is_optional),
slines AS (SELECT * FROM stock_lines QUALIFY row_number() OVER (PARTITION BY voucher_id, entry_id ORDER BY line, item NULLS FIRST, quantity, unit NULLS FIRST, rate NULLS FIRST, amount, is_credit, cost_centre NULLS FIRST) = 1),
srepeats AS (SELECT voucher_id, entry_id, count(*) - 1 AS copies FROM stock_lines WHERE voucher_id IN (SELECT voucher_id FROM head) GROUP BY ALL HAVING count(*) > 1),
ltot AS (SELECT voucher_id, sum(abs(amount)) AS t, count(*) AS n FROM slines GROUP BY 1),
vcentre AS (SELECT voucher_id, arg_min(cost_centre, (line, cost_centre)) AS vc FROM ledger_lines WHERE cost_centre IS NOT NULL GROUP BY 1),
frows AS (
  SELECT h.voucher_id, s.entry_id, h.party, h.voucher_class, s.item, s.quantity, s.unit, s.amount, {r2('s.amount::DOUBLE + coalesce(k.tax + k.ch + k.ro - k.di, 0)::DOUBLE * CASE WHEN t.t = 0 THEN 1.0 / t.n ELSE s.amount::DOUBLE / t.t::DOUBLE END')} AS wc,
    s.cost_centre, false AS acct, h.voucher_date FROM head h JOIN slines s USING (voucher_id) JOIN ltot t USING (voucher_id) LEFT JOIN charges k USING (voucher_id)
  UNION ALL SELECT h.voucher_id, h.voucher_id || '#ACCT1', h.party, h.voucher_class, coalesce(k.base_ledger, '(Service / Accounting Invoice)'), 1, 'Service', CASE WHEN k.base <> 0 THEN k.base ELSE abs(h.amount) END,
    CASE WHEN k.base <> 0 THEN k.base + k.tax + k.ch + k.ro - k.di ELSE abs(h.amount) END::DOUBLE, NULL, true, h.voucher_date FROM head h LEFT JOIN charges k USING (voucher_id) WHERE h.voucher_id NOT IN (SELECT voucher_id FROM stock_lines)),
facts AS (SELECT substr(sha256('CO1|' || f.voucher_id || '|' || f.entry_id), 1, 32) AS row_id, f.voucher_id, f.entry_id, f.party AS customer, CASE WHEN acct THEN 'Service' ELSE coalesce(g.name, i.parent) END AS grp,
  coalesce(i.name, f.item) AS item, coalesce(f.cost_centre, vc.vc) AS salesman, coalesce(l.city, l.state) AS city, l.state, k.tier, k.customer_type, f.amount, f.wc, f.quantity, f.unit,
  f.voucher_class = 'CREDIT_NOTE' AS is_return, acct, coalesce(l.city_confidence, 'none') AS city_confidence, f.voucher_date,
  array_to_string(list_filter([CASE WHEN f.party IS NULL THEN 'CUSTOMER_MISSING' END, CASE WHEN l.source_object_id IS NULL THEN 'LEDGER_NOT_FOUND' END, CASE WHEN k.tier IS NULL THEN 'TIER_NOT_CONFIGURED' END,
   CASE WHEN k.customer_type IS NULL THEN 'CUSTOMER_TYPE_NOT_CONFIGURED' END, CASE WHEN l.state IS NULL THEN 'STATE_NOT_AVAILABLE' END, CASE WHEN l.source_object_id IS NULL OR l.city_reason = 'ADDRESS_EMPTY' THEN 'ADDRESS_EMPTY' END,
   CASE WHEN l.city_reason = 'CITY_NOT_PARSEABLE' THEN 'CITY_NOT_PARSEABLE' END, CASE WHEN NOT acct AND i.source_object_id IS NULL THEN 'STOCK_ITEM_NOT_FOUND' END,
   CASE WHEN NOT acct AND i.parent IS NOT NULL AND g.source_object_id IS NULL THEN 'STOCK_GROUP_NOT_FOUND' END, CASE WHEN coalesce(f.cost_centre, vc.vc) IS NULL THEN 'SALESMAN_UNAVAILABLE' END], lambda x: x IS NOT NULL), ',') AS quality
  FROM frows f LEFT JOIN ledgers l ON lower(l.name) = lower(f.party) LEFT JOIN (SELECT * FROM classes WHERE source <> 'guess') k ON k.ledger_id = l.source_object_id
  LEFT JOIN items i ON lower(i.name) = lower(f.item) LEFT JOIN groups g ON lower(g.name) = lower(i.parent) LEFT JOIN vcentre vc USING (voucher_id))
"""


def fact_build(spark, sf, tables=None):
    b = books(spark, sf)
    tables = tables or (b.vouchers, b.stock_by_voucher, b.ledger_lines)
    return ft.build_facts(*tables, b.ledgers, b.items, b.groups, b.cost_centres, b.classes, b.types, keep=written_down)


def facts(spark, sf):
    return fact_build(spark, sf).facts


def reingested(spark, sf):
    """Vouchers, stock and ledger lines where every urgent voucher arrives a second time, with other amounts and texts."""
    b = books(spark, sf)
    urgent = b.vouchers.filter("priority = '1-URGENT'").select("company_id", "voucher_id")
    again = lambda df, **changed: df.withColumn("arrival", F.lit(1)).unionByName(
        df.join(urgent, ["company_id", "voucher_id"], "left_semi").withColumns(changed).withColumn("arrival", F.lit(2)))
    return (again(b.vouchers, amount=(c("amount") + 100).cast(MONEY), voucher_number=F.lit("again")),
            again(b.stock_by_voucher, amount=(c("amount") * 2).cast(MONEY), item=F.lit("another item")),
            again(b.ledger_lines, amount=(c("amount") * 3).cast(MONEY), cost_centre=F.lit("A centre")))


@q("J02_build_fact_sales", _FACT + """SELECT row_id, voucher_id, entry_id, customer, grp, item, salesman, city, state, tier, customer_type, amount::DOUBLE AS amount, wc AS amount_with_charges, quantity::DOUBLE AS quantity, unit, is_return,
  acct AS is_accounting_invoice, city_confidence, quality FROM facts""")
def _(spark, sf):
    return facts(spark, sf).select("row_id", "voucher_id", "entry_id", "customer", "grp", "item", "salesman", "city", "state", "tier", "customer_type",
                                   *dbl("amount", "amount_with_charges", "quantity"), "unit", "is_return", "is_accounting_invoice", "city_confidence",
                                   F.array_join("data_quality", ",").alias("quality"))


@q("J03_allocate_charges", f"""SELECT voucher_id, entry_id, s.amount::DOUBLE AS amount, {r('CASE WHEN t.t = 0 THEN 1.0 / t.n ELSE s.amount::DOUBLE / t.t::DOUBLE END')} AS line_share,
  {r2('s.amount::DOUBLE + coalesce(k.tax + k.ch + k.ro - k.di, 0)::DOUBLE * CASE WHEN t.t = 0 THEN 1.0 / t.n ELSE s.amount::DOUBLE / t.t::DOUBLE END')} AS amount_with_charges
  FROM stock_lines s JOIN (SELECT voucher_id, sum(abs(amount)) AS t, count(*) AS n FROM stock_lines GROUP BY 1) t USING (voucher_id) LEFT JOIN charges k USING (voucher_id)""")
def _(spark, sf):
    b = books(spark, sf)
    charges = ft.voucher_charges(ft.with_roles(b.ledger_lines, b.vouchers))
    return ft.allocate_charges(b.stock_lines, charges).select("voucher_id", "entry_id", *dbl("amount"), F.round("line_share", 6).alias("line_share"),
                                                              *dbl("amount_with_charges"))


@q("J03_voucher_charges", "SELECT voucher_id, tax::DOUBLE AS tax, ch::DOUBLE AS charges, ro::DOUBLE AS round_off, di::DOUBLE AS discount, base::DOUBLE AS base_amount, base_ledger, (tax + ch + ro - di)::DOUBLE AS charge_load FROM charges")
def _(spark, sf):
    b = books(spark, sf)
    return ft.voucher_charges(ft.with_roles(b.ledger_lines, b.vouchers), ft.first_base_ledger()).select(
        "voucher_id", *dbl("tax", "charges", "round_off", "discount", "base_amount"), "base_ledger", *dbl("charge_load"))


@q("J04_accounting_invoice_base", """SELECT v.voucher_id, (CASE WHEN coalesce(k.base, 0) <> 0 THEN k.base ELSE abs(v.amount) END)::DOUBLE AS base_value,
  (CASE WHEN coalesce(k.base, 0) <> 0 THEN k.base + k.tax + k.ch + k.ro - k.di ELSE abs(v.amount) END)::DOUBLE AS base_with_charges, coalesce(k.base_ledger, '(Service / Accounting Invoice)') AS product
  FROM vouchers v LEFT JOIN charges k USING (voucher_id) WHERE v.voucher_id NOT IN (SELECT voucher_id FROM stock_lines)""")
def _(spark, sf):
    b = books(spark, sf)
    service = b.vouchers.join(b.stock_lines.select("company_id", "voucher_id"), ft.KEY, "left_anti")
    charges = ft.voucher_charges(ft.with_roles(b.ledger_lines, b.vouchers), ft.first_base_ledger())
    return ft.accounting_invoice_base(service, charges).select("voucher_id", *dbl("base_value", "base_with_charges"), "product")


@q("J05_resolve_salesman", _FACT + "SELECT salesman, count(*) AS rows, sum(amount)::DOUBLE AS amount FROM facts GROUP BY 1")
def _(spark, sf):
    return facts(spark, sf).groupBy("salesman").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount"))


_RAW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate::VARCHAR AS shipped"
_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "shipped"]


def _dup_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", c("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity",
                                               "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@q("J06_dedupe_rows", f"SELECT {_RAW} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1".replace("l_linenumber, l_partkey", "l_linenumber::BIGINT AS l_linenumber, l_partkey", 1), books_prelude=False)
def _(spark, sf):
    return ft.dedupe_rows(_dup_rows(spark, sf), ["l_orderkey", "l_linenumber"], _ORDER)[0]


@q("J06_rejected_duplicates", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, count(*) AS copies, 'DUPLICATE_ROW_ID' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k > 1 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate""", books_prelude=False)
def _(spark, sf):
    return ft.dedupe_rows(_dup_rows(spark, sf), ["l_orderkey", "l_linenumber"], _ORDER)[1].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copies", "reason")


_ROW_ID = "substr(sha256('CO1|' || voucher_id || '|' || entry_id), 1, 32)"


@q("J07_rejected_rows", _FACT + f"""SELECT voucher_id, NULL AS row_id, 'VOUCHER_CANCELLED_OR_OPTIONAL' AS reason, 1 AS copies FROM vouchers WHERE {_ELIGIBLE} AND (is_cancelled OR is_optional)
  UNION ALL SELECT voucher_id, {_ROW_ID}, 'DUPLICATE_ROW_ID', copies FROM srepeats""")
def _(spark, sf):
    return fact_build(spark, sf).rejected.select("voucher_id", "row_id", "reason", "copies")


_ARRIVALS = """, urgent AS (SELECT 'V' || o_orderkey AS voucher_id FROM orders WHERE o_orderpriority = '1-URGENT'),
given AS (SELECT voucher_id, row_id FROM facts WHERE acct UNION ALL SELECT voucher_id, {ROW_ID} FROM stock_lines WHERE voucher_id IN (SELECT voucher_id FROM head)),
arrivals AS (SELECT voucher_id, row_id, 1 AS arrival FROM given UNION ALL SELECT voucher_id, row_id, 2 FROM given WHERE voucher_id IN (SELECT voucher_id FROM urgent)),
again AS (SELECT voucher_id, row_id FROM arrivals QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY arrival) > 1),
off AS (SELECT voucher_id FROM vouchers WHERE {ELIGIBLE} AND (is_cancelled OR is_optional))
""".replace("{ELIGIBLE}", _ELIGIBLE).replace("{ROW_ID}", _ROW_ID)


_J02_COLUMNS = """SELECT row_id, voucher_id, entry_id, customer, grp, item, salesman, city, state, tier, customer_type, amount::DOUBLE AS amount, wc AS amount_with_charges, quality FROM facts"""


@q("J02_build_fact_sales_reingested", _FACT + _J02_COLUMNS)
def _(spark, sf):
    return fact_build(spark, sf, reingested(spark, sf)).facts.select(
        "row_id", "voucher_id", "entry_id", "customer", "grp", "item", "salesman", "city", "state", "tier", "customer_type", c("amount").cast("double").alias("amount"),
        c("amount_with_charges").cast("double").alias("amount_with_charges"), F.array_join("data_quality", ",").alias("quality"))


@q("J07_rejected_duplicates", _FACT + _ARRIVALS + """SELECT voucher_id, row_id, 'DUPLICATE_ROW_ID' AS reason, count(*) AS copies FROM again GROUP BY 1, 2
  UNION ALL SELECT voucher_id, NULL, 'VOUCHER_CANCELLED_OR_OPTIONAL', 1 FROM off UNION ALL SELECT voucher_id, NULL, 'VOUCHER_CANCELLED_OR_OPTIONAL', 1 FROM off WHERE voucher_id IN (SELECT voucher_id FROM urgent)""")
def _(spark, sf):
    return fact_build(spark, sf, reingested(spark, sf)).rejected.select("voucher_id", "row_id", "reason", "copies")


@q("J08_data_quality_reasons", _FACT + "SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(quality, ',')) AS reason FROM facts WHERE quality <> '') GROUP BY 1")
def _(spark, sf):
    return facts(spark, sf).select(F.explode("data_quality").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@q("J09_classify_customers", "SELECT l.source_object_id, k.tier, k.customer_type, k.source AS classification_source FROM ledgers l LEFT JOIN (SELECT * FROM classes WHERE source <> 'guess') k ON k.ledger_id = l.source_object_id")
def _(spark, sf):
    b = books(spark, sf)
    return ft.classify_customers(b.ledgers, b.classes).select("source_object_id", "tier", "customer_type", "classification_source")


@q("J10_party_profile", "SELECT name, country, state, city, city_confidence FROM ledgers")
def _(spark, sf):
    return ft.party_profile(books(spark, sf).ledgers).select("name", "country", "state", "city", "city_confidence")


for _kind, _parent in (("customers", "Sundry Debtors"), ("suppliers", "Sundry Creditors")):
    QUERIES[f"J11_parties_{_kind}"] = lambda spark, sf, k=_kind: ft.parties(books(spark, sf).ledgers, k).select("source_object_id", "name")
    SQL[f"J11_parties_{_kind}"] = books_sql() + f"SELECT source_object_id, name FROM ledgers WHERE parent = '{_parent}'"


@q("J12_stock_group_tree", """SELECT g.name, CASE WHEN g.parent = 'Primary' THEN g.name ELSE p.name END AS root, CASE WHEN g.parent = 'Primary' THEN g.name ELSE p.name || ' > ' || g.name END AS path,
  (g.parent <> 'Primary')::BIGINT AS depth, coalesce(i.n, 0)::BIGINT AS items FROM groups g LEFT JOIN groups p ON p.name = g.parent LEFT JOIN (SELECT parent, count(*) AS n FROM items GROUP BY 1) i ON i.parent = g.name""")
def _(spark, sf):
    b = books(spark, sf)
    return ft.stock_group_tree(b.groups, b.items).select("name", "root", "path", "depth", "items")


# Chains of 40 groups over the parts; the first two of every third chain are each other's parent.
_DEEP = """WITH RECURSIVE n AS (SELECT p_partkey AS k, (p_partkey - 1) // 40 AS chain, (p_partkey - 1) % 40 AS place FROM part),
g AS (SELECT 'Group ' || k AS name, CASE WHEN place > 0 THEN 'Group ' || (k - 1) WHEN chain % 3 = 2 THEN 'Group ' || (k + 1) ELSE 'Primary' END AS parent FROM n),
w AS (SELECT name, name AS root, name AS path, 0::BIGINT AS depth FROM g WHERE parent NOT IN (SELECT name FROM g)
      UNION ALL SELECT g.name, w.root, w.path || ' > ' || g.name, w.depth + 1 FROM g JOIN w ON g.parent = w.name),
tree AS (SELECT name, root, path, depth, FALSE AS is_cyclic FROM w UNION ALL SELECT name, name, name, 0, TRUE FROM g WHERE name NOT IN (SELECT name FROM w)) """


def deep_groups(spark, sf):
    n = table(spark, sf, "part").select(c("p_partkey").alias("k"), F.floor((c("p_partkey") - 1) / 40).alias("chain"), ((c("p_partkey") - 1) % 40).alias("place"))
    named = lambda k: F.concat(F.lit("Group "), k.cast("string"))
    parent = F.when(c("place") > 0, named(c("k") - 1)).when(c("chain") % 3 == 2, named(c("k") + 1)).otherwise("Primary")
    return n.select(F.lit("CO1").alias("company_id"), named(c("k")).alias("name"), parent.alias("parent"))


@q("J12_stock_group_tree_deep", _DEEP + "SELECT t.*, coalesce(i.n, 0)::BIGINT AS items FROM tree t LEFT JOIN (SELECT 'Group ' || l_partkey AS name, count(*) AS n FROM lineitem GROUP BY 1) i USING (name)", books_prelude=False)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(F.lit("CO1").alias("company_id"), F.concat(F.lit("Group "), c("l_partkey").cast("string")).alias("parent"))
    return ft.stock_group_tree(deep_groups(spark, sf), items).select("name", "root", "path", "depth", "is_cyclic", "items")


@q("J12_stock_group_items", _DEEP + "SELECT l_orderkey || '-' || l_linenumber AS source_object_id, name AS grp, root, path FROM lineitem JOIN tree ON name = 'Group ' || l_partkey", books_prelude=False)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(F.lit("CO1").alias("company_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_object_id"),
                                                F.lit("line").alias("name"), F.concat(F.lit("Group "), c("l_partkey").cast("string")).alias("parent"))
    return ft.stock_group_items(deep_groups(spark, sf), items).select("source_object_id", "grp", "root", "path")


@q("J13_fact_stats", _FACT + f"""SELECT (SELECT count(*) FROM facts) AS rows, (SELECT sum(amount)::DOUBLE FROM facts) AS net, (SELECT {r2('sum(wc::DECIMAL(18,2))')} FROM facts) AS with_charges,
  (SELECT count(*) FROM vouchers WHERE voucher_id IN (SELECT voucher_id FROM facts)) AS vouchers, (SELECT sum(amount)::DOUBLE FROM vouchers WHERE voucher_id IN (SELECT voucher_id FROM facts)) AS gross_vouchers,
  (SELECT count(*) FROM vouchers WHERE {_ELIGIBLE} AND (is_cancelled OR is_optional)) + (SELECT coalesce(sum(copies), 0)::BIGINT FROM srepeats) AS rejected""")
def _(spark, sf):
    b = books(spark, sf)
    build = fact_build(spark, sf)
    return ft.fact_stats(build.facts, b.vouchers, build.rejected)


@q("J13_fact_stats_reingested", _FACT + _ARRIVALS + f"""SELECT (SELECT count(*) FROM facts) AS rows, (SELECT sum(amount)::DOUBLE FROM facts) AS net, (SELECT {r2('sum(wc::DECIMAL(18,2))')} FROM facts) AS with_charges,
  (SELECT count(*) FROM vouchers WHERE voucher_id IN (SELECT voucher_id FROM facts)) AS vouchers, (SELECT sum(amount)::DOUBLE FROM vouchers WHERE voucher_id IN (SELECT voucher_id FROM facts)) AS gross_vouchers,
  (SELECT count(*) FROM off) + (SELECT count(*) FROM off WHERE voucher_id IN (SELECT voucher_id FROM urgent)) + (SELECT count(*) FROM again) AS rejected""")
def _(spark, sf):
    tables = reingested(spark, sf)
    build = fact_build(spark, sf, tables)
    return ft.fact_stats(build.facts, tables[0], build.rejected)


