"""Queries over sources, normalisation, the mirror and change capture."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from daybook.session import ensure_checkpoint_dir
from daybook.sources import export_xml, normalize, typed_json
from daybook.streaming import cdc
from daybook.streaming import mirror as mr

from .books import FLOW_OF, books, books_sql
from .star import MONEY, table

QUERIES: dict = {}
SQL: dict = {}
c, L = F.col, F.lit


def q(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- raw exports derived from the line items: one voucher per line ------------------------


def raw_vouchers(spark, sf):
    t = lambda n: table(spark, sf, n)
    # Partitioned by the join key up front: the given file is one split, and a large join needs this layout anyway.
    li = t("lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), c("l_orderkey") == c("o_orderkey")).join(
        t("customer").select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"), "left").join(
        t("part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"), "left").join(t("supplier").select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"), "left")
    ext = c("l_extendedprice").cast(MONEY).cast("string")
    none = L(None).cast("string")
    minus = F.concat(L("-"), ext)
    alloc = F.array(F.struct(L("Sales").alias("CATEGORY"), F.array(F.struct(c("s_name").alias("NAME"), ext.alias("AMOUNT"))).alias("COSTCENTREALLOCATIONS.LIST")))
    no_alloc = F.array().cast("array<struct<CATEGORY:string,`COSTCENTREALLOCATIONS.LIST`:array<struct<NAME:string,AMOUNT:string>>>>")
    no_direct = F.array().cast("array<struct<NAME:string,AMOUNT:string>>")
    bill = lambda on: F.when(L(on), F.array(F.struct(F.concat(L("B"), c("l_orderkey")).alias("NAME"), L("New Ref").alias("BILLTYPE"), ext.alias("AMOUNT"))))
    ledger = lambda name, amount, billed: F.struct(name.alias("LEDGERNAME"), amount.alias("AMOUNT"), L("No").alias("ISDEEMEDPOSITIVE"), bill(billed).alias("BILLALLOCATIONS.LIST"),
                                                   no_alloc.alias("CATEGORYALLOCATIONS.LIST"), no_direct.alias("COSTCENTREALLOCATIONS.LIST"))
    stock = F.struct(c("p_name").alias("STOCKITEMNAME"), F.concat(c("l_quantity").cast("int"), L(" Nos")).alias("BILLEDQTY"), none.alias("ACTUALQTY"), L("10/Nos").alias("RATE"),
                     minus.alias("AMOUNT"), alloc.alias("CATEGORYALLOCATIONS.LIST"), no_direct.alias("COSTCENTREALLOCATIONS.LIST"))
    return li.select(
        F.when(c("o_orderstatus") != "P", F.concat(L("g"), c("l_orderkey"), L("-"), c("l_linenumber"))).alias("GUID"), F.when(c("o_orderstatus") == "P", c("l_orderkey").cast("string")).alias("MASTERID"),
        c("l_orderkey").cast("string").alias("ALTERID"), c("l_orderkey").cast("string").alias("VOUCHERNUMBER"), L("Sales").alias("VOUCHERTYPENAME"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("DATE"), c("c_name").alias("PARTYLEDGERNAME"), F.when(c("l_returnflag") == "R", F.concat(ext, L(" Cr"))).otherwise(F.concat(L("Dr = "), ext)).alias("AMOUNT"),
        none.alias("NARRATION"), L("No").alias("ISCANCELLED"), F.when(c("l_linestatus") == "F", "Yes").otherwise("No").alias("ISOPTIONAL"),
        F.array(ledger(c("c_name"), ext, True), ledger(L("Sales"), minus, False)).alias("ALLLEDGERENTRIES.LIST"), F.array(stock).alias("ALLINVENTORYENTRIES.LIST"))


_BASE = """(SELECT CASE WHEN o_orderstatus <> 'P' THEN 'g' || l_orderkey || '-' || l_linenumber WHEN l_orderkey = 0 THEN 'HASH_' || substr(sha256('SALESVCH_Sales_0_' || strftime(o_orderdate, '%Y-%m-%d')), 1, 16) ELSE 'MID_' || l_orderkey END AS voucher_id, l_orderkey::VARCHAR AS voucher_number,
  strftime(o_orderdate, '%Y-%m-%d') AS date, c_name AS party, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, l_returnflag = 'R' AS credit, l_linestatus = 'F' AS optional, p_name, s_name, l_quantity, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
_S04 = f"""SELECT voucher_id, voucher_number, date, party, ext::DOUBLE AS amount, credit AS amount_is_credit, optional AS is_optional, p_name AS item, l_quantity::DOUBLE AS quantity, 'Nos' AS unit, ext::DOUBLE AS line_amount, true AS line_is_credit, s_name AS cost_centre FROM {_BASE}"""


def _flat(canonical):
    e = normalize.entry_rows(canonical, ["*"], c("inventory_entries"))
    return e.select("voucher_id", "voucher_number", F.date_format("voucher_date", "yyyy-MM-dd").alias("date"), "party", c("amount").cast("double").alias("amount"), "amount_is_credit", "is_optional",
                    "e.item", c("e.quantity").cast("double").alias("quantity"), "e.unit", c("e.amount").cast("double").alias("line_amount"), c("e.is_credit").alias("line_is_credit"),
                    F.get("e.cost_centres", 0)["name"].alias("cost_centre"))


@q("S01_read_vouchers_xml", _S04)
def _(spark, sf):
    raw = raw_vouchers(spark, sf)
    xml = raw.select(F.to_xml(F.struct(*[c(f"`{n}`") for n in raw.columns]), {"rowTag": "VOUCHER"}).alias("xml"))
    return _flat(normalize.normalize_sales_vouchers(export_xml.parse_voucher_xml(xml, "xml").filter(f"{export_xml.CORRUPT} IS NULL"), "CO1"))


@q("S01_response_problems", "SELECT c_mktsegment AS file, CASE c_mktsegment WHEN 'BUILDING' THEN 'EMPTY' WHEN 'MACHINERY' THEN 'LINE_ERROR' WHEN 'FURNITURE' THEN 'NO_ENVELOPE' END AS problem FROM customer GROUP BY 1 HAVING c_mktsegment IN ('BUILDING','MACHINERY','FURNITURE')")
def _(spark, sf):
    seg = c("c_mktsegment")
    line = F.when(seg == "BUILDING", "  ").when(seg == "MACHINERY", "<ENVELOPE><LINEERROR>x</LINEERROR>").when(seg == "FURNITURE", "<BODY/>").otherwise("<ENVELOPE>")
    d = table(spark, sf, "customer").select(seg.alias("file"), line.alias("value")).groupBy("file").agg(
        F.count_if(F.length(F.trim("value")) > 0).alias("n"), F.max(c("value").contains("<LINEERROR")).alias("err"), F.max(c("value").contains("<ENVELOPE")).alias("env"))
    return d.select("file", export_xml.response_problem(c("n"), c("err"), c("env")).alias("problem")).filter("problem IS NOT NULL")


@q("S02_read_typed_json", """SELECT CASE WHEN c_custkey > 0 THEN 'MID_' || c_custkey ELSE 'NAME_' || c_name END AS source_object_id, c_name AS name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE END AS balance, c_acctbal > 0 AS active, '1998-07-15' AS opened FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'NAME_' || c_name, c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE END, c_acctbal > 0, '1998-07-15' FROM customer WHERE c_custkey = 0""")
def _(spark, sf):
    tagged = lambda kind, v: F.struct(L(kind).alias("type"), v.cast("string").alias("value"))
    item = F.struct(F.struct(L("Ledger").alias("type"), c("c_name").alias("name"), F.when(c("c_custkey") > 0, c("c_custkey").cast("string")).alias("masterId")).alias("metadata"),
                    F.when(c("c_mktsegment") != "MACHINERY", tagged("Amount", c("c_acctbal").cast(MONEY))).otherwise(tagged("Amount", L("n/a"))).alias("balance"),
                    tagged("Logical", F.when(c("c_acctbal") > 0, "Yes").otherwise("No")).alias("active"), tagged("Date", L("19980715")).alias("opened"))
    docs = table(spark, sf, "customer").select(F.to_json(F.struct(F.array(item).alias("collection"))).alias("doc"))
    out = typed_json.parse_typed_json(docs, "doc", {"balance": "number", "active": "boolean", "opened": "date"}, "CO1")
    return out.select("source_object_id", "name", c("balance").cast("double").alias("balance"), "active", F.date_format("opened", "yyyy-MM-dd").alias("opened"))


@q("S03_read_statement_json", """SELECT 'Balance Sheet' AS report, CASE WHEN c_acctbal >= 0 THEN 'sources' ELSE 'applications' END AS side, c_name AS name, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS amount FROM customer
  UNION ALL SELECT 'Profit and Loss', 'details', c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE FROM customer""")
def _(spark, sf):
    bal = c("c_acctbal").cast(MONEY).cast("string")
    detail = F.array(F.struct(F.struct(F.struct(c("c_name").alias("dspdispname")).alias("dspaccname")).alias("bsname"), F.array(F.struct(bal.alias("bsmainamt"))).alias("bsamt")))
    info = F.struct(F.struct(F.when(c("c_acctbal") >= 0, detail).alias("bsdetail")).alias("bssources"), F.struct(F.when(c("c_acctbal") < 0, detail).alias("bsdetail")).alias("bsapplications"))
    pl = F.create_map(c("c_mktsegment"), F.struct(L("Amount").alias("type"), bal.alias("value")))
    docs = table(spark, sf, "customer").select(F.to_json(F.struct(F.struct(F.struct(info.alias("bsinfo")).alias("bsbody"), pl.alias("plbody")).alias("data"))).alias("doc"))
    return typed_json.parse_statement_json(docs, "doc").select("report", "side", "name", c("amount").cast("double").alias("amount"))


@q("S04_normalize_sales_vouchers", _S04)
def _(spark, sf):
    return _flat(normalize.normalize_sales_vouchers(raw_vouchers(spark, sf), "CO1"))


@q("S04_voucher_tables", f"SELECT voucher_id, line, ledger, amount::DOUBLE AS amount, is_credit FROM (SELECT voucher_id, 1::BIGINT AS line, party AS ledger, ext AS amount, false AS is_credit FROM {_BASE} UNION ALL SELECT voucher_id, 2, 'Sales', ext, true FROM {_BASE})")
def _(spark, sf):
    _v, _s, ledger = normalize.voucher_tables(normalize.normalize_sales_vouchers(raw_vouchers(spark, sf), "CO1"))
    return ledger.select("voucher_id", "line", "ledger", c("amount").cast("double").alias("amount"), "is_credit")


@q("S05_normalize_accounting_vouchers", f"SELECT voucher_id, ext::DOUBLE AS amount, ext::DOUBLE AS debit_total, ext::DOUBLE AS credit_total, 2::BIGINT AS entries, 'B' || l_orderkey AS bill, ext::DOUBLE AS bill_amount FROM {_BASE}")
def _(spark, sf):
    d = normalize.normalize_accounting_vouchers(raw_vouchers(spark, sf), "CO1")
    bill = F.get(F.get("entries", 0)["bills"], 0)
    return d.select("voucher_id", *[c(x).cast("double").alias(x) for x in ("amount", "debit_total", "credit_total")], F.size("entries").cast("bigint").alias("entries"), bill["name"].alias("bill"),
                    bill["amount"].cast("double").alias("bill_amount"))


@q("S06_normalize_cost_allocations", f"SELECT voucher_id, 'inventory_entries' AS source, 1::BIGINT AS line, 'Sales' AS category, s_name AS cost_centre, ext::DOUBLE AS amount FROM {_BASE}")
def _(spark, sf):
    d = normalize.normalize_cost_allocations(normalize.normalize_sales_vouchers(raw_vouchers(spark, sf), "CO1"))
    return d.select("voucher_id", "source", "line", "category", "cost_centre", c("amount").cast("double").alias("amount"))


@q("S07_normalize_ledgers", """SELECT 'HASH_' || substr(sha256('LED_Sundry Debtors_' || c_name), 1, 16) AS source_object_id, c_name AS name, 'SUNDRY_DEBTOR' AS classification, abs(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS opening_balance, c_acctbal >= 0 AS opening_is_debit,
  abs(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS closing_balance, c_acctbal >= 0 AS closing_is_debit, c_mktsegment = 'BUILDING' AS bill_wise, 'Road 1, Surat' AS address FROM customer""")
def _(spark, sf):
    b = c("c_acctbal").cast(MONEY)
    raw = table(spark, sf, "customer").select(c("c_name").alias("NAME"), L("Sundry Debtors").alias("PARENT"), F.concat(F.format_number(F.abs(b), 2), F.when(b >= 0, " Dr").otherwise(" Cr")).alias("OPENINGBALANCE"),
                                              b.cast("string").alias("CLOSINGBALANCE"), F.when(c("c_mktsegment") == "BUILDING", "Yes").otherwise("No").alias("ISBILLWISEON"),
                                              F.array(L(" Road 1 "), L(""), L("Surat")).alias("ADDRESS.LIST"))
    d = normalize.normalize_ledgers(raw, "CO1")
    return d.select("source_object_id", "name", "classification", c("opening_balance").cast("double").alias("opening_balance"), "opening_is_debit",
                    c("closing_balance").cast("double").alias("closing_balance"), "closing_is_debit", "bill_wise", F.array_join("address_lines", ", ").alias("address"))


@q("S07_normalize_groups", "SELECT 'MID_' || (n_nationkey + 1) AS source_object_id, n_name AS name, CASE WHEN n_regionkey > 0 THEN 'Region ' || n_regionkey ELSE 'Primary' END AS parent, n_regionkey = 2 AS is_revenue FROM nation")
def _(spark, sf):
    raw = table(spark, sf, "nation").select(c("n_name").alias("NAME"), (c("n_nationkey") + 1).cast("string").alias("MASTERID"), F.when(c("n_regionkey") > 0, F.concat(L("Region "), c("n_regionkey"))).alias("PARENT"),
                                            F.when(c("n_regionkey") == 2, "yes").otherwise("no").alias("ISREVENUE"))
    return normalize.normalize_groups(raw, "CO1").select("source_object_id", "name", "parent", "is_revenue")


@q("S08_normalize_inventory_masters", """SELECT 'stock_item' AS domain, 'MID_' || (p_partkey + 1) AS source_object_id, p_name AS name, p_brand AS parent, p_size::DOUBLE AS quantity FROM part UNION ALL SELECT DISTINCT 'stock_group', 'HASH_' || substr(sha256('SGRP__' || p_brand), 1, 16), p_brand, 'Primary', NULL::DOUBLE FROM part
  UNION ALL SELECT DISTINCT 'stock_category', 'HASH_' || substr(sha256('SCAT__' || p_type), 1, 16), p_type, 'Primary', NULL FROM part UNION ALL SELECT 'godown', 'HASH_' || substr(sha256('GDN_Main_' || s_name), 1, 16), s_name, 'Main', NULL FROM supplier""")
def _(spark, sf):
    p, none = table(spark, sf, "part"), L(None).cast("double")
    items = normalize.normalize_stock_items(p.select(c("p_name").alias("NAME"), c("p_brand").alias("PARENT"), (c("p_partkey") + 1).cast("string").alias("MASTERID"),
                                                     F.concat(c("p_size"), L(" PCS")).alias("OPENINGBALANCE")), "CO1").withColumn("quantity", c("opening_quantity").cast("double"))
    groups = normalize.normalize_stock_groups(p.select(c("p_brand").alias("NAME")).distinct(), "CO1").withColumn("quantity", none)
    cats = normalize.normalize_stock_categories(p.select(c("p_type").alias("NAME")).distinct(), "CO1").withColumn("quantity", none)
    gods = normalize.normalize_godowns(table(spark, sf, "supplier").select(c("s_name").alias("NAME"), L("Main").alias("PARENT")), "CO1").withColumn("quantity", none)
    out = None
    for name, d in (("stock_item", items), ("stock_group", groups), ("stock_category", cats), ("godown", gods)):
        d = d.select(L(name).alias("domain"), "source_object_id", "name", "parent", "quantity")
        out = d if out is None else out.unionByName(d)
    return out


_DM = [("cost_category", "CCAT", "region", "r_name"), ("cost_centre", "CCTR", "supplier", "s_name"), ("voucher_type", "VTYP", "nation", "n_name"), ("currency", "CURR", "region", "r_name"), ("unit", "UNIT", "region", "r_name")]


@q("S09_normalize_dimension_masters", " UNION ALL ".join(f"SELECT '{d}' AS domain, 'HASH_' || substr(sha256('{p}__' || {n}), 1, 16) AS source_object_id, {n} AS name FROM {t}" for d, p, t, n in _DM))
def _(spark, sf):
    fns = {"cost_category": normalize.normalize_cost_categories, "cost_centre": normalize.normalize_cost_centres, "voucher_type": normalize.normalize_voucher_types,
           "currency": normalize.normalize_currencies, "unit": normalize.normalize_units}
    out = None
    for d, _p, t, n in _DM:
        rows = fns[d](table(spark, sf, t).select(c(n).alias("NAME")), "CO1").select(L(d).alias("domain"), "source_object_id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@q("S10_normalize_companies", "SELECT 'cmp-' || r_regionkey AS source_object_id, r_name AS name, CASE WHEN r_regionkey < 3 THEN '24AAAC' || r_regionkey END AS gstin, 'India' AS country FROM region")
def _(spark, sf):
    raw = table(spark, sf, "region").select(c("r_name").alias("NAME"), F.concat(L("cmp-"), c("r_regionkey")).alias("GUID"), F.when(c("r_regionkey") < 3, F.concat(L("24AAAC"), c("r_regionkey"))).alias("GSTREGISTRATIONNUMBER"),
                                            L("India").alias("COUNTRYNAME"))
    return normalize.normalize_companies(raw, "CO1").select("source_object_id", "name", "gstin", "country")


@q("S11_normalize_trial_balance", "SELECT c_name AS name, abs(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS opening, c_acctbal >= 0 AS opening_is_debit, 100.5::DOUBLE AS debit, 0.0::DOUBLE AS credit, abs(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS closing, c_acctbal >= 0 AS closing_is_debit FROM customer")
def _(spark, sf):
    b = c("c_acctbal").cast(MONEY)
    raw = table(spark, sf, "customer").select(c("c_name").alias("NAME"), L("Sundry Debtors").alias("PARENT"), F.concat(F.format_number(F.abs(b), 2), F.when(b >= 0, "").otherwise(" Cr")).alias("OPENINGBALANCE"),
                                              L("100.50").alias("DEBITTOTAL"), b.cast("string").alias("CLOSINGBALANCE"))
    d = normalize.normalize_trial_balance(raw, "CO1")
    return d.select("name", *[c(x).cast("double").alias(x) for x in ("opening", "debit", "credit", "closing")], "opening_is_debit", "closing_is_debit")


# --- mirror -----------------------------------------------------------------------------


def voucher_mirror(spark, sf):
    """A mirror of two companies with the same ids: an older state of every voucher, compacted, then a full read of the first company.

    The older state has other amounts and dates a year later, the full read lacks the cancelled vouchers.
    """
    v = books(spark, sf).vouchers
    rows = v.select("company_id", c("voucher_id").alias("source_object_id"), "voucher_number", "voucher_type", "voucher_date", "party", "amount", "alter_id", "is_cancelled")
    older = rows.withColumn("amount", c("amount") + 1).withColumn("voucher_date", F.add_months("voucher_date", 12))
    other = older.withColumn("company_id", L("CO2"))
    m = mr.Mirror(spark, f"{ensure_checkpoint_dir(spark)}/daybook-mirror-{uuid.uuid4().hex}", "vouchers")
    m.apply(older.unionByName(other), 1, "run-1")
    m.compact(1)
    m.apply(rows.filter(~c("is_cancelled")).withColumn("alter_id", c("alter_id") + 1), 2, "run-2", full_read=True, company="CO1")
    return m


def ledger_mirror(spark, sf, keep="true"):
    led = books(spark, sf).ledgers.drop("address_lines").withColumn("alter_id", L(1).cast("bigint"))
    m = mr.Mirror(spark, f"{ensure_checkpoint_dir(spark)}/daybook-mirror-{uuid.uuid4().hex}", "ledgers")
    m.apply(led.unionByName(led.withColumn("company_id", L("CO2"))), 1, "run-1")
    m.compact(1)
    m.apply(led.filter(keep).withColumn("alter_id", L(2).cast("bigint")), 2, "run-2")
    return m


@q("S12_scan_mirror_vouchers", books_sql() + "SELECT voucher_id AS source_object_id, amount::DOUBLE AS amount FROM vouchers WHERE NOT is_cancelled AND voucher_date BETWEEN DATE '1997-04-01' AND DATE '1998-03-31'")
def _(spark, sf):
    return mr.scan_mirror_vouchers(voucher_mirror(spark, sf), "CO1", date(1997, 4, 1), date(1998, 3, 31)).select("source_object_id", c("amount").cast("double").alias("amount"))


@q("S13_scan_mirror_domain", books_sql() + "SELECT source_object_id, name FROM ledgers")
def _(spark, sf):
    return mr.scan_mirror_domain(ledger_mirror(spark, sf), "CO1").select("source_object_id", "name")


@q("S14_write_mirror", books_sql() + "SELECT source_object_id, name FROM ledgers")
def _(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/daybook-mirror-{uuid.uuid4().hex}"
    m = mr.Mirror(spark, root, "ledgers")
    led = books(spark, sf).ledgers.drop("address_lines").withColumn("alter_id", L(1).cast("bigint"))
    m.apply(led, 1, "run-1")
    m.apply(led, 2, "run-2")
    return m.state().filter(~c("is_deleted")).select("source_object_id", "name")


@q("S15_domain_counts", books_sql() + "SELECT 'vouchers' AS domain, count(*) AS rows FROM vouchers WHERE NOT is_cancelled UNION ALL SELECT 'ledgers', count(*) FROM ledgers UNION ALL SELECT 'customers', count(*) FROM ledgers WHERE parent = 'Sundry Debtors' UNION ALL SELECT 'suppliers', count(*) FROM ledgers WHERE parent = 'Sundry Creditors'")
def _(spark, sf):
    from daybook.operators.fact import parties
    led = mr.scan_mirror_domain(ledger_mirror(spark, sf, c("parent") == "Sundry Debtors"), "CO1")
    vouchers = mr.scan_mirror_vouchers(voucher_mirror(spark, sf), "CO1")
    return mr.domain_counts({"vouchers": vouchers, "ledgers": led, "customers": parties(led, "customers"), "suppliers": parties(led, "suppliers")})


# --- change capture over the events feed: event_id is the version, user_id the object -----


def feed(spark, sf):
    return table(spark, sf, "events").select(L("CO1").alias("company_id"), c("user_id").cast("string").alias("source_object_id"), F.concat(L("g"), c("user_id")).alias("guid"), "event_type",
                                             F.floor("value").alias("level"), c("event_id").alias("alter_id"), "ts")


def first_half(spark, sf):
    e = feed(spark, sf)
    return e.filter("ts < '2024-01-15'").drop("ts"), e.filter("ts >= '2024-01-15'").drop("ts")


def state_of(batch):
    return mr.with_hash(mr.latest_per_key(batch)).withColumn("is_deleted", c("event_type") == "error")


_LATE = "SELECT user_id, arg_max(event_type, event_id) AS et, arg_max(floor(value), event_id) AS lv FROM events WHERE ts {op} TIMESTAMP '2024-01-15' GROUP BY 1"
_M01 = f"""WITH a AS ({_LATE.format(op='<')}), b AS ({_LATE.format(op='>=')}), k AS (SELECT b.user_id::VARCHAR AS source_object_id, CASE WHEN a.user_id IS NULL THEN 'INSERT' WHEN a.et = b.et AND a.lv = b.lv AND a.et <> 'error' THEN 'UNCHANGED' ELSE 'UPDATE' END AS change FROM b LEFT JOIN a USING (user_id)) """


def classified(spark, sf):
    old, new = first_half(spark, sf)
    return mr.upsert_by_hash(state_of(old), new, "run-2")


@q("M01_upsert_by_hash", _M01 + "SELECT source_object_id, change FROM k")
def _(spark, sf):
    return classified(spark, sf).select("source_object_id", "change")


@q("M01_upsert_stats", _M01 + "SELECT count(*) AS total, count(*) FILTER (change = 'INSERT') AS inserted, count(*) FILTER (change = 'UPDATE') AS updated, count(*) FILTER (change = 'UNCHANGED') AS unchanged FROM k")
def _(spark, sf):
    return mr.upsert_stats(classified(spark, sf))


_LIVE = f"l AS (SELECT user_id FROM ({_LATE.format(op='<')}) WHERE et <> 'error'), g AS (SELECT user_id FROM l WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'))"


@q("M02_tombstone_missing", f"WITH {_LIVE} SELECT (SELECT count(*) FROM l) AS live, (SELECT count(*) FROM g) AS vanished, CASE WHEN (SELECT count(*) FROM g) > greatest(10, floor((SELECT count(*) FROM l) * 0.15)) THEN 0 ELSE (SELECT count(*) FROM g) END AS tombstoned")
def _(spark, sf):
    old, new = first_half(spark, sf)
    d = mr.tombstone_missing(state_of(old), new, "run-2")
    return d.rows.agg(F.count(L(1)).alias("tombstoned")).select(L(d.live).cast("bigint").alias("live"), L(d.vanished).cast("bigint").alias("vanished"), "tombstoned")


_GONE = f"WITH l AS (SELECT user_id FROM ({_LATE.format(op='<')}) WHERE et <> 'error'), keep AS (SELECT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l ORDER BY user_id LIMIT 5)), x AS (SELECT user_id::VARCHAR AS source_object_id FROM l WHERE user_id NOT IN (SELECT user_id FROM keep)) "


def deletions(spark, sf):
    old, _new = first_half(spark, sf)
    state = state_of(old)
    gone = state.filter(~c("is_deleted")).select("source_object_id").orderBy(c("source_object_id").cast("bigint")).limit(5)
    keys = feed(spark, sf).join(gone, "source_object_id", "left_anti").select("company_id", "guid", F.when(c("alter_id") < 0, c("source_object_id")).alias("source_object_id")).distinct()
    return mr.detect_deletions(state, keys, "run-3")


@q("M03_detect_deletions", _GONE + "SELECT source_object_id, 'DELETE' AS change FROM x")
def _(spark, sf):
    return deletions(spark, sf).rows.select("source_object_id", "change")


@q("M04_incremental_cursor", "WITH m AS (SELECT max(event_id) AS k FROM events WHERE ts < TIMESTAMP '2024-01-15') SELECT count(*) FILTER (event_id > k) AS processed, greatest(max(event_id), max(k)) AS checkpoint FROM events, m")
def _(spark, sf):
    old, _new = first_half(spark, sf)
    mark = old.agg(F.max("alter_id")).scalar()
    return mr.incremental_cursor(feed(spark, sf), mark)[1]


@q("M04_replay_is_noop", "SELECT 0::BIGINT AS processed, max(event_id) AS checkpoint FROM events")
def _(spark, sf):
    e = feed(spark, sf)
    return mr.incremental_cursor(e, e.agg(F.max("alter_id")).scalar())[1]


@q("M05_cdc_stream", "SELECT user_id::VARCHAR AS source_object_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS alter_id FROM events GROUP BY 1")
def _(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/daybook-cdc-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    source = raw.select(L("CO1").alias("company_id"), c("user_id").cast("string").alias("source_object_id"), "event_type", F.floor("value").alias("level"), c("event_id").alias("alter_id"))
    m = mr.Mirror(spark, root, "events")
    cdc.cdc_stream(source, m, f"{root}/_checkpoint").awaitTermination()
    return m.state().select("source_object_id", "event_type", "alter_id")


@q("M06_change_events", _M01 + ", " + _GONE.removeprefix("WITH ") + "SELECT source_object_id, change FROM k WHERE change <> 'UNCHANGED' UNION ALL SELECT source_object_id, 'DELETE' FROM x")
def _(spark, sf):
    return mr.change_events(classified(spark, sf), deletions(spark, sf).rows).select("source_object_id", "change")


@q("M07_sync_run", books_sql() + "SELECT d AS domain, CASE WHEN d = 'units' THEN 'SKIPPED' WHEN d = 'bad' THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE d WHEN 'ledgers' THEN (SELECT count(*) FROM ledgers) WHEN 'vouchers' THEN (SELECT count(*) FROM vouchers) ELSE 0 END AS inserted, 'PARTIAL' AS run_status FROM (VALUES ('ledgers'), ('units'), ('bad'), ('vouchers')) t(d)")
def _(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/daybook-sync-{uuid.uuid4().hex}"
    b = books(spark, sf)
    led = b.ledgers.drop("address_lines").withColumn("alter_id", L(1).cast("bigint"))
    v = b.vouchers.withColumnRenamed("voucher_id", "source_object_id")
    return cdc.sync_run(spark, root, "CO1", {"ledgers": led, "units": None, "bad": led.drop("alter_id"), "vouchers": v}, 1).select("domain", "status", "inserted", "run_status")


@q("M08_streaming_register", books_sql() + f"SELECT strftime(voucher_date, '%Y-%m') AS month, {FLOW_OF} AS flow, count(*) AS vouchers, sum(amount)::DOUBLE AS amount FROM vouchers WHERE NOT is_cancelled GROUP BY 1, 2")
def _(spark, sf):
    schema = table(spark, sf, "orders").schema
    b = books(spark, sf)
    raw = spark.readStream.schema(schema).parquet(f"{sf}/order[s].parquet")
    kinds = b.vouchers.select("priority", "state_code", "voucher_type").distinct()
    v = raw.join(kinds, (c("o_orderpriority") == c("priority")) & (c("o_orderstatus") == c("state_code"))).select(
        "voucher_type", c("o_orderdate").cast("date").alias("voucher_date"), c("o_totalprice").cast(MONEY).alias("amount"), (c("o_totalprice") < 5000).alias("is_cancelled"))
    name = f"register_{uuid.uuid4().hex}"
    query = cdc.streaming_register(v, b.types).writeStream.outputMode("complete").format("memory").queryName(name).option(
        "checkpointLocation", f"{ensure_checkpoint_dir(spark)}/daybook-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.date_format("month", "yyyy-MM").alias("month"), "flow", "vouchers", c("amount").cast("double").alias("amount"))


@q("M08_register_with_retractions", """WITH l AS (SELECT user_id, max_by(ts + to_months((event_id % 3)::INTEGER), event_id) AS ts, max_by(event_type, event_id) AS et, max_by(floor(value), event_id) AS v FROM events GROUP BY 1)
SELECT strftime(ts, '%Y-%m') AS month, CASE et WHEN 'purchase' THEN 'SALES' WHEN 'view' THEN 'PURCHASE' ELSE 'RECEIPT' END AS flow, count(*) AS vouchers, sum(v)::DOUBLE AS amount FROM l WHERE et <> 'error' GROUP BY 1, 2""")
def _(spark, sf):
    # Each event is a version of its user's voucher: dates move, amounts change, errors delete. Five files, a restart after two.
    root = f"{ensure_checkpoint_dir(spark)}/daybook-retract-{uuid.uuid4().hex}"
    kind = F.when(c("event_type") == "purchase", "Sales").when(c("event_type") == "view", "Purchase").otherwise("Receipt")
    feed = table(spark, sf, "events").select(
        L("CO1").alias("company_id"), c("user_id").cast("string").alias("source_object_id"), c("event_id").alias("alter_id"), kind.alias("voucher_type"),
        F.add_months(c("ts").cast("date"), (c("event_id") % 3).cast("int")).alias("voucher_date"), F.floor("value").cast(MONEY).alias("amount"), L(False).alias("is_cancelled"), (c("event_type") == "error").alias("is_deleted"), (c("ts") < "2024-01-15").alias("is_early"))
    types = spark.range(0).select(L("").alias("name"), L("").alias("parent"))
    for early in (True, False):
        part = feed.filter(c("is_early") == L(early))
        part.repartitionByRange(2 if early else 3, "alter_id").write.mode("append").parquet(f"{root}/landing")
        source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
        cdc.register_stream(source, types, root).awaitTermination()
    return cdc.read_register(spark, root).select(F.date_format("month", "yyyy-MM").alias("month"), "flow", "vouchers", c("amount").cast("double").alias("amount"))
