"""Canonical accounting tables derived from the driver's star tables, in Spark and in SQL.

Voucher kind, party, taxes, addresses and masters are expressions over the given rows,
so every table grows with them.
"""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import MONEY, table

c, L = F.col, F.lit

TYPE_PARENTS = [("Export Sales", "Sales"), ("Sales Return Note", "Credit Note"), ("Tax Invoice GST", "Retail Counter"), ("Retail Counter", "Sales"),
                ("Local Purchase", "Purchase"), ("Purchase Return", "Debit Note"), ("Sales Order", "Sales Order"), ("Cash Payment", "Payment"),
                ("Bank Receipt", "Receipt")]
# Kinds whose party is credited; their round-off adds on the debit side.
PARTY_CREDITED = ["Sales Return Note", "Local Purchase", "Bank Receipt"]
NATION_PARENTS = ["Bank Accounts", "Cash-in-Hand", "Duties & Taxes", "Indirect Expenses", "Direct Income", "Fixed Assets", "Capital Account",
                  "Suspense", "Loans (Liability)"]


def company(key: Column) -> Column:
    """The company of a row with this key, read from the row as in a real book.

    A literal is folded out of the keys of joins and not out of those of groups, so every voucher would move once for each.
    """
    return F.concat_ws("", L("CO1"), F.substring(key.cast("string"), 1, 0))


def voucher(key: Column) -> Column:
    return F.concat(L("V"), key)


class Books:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def _headers(self) -> DataFrame:
        return self.t("orders").join(self.t("customer").select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"), "left")

    @cached_property
    def vouchers(self) -> DataFrame:
        return self._vouchers(self._headers())

    def _vouchers(self, headers: DataFrame) -> DataFrame:
        pr, st = c("o_orderpriority"), c("o_orderstatus")
        kind = (F.when(pr == "1-URGENT", "Export Sales").when(pr == "2-HIGH", "Sales Return Note").when(pr == "3-MEDIUM", "Tax Invoice GST")
                .when((pr == "4-NOT SPECIFIED") & (st == "P"), "Purchase Return").when(pr == "4-NOT SPECIFIED", "Local Purchase")
                .when(st == "O", "Sales Order").when(st == "P", "Cash Payment").otherwise("Bank Receipt"))
        return headers.select(
            company(c("o_orderkey")).alias("company_id"), voucher(c("o_orderkey")).alias("voucher_id"), c("o_orderkey").cast("string").alias("voucher_number"),
            kind.alias("voucher_type"), c("o_orderdate").cast("date").alias("voucher_date"), c("c_name").alias("party"),
            c("o_totalprice").cast(MONEY).alias("amount"), (c("o_totalprice") < 5000).alias("is_cancelled"), (c("o_totalprice") >= 495000).alias("is_optional"),
            c("o_orderkey").alias("alter_id"), pr.alias("priority"), st.alias("state_code"))

    @cached_property
    def types(self) -> DataFrame:
        rows = F.array(*[F.struct(L(n).alias("name"), L(p).alias("parent")) for n, p in TYPE_PARENTS])
        return self.spark.range(1).select(F.inline(rows))

    @staticmethod
    def _named(parts: DataFrame) -> DataFrame:
        unit = F.when(c("p_type").isin("STANDARD", "MEDIUM"), "PCS").when(c("p_type") == "LARGE", "BOX").otherwise("KG")
        return parts.withColumns({"unit": unit, "item": F.concat_ws(" #", c("p_name"), c("p_partkey").cast("string"))})

    def _items(self) -> DataFrame:
        return self._named(self.t("part"))

    @cached_property
    def stock_lines(self) -> DataFrame:
        return self._stock_lines(self._sold())

    @cached_property
    def stock_by_voucher(self) -> DataFrame:
        """The stock lines, laid out by voucher before their texts are made: what groups or joins them by voucher moves nothing more."""
        return self._stock_lines(self._sold().repartition(company(c("l_orderkey")), voucher(c("l_orderkey"))))

    def _sold(self) -> DataFrame:
        part, sup = self.t("part").select("p_partkey", "p_name", "p_type"), self.t("supplier").select("s_suppkey", "s_name")
        return self.t("lineitem").join(part, c("l_partkey") == c("p_partkey"), "left").join(sup, c("l_suppkey") == c("s_suppkey"), "left")

    def _stock_lines(self, sold: DataFrame) -> DataFrame:
        known = c("p_partkey").isNotNull()  # an item that is not among the parts has neither name nor unit
        named = self._named(sold).withColumns({"unit": F.when(known, c("unit")), "item": F.when(known, c("item"))})
        return named.select(
            company(c("l_orderkey")).alias("company_id"), voucher(c("l_orderkey")).alias("voucher_id"),
            F.concat(L("V"), c("l_orderkey"), L("#INV"), c("l_linenumber")).alias("entry_id"), c("l_linenumber").cast("bigint").alias("line"), "item",
            c("l_quantity").cast("decimal(18,3)").alias("quantity"), "unit", F.concat(L("10/"), c("unit")).alias("rate"),
            c("l_extendedprice").cast(MONEY).alias("amount"), L(True).alias("is_credit"),
            F.when(c("l_discount") > 0.02, c("s_name")).alias("cost_centre"))

    @cached_property
    def ledger_lines(self) -> DataFrame:
        none = L(None).cast("string")
        entry = lambda name, amount, credit, when=L(True), line=None, centre=none: F.when(when, F.struct(
            *([] if line is None else [L(line).cast("bigint").alias("line")]), name.alias("ledger"), amount.cast(MONEY).alias("amount"),
            (L(credit) if isinstance(credit, bool) else credit).alias("is_credit"), centre.alias("cost_centre")))
        # Both kinds of lines are laid out by voucher while a row is one line item or header of numbers, before each becomes several lines.
        credited, odd = c("voucher_type").isin(PARTY_CREDITED), c("amount") - F.round("amount", 0)
        heads = self._vouchers(self._headers().repartition(company(c("o_orderkey")), voucher(c("o_orderkey"))))
        header = heads.select("company_id", "voucher_id", F.inline(F.array_compact(F.array(
            entry(c("party"), c("amount"), credited, line=1), entry(L("Round Off"), F.abs(odd), (odd >= 0) != credited, line=2),
            entry(L("Freight Outward"), L("25.00"), True, c("state_code") == "F", 3, L("Head Office")),
            entry(L("Consulting Income"), L("500.00"), True, (c("priority") == "1-URGENT") & (c("state_code") == "O"), 4)))))
        cust = self.t("customer").select("c_custkey", "c_nationkey").join(self.t("nation").select("n_nationkey", "n_regionkey"), c("c_nationkey") == c("n_nationkey"))
        place = self.t("orders").select("o_orderkey", "o_custkey").join(cust, c("o_custkey") == c("c_custkey")).select("o_orderkey", c("n_regionkey").alias("rk"))
        li = self.t("lineitem").join(self.t("part").select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"), "left").join(
            place, (company(c("l_orderkey")) == company(c("o_orderkey"))) & (voucher(c("l_orderkey")) == voucher(c("o_orderkey"))))
        ext = c("l_extendedprice").cast(MONEY)
        tax = (ext * c("l_tax").cast("decimal(4,2)")).cast(MONEY)
        half = (ext * c("l_tax").cast("decimal(4,2)") * L("0.5").cast("decimal(2,1)")).cast(MONEY)
        disc = (ext * c("l_discount").cast("decimal(4,2)")).cast(MONEY)
        local = c("rk") <= 1
        parts = F.array(entry(F.concat(L("Sales Account "), c("p_type")), ext, True), entry(L("Output CGST"), half, True, local),
                        entry(L("Output SGST"), half, True, local), entry(L("Output IGST"), tax, True, ~local), entry(L("Trade Discount"), disc, False))
        lines = li.select(company(c("l_orderkey")).alias("company_id"), voucher(c("l_orderkey")).alias("voucher_id"), (c("l_linenumber") + 10).cast("bigint").alias("line"),
                          F.inline(F.array_compact(parts)))
        return lines.unionByName(header)

    @cached_property
    def ledgers(self) -> DataFrame:
        n = self.t("nation").join(self.t("region"), c("n_regionkey") == c("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
        town = F.concat(F.char(L(65) + c("n_nationkey")), L("pur"))
        seg = c("c_mktsegment")
        address = (F.when(seg == "AUTOMOBILE", F.array(L("Plot 12 Mill Road"), F.concat(town, L(" - 380015"))))
                   .when(seg == "BUILDING", F.array(F.concat(L("Near Lake, "), town, L(", "), c("r_name"))))
                   .when(seg == "FURNITURE", F.array(L("Gate 4"), town)).when(seg == "HOUSEHOLD", F.array(L("PO Box 55"), L("9876543210"))))
        none = L(None).cast("string")
        cust = self.t("customer").join(n, c("c_nationkey") == c("n_nationkey"), "left").filter(c("c_acctbal") >= 0).select(
            company(c("c_custkey")).alias("company_id"), F.concat(L("L"), c("c_custkey")).alias("source_object_id"), F.upper("c_name").alias("name"),
            L("Sundry Debtors").alias("parent"), L("India").alias("country"), F.when(c("r_name") != "EUROPE", c("r_name")).alias("state"),
            address.alias("address_lines"), c("c_acctbal").cast(MONEY).alias("closing_balance"))
        sup = self.t("supplier").select(company(c("s_suppkey")).alias("company_id"), F.concat(L("S"), c("s_suppkey")).alias("source_object_id"), c("s_name").alias("name"),
                                        L("Sundry Creditors").alias("parent"), L("India").alias("country"), L("Gujarat").alias("state"),
                                        F.array(L("Yard 7"), L("Surat - 395003")).alias("address_lines"), c("s_acctbal").cast(MONEY).alias("closing_balance"))
        acct = self.t("part").groupBy("p_type").agg(F.sum(c("p_retailprice").cast(MONEY)).cast(MONEY).alias("b")).select(
            company(c("p_type")).alias("company_id"), F.concat(L("A"), c("p_type")).alias("source_object_id"), F.concat(L("Sales Account "), c("p_type")).alias("name"),
            L("Sales Accounts").alias("parent"), none.alias("country"), none.alias("state"), L(None).cast("array<string>").alias("address_lines"), c("b").alias("closing_balance"))
        nat = n.select(company(c("n_nationkey")).alias("company_id"), F.concat(L("N"), c("n_nationkey")).alias("source_object_id"), F.concat(L("Ledger "), c("n_name")).alias("name"),
                       F.get(F.array(*[L(x) for x in NATION_PARENTS]), c("n_nationkey") % len(NATION_PARENTS)).alias("parent"), none.alias("country"), none.alias("state"),
                       L(None).cast("array<string>").alias("address_lines"), L(None).cast(MONEY).alias("closing_balance"))
        return cust.unionByName(sup).unionByName(acct).unionByName(nat)

    @cached_property
    def items(self) -> DataFrame:
        return self._items().filter(c("p_size") <= 45).select(company(c("p_partkey")).alias("company_id"), F.concat(L("I"), c("p_partkey")).alias("source_object_id"),
                                                              c("item").alias("name"), c("p_brand").alias("parent"), c("unit").alias("base_units"))

    @cached_property
    def groups(self) -> DataFrame:
        p = self.t("part")
        kinds = p.select("p_type").distinct().select(company(c("p_type")).alias("company_id"), F.concat(L("GT"), c("p_type")).alias("source_object_id"), c("p_type").alias("name"),
                                                     L("Primary").alias("parent"))
        brands = p.filter(c("p_brand") != "Brand#25").groupBy("p_brand").agg(F.min("p_type").alias("t")).select(
            company(c("p_brand")).alias("company_id"), F.concat(L("GB"), c("p_brand")).alias("source_object_id"), c("p_brand").alias("name"), c("t").alias("parent"))
        return kinds.unionByName(brands)

    @cached_property
    def cost_centres(self) -> DataFrame:
        return self.t("supplier").select(company(c("s_suppkey")).alias("company_id"), F.concat(L("C"), c("s_suppkey")).alias("source_object_id"), c("s_name").alias("name"))

    @cached_property
    def classes(self) -> DataFrame:
        seg = c("c_mktsegment")
        return self.t("customer").filter(seg != "HOUSEHOLD").select(
            company(c("c_custkey")).alias("company_id"), F.concat(L("L"), c("c_custkey")).alias("ledger_id"), F.when(c("c_acctbal") > 5000, "A").otherwise("B").alias("tier"),
            seg.alias("customer_type"), F.when(seg == "BUILDING", "manual").when(seg == "MACHINERY", "external_master").when(seg == "FURNITURE", "guess")
            .otherwise("ledger_group").alias("source"), L("2024-01-01").alias("updated_at"))


_books: dict = {}


def books(spark: SparkSession, sf: str) -> Books:
    """Frame definitions are kept per session (nothing is materialised)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _books:
        _books[key] = Books(spark, sf)
    return _books[key]


# --- the same tables in SQL --------------------------------------------------------------

KIND = """CASE WHEN o_orderpriority='1-URGENT' THEN 'Export Sales' WHEN o_orderpriority='2-HIGH' THEN 'Sales Return Note' WHEN o_orderpriority='3-MEDIUM' THEN 'Tax Invoice GST'
 WHEN o_orderpriority='4-NOT SPECIFIED' AND o_orderstatus='P' THEN 'Purchase Return' WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'Local Purchase'
 WHEN o_orderstatus='O' THEN 'Sales Order' WHEN o_orderstatus='P' THEN 'Cash Payment' ELSE 'Bank Receipt' END"""
CLASS_OF = """CASE WHEN voucher_type IN ('Export Sales','Tax Invoice GST') THEN 'SALES' WHEN voucher_type='Sales Return Note' THEN 'CREDIT_NOTE'
 WHEN voucher_type='Local Purchase' THEN 'PURCHASE' WHEN voucher_type='Purchase Return' THEN 'DEBIT_NOTE' WHEN voucher_type='Sales Order' THEN 'ORDER'
 WHEN voucher_type='Cash Payment' THEN 'PAYMENT' ELSE 'RECEIPT' END"""
FLOW_OF = """CASE WHEN voucher_type IN ('Export Sales','Tax Invoice GST') THEN 'SALES' WHEN voucher_type='Sales Return Note' THEN 'SALES_RETURN'
 WHEN voucher_type='Local Purchase' THEN 'PURCHASE' WHEN voucher_type='Purchase Return' THEN 'PURCHASE_RETURN' WHEN voucher_type='Sales Order' THEN 'ORDER'
 WHEN voucher_type='Cash Payment' THEN 'PAYMENT' ELSE 'RECEIPT' END"""


@cache
def books_sql() -> str:
    parents = ", ".join(f"'{x}'" for x in NATION_PARENTS)
    types = ", ".join(f"('{n}', '{p}')" for n, p in TYPE_PARENTS)
    credited = "voucher_type IN (" + ", ".join(f"'{x}'" for x in PARTY_CREDITED) + ")"
    town = "chr(65 + n_nationkey) || 'pur'"
    return f"""WITH vouchers AS (SELECT 'CO1' AS company_id, 'V' || o_orderkey AS voucher_id, o_orderkey::VARCHAR AS voucher_number, {KIND} AS voucher_type,
   CAST(o_orderdate AS DATE) AS voucher_date, c_name AS party, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_totalprice < 5000 AS is_cancelled, o_totalprice >= 495000 AS is_optional,
   o_orderkey AS alter_id, o_orderpriority AS priority, o_orderstatus AS state_code FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
types(name, parent) AS (VALUES {types}),
part_items AS (SELECT *, p_name || ' #' || p_partkey AS item, CASE WHEN p_type IN ('STANDARD','MEDIUM') THEN 'PCS' WHEN p_type='LARGE' THEN 'BOX' ELSE 'KG' END AS unit FROM part),
stock_lines AS (SELECT 'CO1' AS company_id, 'V' || l_orderkey AS voucher_id, 'V' || l_orderkey || '#INV' || l_linenumber AS entry_id, l_linenumber::BIGINT AS line, item,
   CAST(l_quantity AS DECIMAL(18,3)) AS quantity, unit, '10/' || unit AS rate, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, true AS is_credit,
   CASE WHEN l_discount > 0.02 THEN s_name END AS cost_centre FROM lineitem LEFT JOIN part_items ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
li AS (SELECT 'V' || l_orderkey AS voucher_id, l_linenumber + 10 AS line, p_type, n_regionkey <= 1 AS local, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_tax AS DECIMAL(4,2)) AS tx,
   CAST(l_discount AS DECIMAL(4,2)) AS dc FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
   LEFT JOIN part ON l_partkey = p_partkey),
ledger_lines AS (
   SELECT 'CO1' AS company_id, voucher_id, 1::BIGINT AS line, party AS ledger, amount, {credited} AS is_credit, NULL::VARCHAR AS cost_centre FROM vouchers
   UNION ALL SELECT 'CO1', voucher_id, 2, 'Round Off', CAST(abs(amount - round(amount, 0)) AS DECIMAL(18,2)), (amount >= round(amount, 0)) <> ({credited}), NULL FROM vouchers
   UNION ALL SELECT 'CO1', voucher_id, 3, 'Freight Outward', 25.00, true, 'Head Office' FROM vouchers WHERE state_code = 'F'
   UNION ALL SELECT 'CO1', voucher_id, 4, 'Consulting Income', 500.00, true, NULL FROM vouchers WHERE priority = '1-URGENT' AND state_code = 'O'
   UNION ALL SELECT 'CO1', voucher_id, line, 'Sales Account ' || p_type, ext, true, NULL FROM li
   UNION ALL SELECT 'CO1', voucher_id, line, 'Output CGST', CAST(ext * tx * 0.5 AS DECIMAL(18,2)), true, NULL FROM li WHERE local
   UNION ALL SELECT 'CO1', voucher_id, line, 'Output SGST', CAST(ext * tx * 0.5 AS DECIMAL(18,2)), true, NULL FROM li WHERE local
   UNION ALL SELECT 'CO1', voucher_id, line, 'Output IGST', CAST(ext * tx AS DECIMAL(18,2)), true, NULL FROM li WHERE NOT local
   UNION ALL SELECT 'CO1', voucher_id, line, 'Trade Discount', CAST(ext * dc AS DECIMAL(18,2)), false, NULL FROM li),
ledgers AS (
   SELECT 'CO1' AS company_id, 'L' || c_custkey AS source_object_id, upper(c_name) AS name, 'Sundry Debtors' AS parent, 'India' AS country, CASE WHEN r_name <> 'EUROPE' THEN r_name END AS state,
     CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['Plot 12 Mill Road', {town} || ' - 380015'] WHEN 'BUILDING' THEN ['Near Lake, ' || {town} || ', ' || r_name]
       WHEN 'FURNITURE' THEN ['Gate 4', {town}] WHEN 'HOUSEHOLD' THEN ['PO Box 55', '9876543210'] END AS address_lines, CAST(c_acctbal AS DECIMAL(18,2)) AS closing_balance,
     CASE WHEN c_mktsegment = 'BUILDING' AND r_name = 'EUROPE' THEN 'EUROPE' WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE') THEN {town} END AS city,
     CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'high' WHEN 'BUILDING' THEN 'low' WHEN 'FURNITURE' THEN 'medium' ELSE 'none' END AS city_confidence,
     CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'CITY_NOT_PARSEABLE' WHEN 'MACHINERY' THEN 'ADDRESS_EMPTY' END AS city_reason
     FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0
   UNION ALL SELECT 'CO1', 'S' || s_suppkey, s_name, 'Sundry Creditors', 'India', 'Gujarat', ['Yard 7', 'Surat - 395003'], CAST(s_acctbal AS DECIMAL(18,2)), 'Surat', 'high', NULL FROM supplier
   UNION ALL SELECT 'CO1', 'A' || p_type, 'Sales Account ' || p_type, 'Sales Accounts', NULL, NULL, NULL, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(18,2)), NULL, 'none', 'ADDRESS_EMPTY' FROM part GROUP BY p_type
   UNION ALL SELECT 'CO1', 'N' || n_nationkey, 'Ledger ' || n_name, [{parents}][n_nationkey % {len(NATION_PARENTS)} + 1], NULL, NULL, NULL, NULL, NULL, 'none', 'ADDRESS_EMPTY' FROM nation),
items AS (SELECT 'CO1' AS company_id, 'I' || p_partkey AS source_object_id, item AS name, p_brand AS parent, unit AS base_units FROM part_items WHERE p_size <= 45),
groups AS (SELECT DISTINCT 'CO1' AS company_id, 'GT' || p_type AS source_object_id, p_type AS name, 'Primary' AS parent FROM part
   UNION ALL SELECT 'CO1', 'GB' || p_brand, p_brand, min(p_type) FROM part WHERE p_brand <> 'Brand#25' GROUP BY p_brand),
cost_centres AS (SELECT 'CO1' AS company_id, 'C' || s_suppkey AS source_object_id, s_name AS name FROM supplier),
classes AS (SELECT 'CO1' AS company_id, 'L' || c_custkey AS ledger_id, CASE WHEN c_acctbal > 5000 THEN 'A' ELSE 'B' END AS tier, c_mktsegment AS customer_type,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'manual' WHEN 'MACHINERY' THEN 'external_master' WHEN 'FURNITURE' THEN 'guess' ELSE 'ledger_group' END AS source FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
roled AS (SELECT l.*, v.party, v.{credited} AS credited, CASE WHEN lower(trim(l.ledger)) = lower(trim(v.party)) THEN 'PARTY' WHEN ledger = 'Output CGST' THEN 'TAX_CGST' WHEN ledger = 'Output SGST' THEN 'TAX_SGST'
   WHEN ledger = 'Output IGST' THEN 'TAX_IGST' WHEN ledger = 'Round Off' THEN 'ROUND_OFF' WHEN ledger = 'Trade Discount' THEN 'DISCOUNT' WHEN ledger = 'Freight Outward' THEN 'ADDITIONAL_CHARGES'
   ELSE 'BASE_AMOUNT' END AS role FROM ledger_lines l JOIN vouchers v USING (voucher_id)),
charges AS (SELECT voucher_id, coalesce(sum(abs(amount)) FILTER (role LIKE 'TAX%'), 0) AS tax, coalesce(sum(abs(amount)) FILTER (role = 'ADDITIONAL_CHARGES'), 0) AS ch,
   coalesce(sum(CASE WHEN is_credit = credited THEN -amount ELSE amount END) FILTER (role = 'ROUND_OFF'), 0) AS ro, coalesce(sum(abs(amount)) FILTER (role = 'DISCOUNT'), 0) AS di, coalesce(sum(abs(amount)) FILTER (role = 'BASE_AMOUNT'), 0) AS base,
   arg_min(ledger, (line, ledger)) FILTER (role = 'BASE_AMOUNT') AS base_ledger, coalesce(sum(abs(amount)) FILTER (role = 'TAX_CGST'), 0) AS cgst, coalesce(sum(abs(amount)) FILTER (role = 'TAX_SGST'), 0) AS sgst,
   coalesce(sum(abs(amount)) FILTER (role = 'TAX_IGST'), 0) AS igst FROM roled GROUP BY 1)
"""
