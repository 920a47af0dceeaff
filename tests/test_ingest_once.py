"""Raw vouchers are parsed once a record, amounts keep their reading, and base ledgers take one join over the lines."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from daybook.functions.identity import signed_text_amount
from daybook.operators import fact as ft
from daybook.sources import export_xml, normalize

XML = """<VOUCHER><GUID>g1</GUID><VOUCHERNUMBER>7</VOUCHERNUMBER><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><DATE>20240131</DATE><AMOUNT>Dr = 12.50</AMOUNT>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>A</LEDGERNAME><AMOUNT>12.50</AMOUNT><CATEGORYALLOCATIONS.LIST><CATEGORY>K</CATEGORY><COSTCENTREALLOCATIONS.LIST><NAME>n1</NAME><AMOUNT>2</AMOUNT>
</COSTCENTREALLOCATIONS.LIST></CATEGORYALLOCATIONS.LIST></ALLLEDGERENTRIES.LIST>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>i</STOCKITEMNAME><BILLEDQTY>3 Nos</BILLEDQTY><AMOUNT>-12.50</AMOUNT><COSTCENTREALLOCATIONS.LIST><NAME>n2</NAME><AMOUNT>5</AMOUNT>
</COSTCENTREALLOCATIONS.LIST></ALLINVENTORYENTRIES.LIST></VOUCHER>"""


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def canonical(spark):
    raw = spark.createDataFrame([(XML,), ("<VOUCHER><GUID>",), (None,)], "xml string").repartition(2)
    parsed = export_xml.parse_voucher_xml(raw, "xml").filter(f"{export_xml.CORRUPT} IS NULL")
    return normalize.normalize_sales_vouchers(parsed, "CO1")


def test_xml_is_parsed_once_a_record(spark):
    rows = normalize.entry_rows(canonical(spark), ["voucher_id", "amount", "voucher_date"], F.col("inventory_entries")).select("voucher_id", "amount", "e.quantity", "e.is_credit")
    assert [tuple(r) for r in rows.collect()] == [("g1", Decimal("12.50"), Decimal("3.000"), True)]
    assert optimized(rows).count("from_xml(") == 1


def test_cost_allocations_of_both_kinds_in_one_pass(spark):
    rows = normalize.normalize_cost_allocations(canonical(spark).filter("guid IS NOT NULL"))
    assert sorted((r["source"], r["line"], r["category"], r["cost_centre"], r["amount"]) for r in rows.collect()) == [
        ("inventory_entries", 1, None, "n2", Decimal("5.00")), ("ledger_entries", 1, "K", "n1", Decimal("2.00"))]
    assert "Union" not in optimized(rows)


def test_amount_texts(spark):
    given = {"12.5": "12.50", " 7 ": "7.00", "-3": "-3.00", "1e2": "100.00", "4.5 Cr": "-4.50", "Dr = 6": "6.00", "1,200 Cr": "-1200.00", "x = -9": "-9.00", "": "0.00", "n/a": "0.00",
             "١٢": "12.00", " 8": "8.00", "\t5\n": "5.00", "+2": "2.00", "1e": "1.00"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", signed_text_amount(F.col("t")).alias("v")).collect()}
    assert got == {k: Decimal(v) for k, v in given.items()}


def test_base_ledgers_join_the_lines_once(spark):
    v = spark.createDataFrame([("C", "1", "Tax Office"), ("C", "2", None)], "company_id string, voucher_id string, party string")
    lines = spark.createDataFrame([("C", "1", 1, "Tax office "), ("C", "1", 3, "Sales B"), ("C", "1", 2, "Sales A"), ("C", "2", 1, "Output CGST"), ("C", "3", 1, "Sales")],
                                  "company_id string, voucher_id string, line bigint, ledger string")
    out = ft.base_ledgers(lines, v)
    assert [tuple(r) for r in out.collect()] == [("C", "1", "Sales A")]
    assert optimized(out).count("Join ") == 1
