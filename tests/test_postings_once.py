"""Charges, first base ledger, cost centre and whether a voucher is posted come from one reading of its ledger lines."""

from __future__ import annotations

from decimal import Decimal

import pytest

from daybook.operators import fact as ft
from daybook.operators import register as rg

VOUCHER = "company_id string, voucher_id string, voucher_number string, voucher_type string, voucher_date date, party string, amount decimal(18,2), is_cancelled boolean, is_optional boolean"
STOCK = "company_id string, voucher_id string, entry_id string, line bigint, item string, quantity decimal(18,3), unit string, rate string, amount decimal(18,2), cost_centre string"
LEDGER = "company_id string, voucher_id string, line bigint, ledger string, amount decimal(18,2), is_credit boolean, cost_centre string"
ARRIVAL = ", arrival int"


def d(x) -> Decimal:
    return Decimal(x)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def voucher(key, amount, party="P"):
    return ("C", key, key, "Sales", None, party, d(amount), False, False)


def ledger(key, line, name, amount, centre=None):
    return ("C", key, line, name, d(amount), True, centre)


@pytest.fixture(scope="module")
def masters(spark):
    frame = lambda schema: spark.createDataFrame([], schema)
    named = "company_id string, source_object_id string, name string"
    return (frame(named + ", parent string, country string, state string, address_lines array<string>"), frame(named + ", parent string"), frame(named), frame(named),
            frame("company_id string, ledger_id string, tier string, customer_type string, source string, updated_at string"), frame("name string, parent string"))


def built(spark, masters, arrival: bool):
    """One voucher with a stock line, a service, an empty one, and a service that came twice with equal lines."""
    more = (lambda rows, n: [(*r, n) for r in rows]) if arrival else (lambda rows, n: rows)
    tail = ARRIVAL if arrival else ""
    first = [voucher("1", 110), voucher("2", 50), voucher("3", 0), voucher("4", 30), voucher("6", 0)]
    lines = [ledger("1", 2, "Output CGST", 10), ledger("1", 1, "Sales A", 100, "K"), ledger("2", 2, "Fees B", 20), ledger("2", 1, "Fees A", 30), ledger("2", 3, "P", 50, "M"),
             ledger("4", 1, "Fees C", 30), ledger("5", 1, "no voucher", 1)]
    again = [ledger("4", 1, "Fees C", 30), ledger("6", 1, "Fees D", 9, "N")] if arrival else [ledger("4", 1, "Fees C", 30)]
    vouchers = spark.createDataFrame(more(first, 1) + more([voucher("4", 30)] + ([voucher("6", 0)] if arrival else []), 2), VOUCHER + tail)
    stock = spark.createDataFrame(more([("C", "1", "1a", 1, "i", d(2), "PCS", "50", d(100), None)], 1), STOCK + tail)
    return ft.build_facts(vouchers, stock, spark.createDataFrame(more(lines, 1) + more(again, 2), LEDGER + tail), *masters), vouchers


@pytest.mark.parametrize("arrival", [False, True])
def test_facts_of_one_reading(spark, masters, arrival):
    build, vouchers = built(spark, masters, arrival)
    got = {(r.voucher_id, r.entry_id, r.item, r.salesman, r.amount, r.amount_with_charges, r.is_accounting_invoice) for r in build.facts.collect()}
    # Voucher 6 counts as posted by its second arrival, whose lines give it neither a value, a name nor a centre.
    late = {("6", "6#ACCT1", "(Service / Accounting Invoice)", None, d(0), d(0), True)} if arrival else set()
    assert got == {("1", "1a", "i", "K", d(100), d(110), False), ("2", "2#ACCT1", "Fees A", "M", d(50), d(50), True), ("4", "4#ACCT1", "Fees C", None, d(30), d(30), True)} | late
    stats = ft.fact_stats(build.facts, vouchers, build.rejected).collect()[0].asDict()
    assert stats == {"rows": 4, "net": 180.0, "with_charges": 190.0, "vouchers": 4, "gross_vouchers": 190.0, "rejected": 3} if arrival else {
        "rows": 3, "net": 180.0, "with_charges": 190.0, "vouchers": 3, "gross_vouchers": 190.0, "rejected": 2}


def test_lines_are_read_once(spark, masters):
    build, _ = built(spark, masters, True)
    assert 0 < optimized(build.facts).count("RLIKE(_name") <= 9  # one chain of role rules


def test_empty_facts(spark, masters):
    build, vouchers = built(spark, masters, False)
    assert ft.fact_stats(build.facts.limit(0), vouchers, build.rejected.limit(0)).collect()[0].asDict() == {
        "rows": 0, "net": None, "with_charges": None, "vouchers": 0, "gross_vouchers": None, "rejected": 0}


def test_register_products_without_amounts(spark, masters):
    vouchers = spark.createDataFrame([voucher("1", 110), voucher("2", 50), voucher("3", 5)], VOUCHER)
    stock = spark.createDataFrame([("C", "1", "1a", 1, "i", d(2), "PCS", "50", d(100), None), ("C", "9", "9a", 1, "other", d(2), "PCS", "50", d(100), None)], STOCK)
    lines = spark.createDataFrame([ledger("1", 1, "Sales A", 100), ledger("2", 2, "Fees B", 20), ledger("2", 1, "Fees A", 30)], LEDGER)
    reg = rg.build_register(vouchers, stock, lines, masters[5], ft.party_profile(masters[0]))
    assert sorted(r["product"] for r in reg.lines.collect()) == sorted(r["product"] for r in reg.products.collect()) == ["(Service / Accounting Invoice)", "Fees A", "i"]
    assert rg.register_totals(reg).collect()[0]["items"] == 2
    # Item lines and service vouchers work the roles out once each, base ledger included.
    assert 0 < optimized(reg.lines).count("RLIKE(_name") <= 18
