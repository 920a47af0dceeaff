"""The totals of a register work its vouchers out once, the products of service vouchers included."""

from daybook.operators import fact as ft
from daybook.operators import register as rg

from .test_postings_once import LEDGER, STOCK, VOUCHER, d, ledger, masters, optimized, voucher  # noqa: F401


def test_totals_read_the_ledger_lines_once(spark, masters):  # noqa: F811
    vouchers = spark.createDataFrame([voucher("1", 110), voucher("2", 50, "Q"), voucher("3", 5), voucher("4", 7, None)], VOUCHER)
    stock = spark.createDataFrame([("C", "1", "1a", 1, "i", d(2), "PCS", "50", d(100), None), ("C", "1", "1b", 2, None, d(1), "PCS", "50", d(10), None),
                                   ("C", "9", "9a", 1, "other", d(2), "PCS", "50", d(100), None)], STOCK)
    lines = spark.createDataFrame([ledger("1", 1, "Sales A", 100), ledger("1", 2, "CGST", 9), ledger("2", 2, "Fees B", 20), ledger("2", 1, "i", 30), ledger("4", 1, "Fees A", 7)], LEDGER)
    totals = rg.register_totals(rg.build_register(vouchers, stock, lines, masters[5], ft.party_profile(masters[0])))
    assert 0 < optimized(totals).count("RLIKE(_name") <= 9  # one chain of role rules
    got = totals.collect()[0].asDict()
    # "i" is both an item and a base ledger and counts once; the item without a name does not count.
    assert {k: got[k] for k in ("invoiced", "item_value", "net", "cgst", "invoices", "return_count", "quantity", "parties", "vouchers_without_items", "vouchers", "average_invoice", "items")} == {
        "invoiced": 172.0, "item_value": 110.0, "net": 172.0, "cgst": 9.0, "invoices": 4, "return_count": 0, "quantity": 3.0, "parties": 3, "vouchers_without_items": 3, "vouchers": 4,
        "average_invoice": 43.0, "items": 2}


def test_totals_of_no_voucher(spark, masters):  # noqa: F811
    frame = lambda schema: spark.createDataFrame([], schema)
    got = rg.register_totals(rg.build_register(frame(VOUCHER), frame(STOCK), frame(LEDGER), masters[5], ft.party_profile(masters[0]))).collect()[0].asDict()
    assert set(got.values()) == {0} and got["average_invoice"] == 0.0
