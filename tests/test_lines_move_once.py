"""Lines are shuffled once, as numbers and by voucher; what a step shuffled is released when its result is written down."""

from __future__ import annotations

import time
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.books import Books
from daybook.operators import fact as ft
from daybook.operators import reconcile as rc
from daybook.operators import register as rg
from daybook.session import RELEASE, written_down
from daybook.streaming.mirror import Mirror, latest_per_key

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0)]),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "Cust 1", 0, 10.0, "FURNITURE")]),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(1, "Sup 1", 0, 1.0)]),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "bolt", "Brand#1", "LARGE", 1, 1.0), (2, None, "Brand#1", None, 1, 1.0)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
               [(1, 1, "O", 9000.0, datetime(1998, 1, 1), "1-URGENT"), (2, 1, "F", 8000.0, datetime(1998, 1, 2), "2-HIGH")]),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
                 [(1, 1, 1, 1, 2.0, 100.0, 0.05, 0.1), (1, 9, 9, 2, 2.0, 50.0, 0.0, 0.1), (1, 2, 1, 3, 1.0, 10.0, 0.0, 0.1), (None, 1, 1, 1, 1.0, 5.0, 0.0, 0.0)]),
}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return Books(spark, root)


def physical(spark, df) -> list[str]:
    """The plan as a large book would get it: nothing is small enough to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        return df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def above(plan: list[str], what: str) -> list[list[str]]:
    """For each node that names ``what``: the nodes it feeds."""
    stack, found = [], []
    for line in plan:
        node = line.lstrip(" :+-*")
        depth = len(line) - len(line.lstrip(" :+-"))
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if what in node:
            found.append([n for _, n in stack])
        stack.append((depth, node))
    return found


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_ledger_lines_are_not_shuffled_after_they_are_made(spark, book):
    roled = ft.arrived_roles(book.ledger_lines, ft.live_vouchers(book.vouchers))
    made = above(physical(spark, ft.voucher_charges(roled, ft.first_base_ledger())), "inline(")
    assert made and not [n for nodes in made for n in nodes if "Exchange" in n]


def test_stock_lines_meet_their_voucher_without_another_shuffle(spark, book):
    entries = ft.first_arrivals(book.stock_by_voucher, [*ft.KEY, "entry_id"])
    plan = physical(spark, ft.with_line_totals(entries))
    assert [len([n for n in nodes if n.startswith("Exchange")]) for nodes in above(plan, "lineitem.parquet")] == [3]  # by part, supplier and voucher; the totals read the same shuffle


def test_books_keep_their_rows(book):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(book.stock_lines) == rows(book.stock_by_voucher)
    got = {(r.voucher_id, r.line, r.item, r.unit, r.rate, r.cost_centre, r.company_id) for r in book.stock_lines.collect()}
    assert got == {("V1", 1, "bolt #1", "BOX", "10/BOX", "Sup 1", "CO1"), ("V1", 2, None, None, None, None, "CO1"), ("V1", 3, "2", "KG", "10/KG", None, "CO1"),
                   (None, 1, "bolt #1", "BOX", "10/BOX", None, "CO1")}
    lines = {(r.voucher_id, r.line, r.ledger, r.amount) for r in book.ledger_lines.filter("line > 10").collect()}
    assert ("V1", 12, None, Decimal("50.00")) in lines and ("V1", 11, "Sales Account LARGE", Decimal("100.00")) in lines and {x[0] for x in lines} == {"V1"}


def test_register_lines_read_the_ledger_lines_once(book):
    reg = rg.build_register(book.vouchers, book.stock_by_voucher, book.ledger_lines, book.types, ft.party_profile(book.ledgers))
    assert 0 < optimized(reg.lines).count("RLIKE(_name") <= 9
    got = {(r.voucher_id, r["product"], r.unit, r.amount, r.is_accounting_invoice) for r in reg.lines.collect()}
    assert got == {("V1", "bolt #1", "BOX", Decimal("100.00"), False), ("V1", None, None, Decimal("50.00"), False), ("V1", "2", "KG", Decimal("10.00"), False),
                   ("V2", "(Service / Accounting Invoice)", "Service", Decimal("-7975.00"), True)}


def test_steps_are_written_down(book):
    reg = rg.build_register(book.vouchers, book.stock_by_voucher, book.ledger_lines, book.types, ft.party_profile(book.ledgers))
    party = rg.register_by_party(reg)
    assert "RLIKE(_name" not in optimized(party) and [r["party"] for r in party.collect()] == ["Cust 1"]
    matched = rc.reconcile_vouchers(book.vouchers, book.stock_lines, ft.with_roles(book.ledger_lines, book.vouchers))
    totals = book.vouchers.groupBy(F.lit("SALES").alias("direction")).agg(F.sum("amount").cast("double").alias("ledger_total"))
    report = rc.reconciliation_report(reg, reg, matched, totals)
    assert "RLIKE(_name" not in optimized(report)
    assert [(r["direction"], r["invoiced"], r["ledger_total"], r["vouchers"]) for r in report.collect()] == [("SALES", 1000.0, 17000.0, 2), ("PURCHASE", 1000.0, 0.0, 2)]


def test_kept_facts_are_the_same(book):
    build = lambda **how: ft.build_facts(book.vouchers, book.stock_by_voucher, book.ledger_lines, book.ledgers, book.items, book.groups, book.cost_centres, book.classes, book.types, **how)
    rows = lambda df: sorted(map(str, df.collect()))
    kept = build(keep=written_down)
    assert "RLIKE(_name" not in optimized(kept.facts)
    assert rows(kept.facts) == rows(build().facts) and len(rows(kept.facts)) == 4


def test_written_down_releases_its_shuffles(spark):
    spark.conf.unset(RELEASE)
    before = shuffled(spark)
    kept = written_down(spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count(), "test")
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert kept.count() == 7 and spark.conf.get(RELEASE) == "false"


def test_one_delta_is_its_own_state(spark, tmp_path):
    schema = "company_id string, source_object_id string, voucher_date date, amount int, alter_id bigint"
    batch = spark.createDataFrame([("C", "1", date(2024, 1, 1), 5, 1), ("C", "1", date(2024, 1, 1), 7, 2), (None, "2", None, None, None), ("C", "", None, 1, 1)], schema)
    assert optimized(latest_per_key(batch)).count("max_by(") == 0
    m = Mirror(spark, str(tmp_path), "vouchers")
    assert m.apply(batch, 1, "r").first()[:5] == (2, 2, 0, 0, 1)
    assert "Aggregate" not in optimized(m.state())
    assert sorted((r.source_object_id, r.amount) for r in m.state().collect()) == [("1", 7), ("2", None)]
    # A company that is NULL never meets its state, so its row is new again.
    assert m.apply(batch, 2, "r").first()[:5] == (2, 1, 0, 1, 1)
    assert not [x for x in spark.sparkContext._jsc.getPersistentRDDs()]
