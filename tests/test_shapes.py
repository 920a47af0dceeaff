"""Metamorphic and hostile-shape tests of the cube and the catalogue."""

from datetime import date
from decimal import Decimal

import pytest

from daybook.functions import live_series
from daybook.operators.cube import CITY, build_cube, cube_meta, resolve_period
from daybook.operators.crosschecks import verify_cube
from daybook.plans.runner import run_all, run_lens
from daybook.plans.verdict import contract_violations

from . import golden

ABSOLUTE = {"L06.A10", "L15.A06", "L15.A10", "L16.A02", "L16.A06", "L16.A08", "L12.A03"}


def book(spark, cities, groups, months, scale=1):
    rows = []
    for i in range(cities):
        for j in range(groups):
            for m in range(months):
                if i == 0 and j == groups - 1 and groups > 1 and m >= months // 2:
                    continue
                value = (100 + 17 * i + 31 * j + (5 * m if i else -3 * m)) * scale
                rows.append((f"V{i}-{j}-{m}", date(2023 + m // 12, m % 12 + 1, 10), f"C{i}", None, f"G{j}", f"I{j}", "P", Decimal(value), Decimal(value), False))
    return spark.createDataFrame(rows, golden.SCHEMA)


def statuses(cube, lenses):
    return {r["analysis_id"]: r["status"] for lens in lenses for r in run_lens(cube, lens).collect()}


def test_scale_does_not_change_verdicts(spark):
    lenses = (6, 9)
    small, large = (statuses(build_cube(golden.facts(spark, s)), lenses) for s in (1, 1000))
    for key in ABSOLUTE:
        small.pop(key, None), large.pop(key, None)
    assert small == large


def test_partitioning_and_order_do_not_matter(spark):
    facts = golden.facts(spark)
    a = statuses(build_cube(facts.repartition(1)), (10,))
    b = statuses(build_cube(facts.repartition(17, "voucher_id").orderBy("amount")), (10,))
    assert a == b


def test_every_analysis_keeps_the_contract_on_a_single_cell(spark):
    cube = build_cube(book(spark, 1, 1, 1))
    rows = run_all(cube).persist()
    assert rows.count() == 161
    assert contract_violations(rows).count() == 0
    assert {r["status"] for r in verify_cube(cube).collect()} == {"PASS"}


def test_small_book_keeps_the_contract(spark):
    cube = build_cube(book(spark, 3, 4, 8))
    rows = run_lens(cube, 8).unionByName(run_lens(cube, 12)).persist()
    assert contract_violations(rows).count() == 0
    assert {r["status"] for r in verify_cube(cube).collect()} == {"PASS"}


def test_empty_book_is_idle(spark):
    cube = build_cube(golden.facts(spark).limit(0))
    assert cube.n == 0
    assert {r["status"] for r in run_lens(cube, 1).collect()} == {"IDLE"}


def test_returns_are_netted_by_class_not_by_posting_side(spark):
    rows = [("A", date(2025, 1, 1), "X", None, "G", "I", "P", Decimal(100), Decimal(100), False), ("B", date(2025, 1, 2), "X", None, "G", "I", "P", Decimal(30), Decimal(30), True)]
    facts = spark.createDataFrame(rows, golden.SCHEMA)
    assert build_cube(facts).total == 70
    assert build_cube(facts, net_returns=False).total == 130
    meta = cube_meta(build_cube(facts)).first()
    assert (meta["return_rows"], meta["return_amount"], meta["rows_counted"]) == (1, 30.0, 2)


def test_window_is_widened_and_filled(spark):
    cube = build_cube(golden.facts(spark), date(2024, 2, 1), date(2025, 7, 31))
    assert cube.n == 18 and cube.label_at(0) == "Feb-24" and cube.label_at(-1) == "Jul-25"
    series = cube.members(CITY).filter("member = 'Pune'").select(live_series.values(live_series.s()).alias("s")).first()["s"]
    assert series[0] == 0 and series[2] == golden.series(2, "Pune")[0] and series[-1] == 0


def test_undated_rows_take_the_modal_year(spark):
    rows = [(None, "April", None), (None, None, 5), (date(2024, 6, 1), None, None), (date(2024, 7, 1), None, None), (date(2023, 7, 1), None, None), (None, "apr", None), (None, None, None)]
    df = spark.createDataFrame(rows, "voucher_date date, month_name string, month_num int")
    got = [(str(r["month"]) if r["month"] else None, r["period_fallback"]) for r in resolve_period(df).collect()]
    assert got == [("2024-04-01", True), ("2024-05-01", True), ("2024-06-01", False), ("2024-07-01", False), ("2023-07-01", False), ("2024-04-01", True), (None, False)]
    undated = spark.createDataFrame([(None, "June", None)], "voucher_date date, month_name string, month_num int")
    assert str(resolve_period(undated).first()["month"]) == "1900-06-01"
