import statistics
from datetime import date

import pytest

from checks.cube_queries import ALL_VERDICTS
from checks.sql_base import prelude
from daybook.operators.crosschecks import verify_cube
from daybook.operators.cube import CITY, GROUP, build_cube, member_statistics
from daybook.plans.catalog import CATALOG
from daybook.plans.leaderboards import manager_top10, owner_top5
from daybook.plans.runner import run_all, run_lens
from daybook.plans.verdict import contract_violations

from . import golden


@pytest.fixture(scope="module")
def cube(spark):
    return build_cube(golden.facts(spark), golden.months()[0].replace(day=1), date(2025, 5, 31))


@pytest.fixture(scope="module")
def verdicts(cube):
    return {r["analysis_id"]: r for r in run_all(cube).collect()}


@pytest.fixture(scope="module")
def wanted():
    cur = golden.star().execute(prelude() + ALL_VERDICTS)
    names = [d[0] for d in cur.description]
    return {r["analysis_id"]: r for r in (dict(zip(names, x)) for x in cur.fetchall())}


def test_cube_totals(cube):
    book = golden.rows()
    assert cube.n == golden.MONTHS and cube.total == sum(r[7] for r in book)
    totals = {r["member"]: r["total"] for r in cube.members(CITY).collect()}
    assert totals == {x: sum(golden.series(2, x)) for x in golden.CITIES}
    assert cube.combos().count() == len({(r[2], r[4]) for r in book})


@pytest.mark.parametrize("axis, place, names", [(CITY, 2, golden.CITIES), (GROUP, 4, golden.PRODUCTS)])
def test_statistics(cube, axis, place, names):
    stats = {r["member"]: r for r in member_statistics(cube, axis).collect()}
    for name in names:
        s = golden.series(place, name)
        assert stats[name]["sd"] == pytest.approx(statistics.stdev(s), abs=0.01)
        assert stats[name]["slope"] == pytest.approx(statistics.linear_regression(range(len(s)), s).slope, abs=0.01)


def test_catalogue_is_complete(verdicts, wanted):
    assert len(CATALOG) == 161 and set(verdicts) == set(wanted) == {e.id for e in CATALOG}


@pytest.mark.parametrize("analysis_id", [e.id for e in CATALOG])
def test_verdict(verdicts, wanted, analysis_id):
    got, want = verdicts[analysis_id], wanted[analysis_id]
    for name in ("status", "severity", "priority", "fired", "assessed"):
        assert got[name] == want[name], name
    for name in ("headline", "coi"):
        assert got[name] == (None if want[name] is None else pytest.approx(want[name], rel=1e-6, abs=1e-5)), name


def test_the_book_reaches_every_status(wanted):
    assert {r["status"] for r in wanted.values()} >= {"RED", "AMBER", "GREEN"}


def test_cross_checks(cube):
    assert {r["status"] for r in verify_cube(cube).collect()} == {"PASS"}


def test_contract_and_boards(cube):
    rows = run_lens(cube, 1).unionByName(run_lens(cube, 2)).persist()
    assert contract_violations(rows).count() == 0
    top = owner_top5(rows).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    assert all(a["score"] >= b["score"] for a, b in zip(top, top[1:]))
    assert manager_top10(rows).count() == 10


def test_product_hhi_is_a_mean_of_cells(cube):
    from daybook.operators.concentration import hhi_register

    table = {r["member"]: r["hhi"] for r in hhi_register(cube, GROUP).table.collect()}
    for name, got in table.items():
        cells = [[r[7] for r in golden.rows() if r[2] == city and r[4] == name] for city in golden.CITIES]
        each = [sum(v * v for v in x) / sum(x) ** 2 for x in cells if x]
        assert got == pytest.approx(sum(each) / len(each), abs=1e-6)
