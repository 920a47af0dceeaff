import random

import pytest

from daybook.operators.fact import dedupe_rows
from daybook.operators.ranking import rank_with_other, ranked


def brute(rows, competition):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    ranks, seen = {}, {}
    for i, (name, value) in enumerate(order, 1):
        ranks[name] = seen.setdefault(value, i) if competition else i
    return ranks


@pytest.mark.parametrize("competition", [False, True])
def test_bucketed_rank_matches_a_plain_sort(spark, competition):
    rng = random.Random(7)
    pool = [0.0, 0.01, -0.01, 1e12, -1e12, 5.5, 5.5, 1024.0, 1023.99, 1024.01]
    rows = [(f"m{i:03}", rng.choice(pool) if rng.random() < 0.5 else round(rng.uniform(-1e6, 1e6), 2)) for i in range(300)]
    got = ranked(spark.createDataFrame(rows, "name string, v double"), "v", ("name",), competition=competition).collect()
    assert {r["name"]: r["rank"] for r in got} == brute(rows, competition)


def test_running_sum_and_groups(spark):
    rows = [("a", f"n{i}", float(i % 5)) for i in range(40)] + [("b", "x", 3.0)]
    got = ranked(spark.createDataFrame(rows, "k string, name string, v double"), "v", ("name",), ("k",), running="v").filter("k = 'a'").orderBy("rank").collect()
    total = 0.0
    for r in got:
        total += r["v"]
        assert r["v_running"] == pytest.approx(total)


def test_other_row_keeps_the_total(spark):
    rows = [(f"n{i:02}", float(i)) for i in range(20)]
    got = rank_with_other(spark.createDataFrame(rows, "name string, v double"), "name", "v", 3).collect()
    assert sum(r["v"] for r in got) == sum(v for _, v in rows)
    assert {r["name"]: r["members"] for r in got}["Other"] == 17


def test_dedupe_with_one_key_holding_a_third_of_all_rows(spark):
    rows = [("hot", i % 7, float(i % 3)) for i in range(600)] + [(f"k{i}", i, 1.0) for i in range(1200)]
    kept, rejected = dedupe_rows(spark.createDataFrame(rows, "k string, a int, v double"), ["k"], ["a", "v"])
    assert kept.count() == 1201
    assert kept.filter("k = 'hot'").collect()[0][:] == ("hot", 0, 0.0)
    assert rejected.selectExpr("sum(copies)").first()[0] == 599
