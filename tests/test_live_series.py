"""Series of live months against the same statistics of plain arrays, and books whose axis is long."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from daybook.functions import live_series as L
from daybook.functions import series as D
from daybook.operators.crosschecks import verify_cube
from daybook.operators.cube import CITY, build_cube, dense_long, mom_series
from daybook.operators.trend import decline_streak

from . import golden

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(9)
    out = {n: [] for n in (1, 2, 3, 7, 24, 130)}
    for n, rows in out.items():
        for _ in range(40):
            share = rng.choice([0.0, 0.1, 0.5, 0.9, 1.0])
            rows.append([float(rng.randint(-3, 6)) if rng.random() < share else 0.0 for _ in range(n)])
    return {n: spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, d array<double>").select(
        "k", "d", L.series(F.transform("d", lambda v, t: F.struct(t.alias("idx"), v.alias("v"))), n).alias("s")).persist() for n, rows in out.items()}


def test_statistics_equal_those_of_arrays(frames):
    s, d = L.s(), F.col("d")
    for n, df in frames.items():
        mean = L.total(s) / n
        steps = F.filter(D.steps(d), lambda x: x != 0)
        pairs = {
            "values": (L.values(s), d), "total": (L.total(s), D.total(d)), "last": (L.last(s), D.last(d)), "back": (L.last(s, 2), D.last(d, 2)), "at": (L.at(s, 1), D.at(d, 1)),
            "off": (L.at(s, n), D.at(d, n)), "sd": (F.round(L.stddev(s, mean), 6), F.round(D.stddev(d, mean), 6)), "slope": (L.slope(s, n), D.slope(d, n)),
            "fall": (L.decline_streak(s)["best"], D.decline_streak(d)["best"]), "open": (L.decline_streak(s)["run"], D.decline_streak(d)["run"]),
            "rise": (L.growth_streak(s)["best"], D.growth_streak(d)["best"]), "rising": (L.growth_streak(s)["run"], D.growth_streak(d)["run"]),
            "runs": (L.decline_run_by_index(s), D.decline_run_by_index(d)), "mean3": (L.window_mean(s, 3), D.window_mean(d, 3)), "prior": (L.window_mean(s, 3, 3), D.window_mean(d, 3, 3)),
            "peak": (L.peak(s), D.peak(d)), "trough": (L.trough(s), D.trough(d)), "peak_at": (L.first_index_of(s, L.peak(s)), D.first_index_of(d, D.peak(d))),
            "trough_at": (L.first_index_of(s, L.trough(s)), D.first_index_of(d, D.trough(d))), "hhi": (L.hhi(s), D.hhi(d)),
            "ranks": (F.transform(L.ranked_months(s), lambda r: r["rank"]), D.competition_ranks(d)), "ranked": (F.transform(L.ranked_months(s), lambda r: r["value"]), d),
            "moves": (F.transform(L.moves(s), lambda m: m["d"]), steps), "half": (L.part(s, 0, n // 2), D.total(F.slice(d, 1, n // 2))),
            "quarters": (L.sums_of(s, 3), F.transform(F.sequence(F.lit(0), F.lit((n + 2) // 3 - 1)), lambda i: D.total(F.slice(d, i * 3 + 1, F.lit(3))))),
            "long": (F.transform(L.long(s), lambda r: r["prev"]), F.transform(d, lambda x, i: F.get("d", i - 1)))}
        bad = df.select("d", *[F.struct(a.alias("got"), b.alias("want"), a.eqNullSafe(b).alias("ok")).alias(k) for k, (a, b) in pairs.items()])
        for row in bad.collect():
            for k in pairs:
                assert row[k]["ok"], (n, k, row["d"], row[k]["got"], row[k]["want"])


def old_book(spark):
    row = ("OLD", date(1900, 1, 5), "Pune", None, "Vase", "Vase", "C-Pune", Decimal(100), Decimal(100), False)
    return golden.facts(spark).unionByName(spark.createDataFrame([row], golden.SCHEMA))


def test_one_row_dated_1900_keeps_every_later_row(spark):
    new, old = build_cube(golden.facts(spark)), build_cube(old_book(spark))
    assert old.n == 125 * 12 + 5 and old.total == new.total + 100
    assert max(len(r["s"]["v"]) for r in old.members(CITY).collect()) == golden.MONTHS + 1
    assert {r["status"] for r in verify_cube(old).collect()} == {"PASS"}
    streaks = lambda cube: {r["member"]: r["streak"] for r in decline_streak(cube, CITY).table.collect()}
    assert streaks(old) == streaks(new)
    assert dense_long(old, CITY).count() == mom_series(old, CITY).count() == old.n * 4
    months = old.months().orderBy("idx").collect()
    assert [m["revenue"] for m in months[:2]] == [100.0, 0.0] and months[-1]["period"] == "2025-05" and months[0]["prev"] is None


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_queries_over_a_long_axis_match_sql(spark, tmp_path):
    import __spark_entry__ as entry
    from checks.compare import TABLES, compare

    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            first = df.agg(F.min("o_orderkey")).scalar()
            df = df.withColumn("o_orderdate", F.when(F.col("o_orderkey") == first, F.lit("1900-01-15")).otherwise(F.col("o_orderdate").cast("string")).cast(df.schema["o_orderdate"].dataType))
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("C01_total_by_city", "C03_period_axis", "T01_decline_streak_city", "T08_trend_slope_city", "V01_peak_trough_register_group", "T06_volatility_cv_city"):
        ok, message, rows = compare(queries[name](spark, str(tmp_path)), con, sql[name])
        assert ok and rows > 0, (name, message)
