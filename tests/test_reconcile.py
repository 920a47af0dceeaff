from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from daybook.operators import dashboard as db
from daybook.operators import reconcile as rc
from daybook.operators import register as rg
from daybook.sources import normalize


def test_balanced_trial_balance(spark):
    rows = [("Cash", "1,000 Dr", 500, 200, "1300"), ("Capital", "-1000", 0, 0, "1000 Cr"), ("Sales", "0", 0, 500, "-500"), ("Rent", "0", 200, 0, "200")]
    raw = spark.createDataFrame([(n, o, str(d), str(k), x) for n, o, d, k, x in rows], "NAME string, OPENINGBALANCE string, DEBITTOTAL string, CREDITTOTAL string, CLOSINGBALANCE string")
    r = rc.reconcile_trial_balance(normalize.normalize_trial_balance(raw, "CO1")).first()
    assert (r["status"], r["debit"], r["credit"], r["opening_variance"], r["closing_variance"]) == ("PASS", 700.0, 700.0, 0.0, 0.0)


def test_ageing_buckets(spark):
    bills = spark.createDataFrame([("b1", date(2024, 5, 20), Decimal(5000)), ("b2", date(2024, 4, 20), Decimal(3000)), ("b3", date(2024, 1, 1), Decimal(2000)), ("b4", date(2025, 1, 1), Decimal(0))],
                                  "name string, bill_date date, closing_amount decimal(18,2)")
    r = rc.reconcile_ageing(rc.age_bills(bills, date(2024, 6, 1))).first()
    assert (r["b_0_30"], r["b_31_60"], r["b_61_90"], r["b_90_plus"], r["status"]) == (5000.0, 3000.0, 0.0, 2000.0, "PASS")
    control = spark.createDataFrame([(Decimal("9999.00"),)], "x decimal(18,2)")
    assert rc.reconcile_ageing(rc.age_bills(bills, date(2024, 6, 1)), control).first()["status"] == "FAIL"


def test_stock_tolerance(spark):
    d = "decimal(18,4)"
    rows = [("a", 10, 5, 3, 12), ("b", 10, 5, 3, "12.0005"), ("c", 10, 5, 3, "12.002")]
    df = spark.createDataFrame([(n, *[Decimal(str(x)) for x in v]) for n, *v in rows], f"name string, opening_qty {d}, inward_qty {d}, outward_qty {d}, closing_qty {d}")
    assert [r["status"] for r in rc.reconcile_stock(df).orderBy("name").collect()] == ["PASS", "PASS", "FAIL"]


def test_checksum_ignores_order_and_run_ids(spark):
    df = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("name"))
    assert rc.compare_runs(df, df.orderBy(F.desc("id")).withColumn("run_id", F.lit("x"))).first()["status"] == "PASS"
    assert rc.compare_runs(df, df.withColumn("name", F.when(F.col("id") == 3, "other").otherwise(F.col("name")))).first()["status"] == "FAIL"


def test_browse_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id int, name string")
    rows, meta = rg.browse(df, sort="name", page=1, page_size=2)
    assert [r["id"] for r in rows.collect()] == [3, 1]
    assert meta.first()["pages"] == 2
    down, _ = rg.browse(df, sort="name", descending=True)
    assert [r["id"] for r in down.collect()] == [1, 3, 2]


def test_dashboard_window_falls_back_to_the_register_span(spark):
    v = spark.createDataFrame([(date(2024, 1, 5), False), (date(2024, 3, 1), False)], "voucher_date date, is_cancelled boolean")
    w = db.resolve_window(v, date(2030, 1, 1), date(2030, 12, 31))
    assert w.adjusted and (w.start, w.end) == (date(2024, 1, 5), date(2024, 3, 1))
    assert (w.previous_end - w.previous_start) == (w.end - w.start)
