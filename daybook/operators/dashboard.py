"""Executive dashboard over vouchers: a window against the equally long one before it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import MONEY_FLOWS, resolve_flow
from ..functions.numeric import change_pct
from .ranking import rank_with_other
from .register import NO_PARTY, NO_STATE, with_places

c = F.col


@dataclass(frozen=True)
class Window:
    start: date
    end: date
    previous_start: date
    previous_end: date
    span_start: date | None
    span_end: date | None
    adjusted: bool


def resolve_window(vouchers: DataFrame, start: date, end: date) -> Window:
    """The asked-for window, or the register's whole span when it holds no voucher (one aggregate row is read)."""
    row = vouchers.filter(c("voucher_date").isNotNull()).agg(
        F.min("voucher_date").alias("lo"), F.max("voucher_date").alias("hi"), F.count_if(c("voucher_date").between(F.lit(start), F.lit(end))).alias("n")).first()
    adjusted = not row["n"] and row["lo"] is not None
    if adjusted:
        start, end = row["lo"], row["hi"]
    days = max((end - start).days + 1, 1)
    prev_end = start - timedelta(days=1)
    return Window(start, end, prev_end - timedelta(days=days - 1), prev_end, row["lo"], row["hi"], adjusted)


def flows_in(vouchers: DataFrame, types: DataFrame, w: Window) -> DataFrame:
    """Live vouchers of both windows with their flow and ``is_current``."""
    both = vouchers.filter(c("voucher_date").between(F.lit(w.previous_start), F.lit(w.end)) & ~c("is_cancelled"))
    return resolve_flow(both, types).withColumn("is_current", c("voucher_date") >= F.lit(w.start))


def dashboard_kpis(flows: DataFrame) -> DataFrame:
    """kpi, amount, count, previous_amount, previous_count, change_pct: one pass over both windows."""
    now, before = c("is_current"), ~c("is_current")

    def total(flow: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when((c("flow") == flow) & when, c("amount"))), F.lit(0)).cast("double")

    names = {"sales": "SALES", "purchases": "PURCHASE", "receipts": "RECEIPT", "payments": "PAYMENT", "sales_returns": "SALES_RETURN",
             "purchase_returns": "PURCHASE_RETURN"}
    aggs = []
    for name, flow in names.items():
        for tag, when in (("n", now), ("p", before)):
            aggs += [total(flow, when).alias(f"{name}_{tag}"), F.count_if((c("flow") == flow) & when).alias(f"{name}_{tag}c")]
    for tag, when in (("n", now), ("p", before)):
        aggs.append(F.countDistinct(F.when((c("flow") == "SALES") & when, c("party"))).alias(f"billed_{tag}"))
    w = flows.agg(*aggs)
    row = lambda name, a, n, pa, pn: F.struct(F.lit(name).alias("kpi"), a.cast("double").alias("amount"), n.cast("bigint").alias("count"),
                                              pa.cast("double").alias("previous_amount"), pn.cast("bigint").alias("previous_count"))
    zero = F.lit(0)
    rows = [row(n, c(f"{n}_n"), c(f"{n}_nc"), c(f"{n}_p"), c(f"{n}_pc")) for n in names]
    net = lambda t: F.round(c(f"receipts_{t}") - c(f"payments_{t}"), 2)
    avg = lambda t: F.coalesce(F.round(c(f"sales_{t}") / F.when(c(f"sales_{t}c") > 0, c(f"sales_{t}c")), 2), F.lit(0.0))
    rows += [row("net_cash", net("n"), zero, net("p"), zero), row("avg_invoice", avg("n"), c("sales_nc"), avg("p"), c("sales_pc")),
             row("customers_billed", c("billed_n"), c("billed_n"), c("billed_p"), c("billed_p"))]
    return w.select(F.inline(F.array(*rows))).withColumn("change_pct", change_pct(c("amount"), c("previous_amount")))


def monthly_flows(current: DataFrame) -> DataFrame:
    """month and the four money flows, for months that have any."""
    money = current.filter(c("flow").isin(*MONEY_FLOWS)).groupBy(F.trunc("voucher_date", "MM").alias("m"))
    return money.agg(*[F.coalesce(F.sum(F.when(c("flow") == f, c("amount"))), F.lit(0)).cast("double").alias(n)
                       for f, n in zip(MONEY_FLOWS, ("sales", "purchases", "receipts", "payments"), strict=True)],
                     F.count_if(c("flow") == "SALES").alias("sales_count"))


def dashboard_monthly(flows: DataFrame, w: Window) -> DataFrame:
    """Every month of the window (within the register's span), zero where nothing was posted."""
    spark = flows.sparkSession
    lo, hi = max(w.start, w.span_start or w.start), min(w.end, w.span_end or w.end)
    axis = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(lo), "MM"), F.trunc(F.lit(hi), "MM"), F.expr("interval 1 month"))).alias("m"))
    found = monthly_flows(flows.filter(c("is_current")))
    zero = F.lit(0.0)
    return axis.join(found, "m", "left").select(
        F.date_format("m", "yyyy-MM").alias("month"), *[F.coalesce(n, zero).alias(n) for n in ("sales", "purchases", "receipts", "payments")],
        F.coalesce("sales_count", F.lit(0)).cast("bigint").alias("sales_count"))


def dashboard_top(flows: DataFrame, profile: DataFrame, stock_lines: DataFrame, kind: str, n: int = 7) -> DataFrame:
    """Top customers, items or states of the window's sales, with one row for the rest."""
    sales = flows.filter(c("is_current") & (c("flow") == "SALES"))
    if kind == "customers":
        totals = sales.groupBy(F.coalesce("party", F.lit(NO_PARTY)).alias("name")).agg(F.sum("amount").cast("double").alias("amount"))
    elif kind == "states":
        totals = with_places(sales, profile).groupBy(F.coalesce("state", F.lit(NO_STATE)).alias("name")).agg(F.sum("amount").cast("double").alias("amount"))
    else:
        lines = stock_lines.select("company_id", "voucher_id", "item", c("amount").alias("line_amount")).join(
            sales.select("company_id", "voucher_id"), ["company_id", "voucher_id"], "left_semi")
        totals = lines.filter(c("item").isNotNull()).groupBy(c("item").alias("name")).agg(F.sum("line_amount").cast("double").alias("amount"))
    out = rank_with_other(totals, "name", "amount", n)
    return out.withColumn("amount", F.round("amount", 2))


def voucher_mix(flows: DataFrame) -> DataFrame:
    return flows.filter(c("is_current")).groupBy("flow").agg(F.count(F.lit(1)).alias("count"), F.sum("amount").cast("double").alias("amount"))


def recent_vouchers(flows: DataFrame, n: int = 20) -> DataFrame:
    """Latest first: date, then voucher number (as text), descending."""
    return flows.filter(c("is_current")).orderBy(F.desc("voucher_date"), F.desc("voucher_number")).limit(n).select(
        F.date_format("voucher_date", "yyyy-MM-dd").alias("date"), "voucher_number", "voucher_type", "flow", "party", c("amount").cast("double").alias("amount"))
