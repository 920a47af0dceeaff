"""Reconciliations and data checks. Both sides of every check come from different inputs."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ledger_class
from ..functions.identity import content_hash
from ..session import written_down
from .fact import KEY
from .register import Register, register_totals, voucher_ledger_breakdown

c = F.col


def sales_control_total(ledgers: DataFrame) -> DataFrame:
    """company_id, expected: sum of the sizes of sales-ledger closing balances (NULL when none has one)."""
    cls = ledger_class(c("parent"), c("name"))
    sales = (cls == "INCOME") | F.coalesce(c("parent"), F.lit("")).rlike(r"(?i)\bsales\b") | c("name").rlike(r"(?i)\bsales\b")
    return ledgers.filter(sales & c("closing_balance").isNotNull()).groupBy("company_id").agg(F.sum(F.abs("closing_balance")).alias("expected"))


def reconcile_fact(facts: DataFrame, ledgers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    actual = facts.groupBy("company_id").agg(F.sum("amount").alias("actual"))
    d = actual.join(sales_control_total(ledgers), "company_id", "left").withColumn("difference", c("actual") - c("expected"))
    status = (F.when(c("expected").isNull(), "CONTROL_TOTAL_UNAVAILABLE").when(c("difference") == 0, "RECONCILED")
              .when(F.abs("difference") <= tolerance, "WITHIN_TOLERANCE").otherwise("MATERIAL_DIFFERENCE"))
    return d.select("company_id", *[c(x).cast("double").alias(x) for x in ("expected", "actual", "difference")], status.alias("status"))


def data_readiness(facts: DataFrame, fields: list[str]) -> DataFrame:
    """field, populated, total, percent for every field of the fact table."""
    filled = lambda x: F.count_if(c(x).isNotNull() & (c(x).cast("string") != ""))
    w = facts.agg(F.count(F.lit(1)).alias("_n"), *[filled(x).alias(x) for x in fields])
    rows = F.array(*[F.struct(F.lit(x).alias("field"), c(x).alias("populated"), c("_n").alias("total")) for x in fields])
    pct = F.when(c("total") == 0, 0.0).otherwise(F.round(c("populated") / F.when(c("total") != 0, c("total")) * 100, 1))
    return w.select(F.inline(rows)).withColumn("percent", pct)


def reconcile_vouchers(vouchers: DataFrame, stock_lines: DataFrame, roled: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Header amount against base + tax + charges - discount + round-off, voucher by voucher."""
    lines = stock_lines.groupBy(*KEY).agg(F.sum("amount").alias("item_total"))
    j = vouchers.select(*KEY, "voucher_number", "amount").join(voucher_ledger_breakdown(roled), KEY, "left").join(lines, KEY, "left")
    zero = F.lit(0)
    items = F.coalesce("item_total", zero)
    base = F.when(items == 0, F.coalesce("base", zero)).otherwise(items)
    calc = base + F.coalesce("total_tax", zero) + F.coalesce("charges", zero) - F.coalesce("discount", zero) + F.coalesce("round_off", zero)
    gap = F.abs(F.coalesce("amount", zero)) - F.abs(calc)
    return j.select(*KEY, "voucher_number", F.abs("amount").cast("double").alias("header"), F.abs(calc).cast("double").alias("calculated"),
                    items.cast("double").alias("item_total"), F.coalesce("total_tax", zero).cast("double").alias("tax_total"), gap.cast("double").alias("difference"),
                    F.when(F.abs(gap) <= tolerance, "MATCHED").otherwise("MISMATCH").alias("status"))


def reconciliation_report(sales: Register, purchase: Register, matched: DataFrame, ledger_totals_by_class: DataFrame) -> DataFrame:
    """Register totals next to the same amounts read from party ledger lines, plus voucher match counts.

    Each part is one or two rows over all vouchers; written down one after the other, the shuffles of one lie on disk at a time.
    """
    counts = written_down(matched.agg(F.count(F.lit(1)).alias("vouchers"), F.count_if(c("status") == "MATCHED").alias("matched")), "matched")
    ledger_totals_by_class = written_down(ledger_totals_by_class, "ledger-totals")

    def side(name: str, reg: Register) -> DataFrame:
        t = written_down(register_totals(reg), "register-totals")
        other = ledger_totals_by_class.filter(c("direction") == name).select("ledger_total").limit(1)
        return t.select(F.lit(name).alias("direction"), "invoiced", "gross", "returns", c("total_tax").alias("tax"), "invoices", "return_count", "quantity",
                        F.coalesce(other.scalar(), F.lit(0.0)).alias("ledger_total"))

    both = side("SALES", sales).unionByName(side("PURCHASE", purchase))
    return both.withColumn("difference", F.round(c("invoiced") - c("ledger_total"), 2)).withColumn(
        "vouchers", counts.select("vouchers").scalar()).withColumn("matched", counts.select("matched").scalar())


def reconcile_trial_balance(tb: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Debits against credits, and opening and closing balances by side."""
    total = lambda v, when=None: F.coalesce(F.sum(v if when is None else F.when(when, v)), F.lit(0)).cast("double")
    w = tb.agg(F.count(F.lit(1)).alias("rows"), total(c("debit")).alias("debit"), total(c("credit")).alias("credit"),
               total(c("opening"), c("opening_is_debit")).alias("opening_debit"), total(c("opening"), ~c("opening_is_debit")).alias("opening_credit"),
               total(c("closing"), c("closing_is_debit")).alias("closing_debit"), total(c("closing"), ~c("closing_is_debit")).alias("closing_credit"))
    gap = lambda a, b: F.round(F.abs(c(a) - c(b)), 2)
    return w.withColumn("variance", gap("debit", "credit")).withColumn("opening_variance", gap("opening_debit", "opening_credit")).withColumn(
        "closing_variance", gap("closing_debit", "closing_credit")).withColumn("status", F.when(c("variance") < tolerance, "PASS").otherwise("FAIL"))


BUCKETS = ("0_30", "31_60", "61_90", "90_PLUS")


def age_bills(bills: DataFrame, as_of: date | Column) -> DataFrame:
    """days_old (never negative) and bucket of every bill."""
    when = as_of if isinstance(as_of, Column) else F.lit(as_of)
    days = F.greatest(F.coalesce(F.datediff(when, c("bill_date")), F.lit(0)), F.lit(0))
    bucket = F.when(days > 90, "90_PLUS").when(days > 60, "61_90").when(days > 30, "31_60").otherwise("0_30")
    return bills.withColumn("days_old", days.cast("bigint")).withColumn("bucket", bucket)


def reconcile_ageing(aged: DataFrame, control: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """Bucket sums against the total, and the total against a control figure from the ledgers."""
    size = F.abs("closing_amount")
    sums = [F.coalesce(F.sum(F.when(c("bucket") == b, size)), F.lit(0)).cast("double").alias(f"b_{b.lower()}") for b in BUCKETS]
    w = aged.agg(F.count(F.lit(1)).alias("bills"), F.coalesce(F.sum(size), F.lit(0)).cast("double").alias("outstanding"), *sums)
    ctl = c("outstanding") if control is None else F.coalesce(control.scalar().cast("double"), c("outstanding"))
    w = w.withColumn("control_total", ctl)
    spread = F.round(F.abs(c("outstanding") - reduce(lambda a, b: a + b, [c(f"b_{b.lower()}") for b in BUCKETS])), 2)
    gap = F.round(F.abs(c("outstanding") - c("control_total")), 2)
    return w.withColumn("bucket_variance", spread).withColumn("variance", gap).withColumn(
        "status", F.when((spread == 0) & (gap < tolerance), "PASS").otherwise("FAIL"))


def ledger_totals(vouchers: DataFrame, ledger_lines: DataFrame) -> DataFrame:
    """Debit, credit, net and line count per ledger; cancelled vouchers are left out."""
    live = vouchers.filter(~c("is_cancelled")).select(*KEY)
    money = lambda when: F.coalesce(F.sum(F.when(when, c("amount"))), F.lit(0))
    t = ledger_lines.join(live, KEY, "left_semi").groupBy("company_id", "ledger").agg(
        money(~c("is_credit")).alias("d"), money(c("is_credit")).alias("k"), F.count(F.lit(1)).alias("lines"))
    return t.select("company_id", "ledger", c("d").cast("double").alias("debit"), c("k").cast("double").alias("credit"),
                    (c("d") - c("k")).cast("double").alias("net"), "lines")


def reconcile_stock(movement: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Opening + inward - outward against the reported closing quantity."""
    calc = c("opening_qty") + c("inward_qty") - c("outward_qty")
    gap = F.abs(c("closing_qty") - calc)
    return movement.select("name", *[c(x).cast("double").alias(x) for x in ("opening_qty", "inward_qty", "outward_qty")], calc.cast("double").alias("calculated_qty"),
                           c("closing_qty").cast("double").alias("closing_qty"), gap.cast("double").alias("variance"),
                           F.when(gap < tolerance, "PASS").otherwise("FAIL").alias("status"))


def cost_allocation_summary(allocations: DataFrame, cost_centres: DataFrame) -> DataFrame:
    """Per category: allocations, amount, and orphans (cost centre not in the master)."""
    known = cost_centres.select("company_id", c("name").alias("cost_centre"), F.lit(True).alias("_known")).distinct()
    j = allocations.join(known, ["company_id", "cost_centre"], "left")
    orphan = c("_known").isNull()
    return j.groupBy(F.coalesce("category", F.lit("Primary Cost Category")).alias("category")).agg(
        F.count(F.lit(1)).alias("allocations"), F.sum("amount").cast("double").alias("amount"), F.count_if(orphan).alias("orphans"),
        F.coalesce(F.sum(F.when(orphan, c("amount"))), F.lit(0)).cast("double").alias("orphan_amount")).withColumn(
        "status", F.when(c("orphans") == 0, "PASS").otherwise("FAIL"))


def master_counts(raw: dict[str, DataFrame], canonical: dict[str, DataFrame]) -> DataFrame:
    """domain, raw_count, canonical_count, variance, status."""
    rows = []
    for name, frame in canonical.items():
        have = frame.agg(F.count(F.lit(1)).alias("canonical_count"))
        rows.append(have.select(F.lit(name).alias("domain"), raw[name].agg(F.count(F.lit(1)).alias("n")).scalar().alias("raw_count"), "canonical_count"))
    out = reduce(DataFrame.unionByName, rows).withColumn("variance", c("canonical_count") - c("raw_count"))
    return out.withColumn("status", F.when(c("variance") == 0, "PASS").otherwise("MISMATCH"))


def missing_parents(children: DataFrame, groups: DataFrame, domain: str) -> DataFrame:
    """Rows whose parent is neither Primary nor a known group of their company."""
    known = groups.select(c("company_id").alias("_c"), F.lower("name").alias("_g")).distinct()
    orphans = children.filter(c("parent").isNotNull() & (c("parent") != "Primary")).join(
        known, c("company_id").eqNullSafe(c("_c")) & (F.lower("parent") == c("_g")), "left_anti")
    return orphans.select("company_id", F.lit(domain).alias("domain"), "name", c("parent").alias("missing_parent"))


def id_collisions(frame: DataFrame, domain: str) -> DataFrame:
    """Ids that occur more than once inside a company."""
    return frame.groupBy("company_id", "source_object_id").agg(F.count(F.lit(1)).alias("copies")).filter(c("copies") > 1).select(
        "company_id", F.lit(domain).alias("domain"), "source_object_id", "copies")


def dataset_checksum(df: DataFrame) -> DataFrame:
    """Order-independent checksum: row count and the sum of 60-bit row hashes modulo 2**61 - 1."""
    bits = F.conv(F.substring(content_hash(df), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(bits.alias("h")).agg(F.count(F.lit(1)).alias("rows"), (F.sum("h") % F.lit(2305843009213693951).cast("decimal(38,0)")).cast("bigint").alias("checksum"))


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    b, o = dataset_checksum(base), dataset_checksum(other)
    both = b.select("rows", "checksum", o.select("rows").scalar().alias("other_rows"), o.select("checksum").scalar().alias("other_checksum"))
    same = (c("rows") == c("other_rows")) & c("checksum").eqNullSafe(c("other_checksum"))
    return both.withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


def field_coverage(df: DataFrame, entity: str, requested: list[str]) -> DataFrame:
    """Requested fields of an entity: populated, null, and absent from the source altogether."""
    present = [x for x in requested if x in df.columns]
    filled = lambda x: F.count_if(c(x).isNotNull() & (F.trim(c(x).cast("string")) != ""))
    w = df.agg(F.count(F.lit(1)).alias("_n"), *[filled(x).alias(x) for x in present])
    entry = lambda x: F.struct(F.lit(f"{entity}.{x}").alias("field"), (c(x) if x in present else F.lit(0)).cast("bigint").alias("populated"),
                               c("_n").alias("rows"), F.lit(x not in present).alias("absent"))
    out = w.select(F.inline(F.array(*[entry(x) for x in requested]))).withColumn(
        "nulls", F.when(c("absent"), F.lit(0)).otherwise(c("rows") - c("populated")).cast("bigint"))
    return out.withColumn("coverage", F.when(c("rows") == 0, 0.0).otherwise(F.round(c("populated") / F.when(c("rows") != 0, c("rows")) * 100, 2)))


def statutory_profile(ledgers: DataFrame, gstin: DataFrame | None = None) -> DataFrame:
    """Evidence of GST, TDS and foreign currency in the ledgers."""
    cls = ledger_class(c("parent"), c("name"))
    currency = c("currency") if "currency" in ledgers.columns else F.lit(None).cast("string")
    w = ledgers.agg(F.count_if((cls == "TAX") & c("name").rlike("GST")).alias("gst"), F.count_if(c("name").rlike("TDS|Tax Deducted")).alias("tds"),
                    F.count_if(currency.isNotNull() & (currency != "INR")).alias("multi_currency"))
    proven = F.lit(False) if gstin is None else F.coalesce(gstin.select(F.max(c("gstin").isNotNull())).scalar(), F.lit(False))
    word = lambda n, top: F.when(top, "PROVEN").when(c(n) > 0, "PARTIAL" if n == "gst" else "PROVEN").otherwise("NOT_PRESENT")
    row = lambda n, top: F.struct(F.lit(n).alias("capability"), (top | (c(n) > 0)).alias("available"), word(n, top).alias("confidence"), c(n).alias("evidence"))
    no = F.lit(False)
    return w.select(F.inline(F.array(row("gst", proven), row("tds", no), row("multi_currency", no))))


def tenancy_lineage(df: DataFrame, tenant: Column, legal_entity: Column | None = None, connector: str = "LOCAL_BRIDGE_01",
                    source_instance: str = "LOCAL", period: str = "2024-2025") -> DataFrame:
    entity = legal_entity if legal_entity is not None else F.concat(F.lit("LE_"), c("company_id"))
    return df.withColumn("tenancy", F.struct(tenant.alias("tenant_id"), entity.alias("legal_entity_id"), F.lit(connector).alias("connector_id"),
                                             F.lit(source_instance).alias("source_instance_id"), F.lit(period).alias("accounting_period")))


def tenant_isolation(df: DataFrame, partition: str, ident: str = "source_object_id") -> DataFrame:
    """Per tenant partition: rows, rows stamped for another tenant, and PASS or FAIL."""
    leak = c("tenancy.tenant_id") != c(partition)
    return df.groupBy(c(partition).alias("tenant")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(leak).alias("violations"),
                                                        F.min(F.when(leak, c(ident))).alias("first_violation")).withColumn(
        "status", F.when(c("violations") == 0, "PASS").otherwise("FAIL"))
