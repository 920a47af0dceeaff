"""Ordered text rules that class ledgers, voucher types, ledger roles and money flows.

The first rule that holds wins. Rules are plain ``when`` chains over lower-cased text,
so they stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text fragments of a ledger's parent group, per class, in order of precedence.
LEDGER_PARENT_WORDS = [
    ("BANK", ("bank",)),
    ("CASH", ("cash",)),
    ("SUNDRY_DEBTOR", ("sundry debtor", "debtors", "receivable", "customers")),
    ("SUNDRY_CREDITOR", ("sundry creditor", "creditors", "payable", "vendors", "suppliers")),
    ("TAX", ("duties", "taxes", "tax", "gst", "tds", "vat")),
    ("EXPENSE", ("direct expense", "indirect expense", "expenses")),
    ("INCOME", ("sales", "direct income", "indirect income", "revenue")),
    ("ASSET", ("fixed asset", "current asset", "investments", "loans & advances (asset)")),
    ("LIABILITY", ("capital", "reserves", "loans (liability)", "current liabilit")),
]
LEDGER_NAME_WORDS = {"BANK": ("bank account", "current account"), "CASH": ("petty cash",)}

# Fragments of "type name + root parent", per voucher class, in order.
VOUCHER_WORDS = [
    ("ORDER", ("purchase order", "sales order", "job work order", "indent", "proforma", "quotation", "estimate")),
    ("INVENTORY_MOVEMENT", ("delivery note", "delivery challan", "receipt note", "goods receipt note", "material in", "material out",
                            "rejections in", "rejections out", "stock journal", "physical stock", "stock transfer")),
    ("CREDIT_NOTE", ("credit note", "cr note", "sales return", "sale return")),
    ("DEBIT_NOTE", ("debit note", "dr note", "purchase return")),
    ("PURCHASE", ("purchase", "inward", "grn invoice")),
    ("SALES", ("sale", "invoice", "bill")),
    ("RECEIPT", ("receipt",)),
    ("PAYMENT", ("payment",)),
    ("CONTRA", ("contra",)),
    ("JOURNAL", ("journal",)),
    ("PAYROLL", ("payroll", "attendance")),
]

# Word-boundary patterns of a ledger's role in a voucher, in order.
ROLE_PATTERNS = [
    ("TAX_CGST", r"\b(cgst|central\s*tax|central\s*goods)\b"),
    ("TAX_SGST", r"\b(sgst|state\s*tax|state\s*goods|utgst|union\s*territory)\b"),
    ("TAX_IGST", r"\b(igst|integrated\s*tax|integrated\s*goods)\b"),
    ("TAX_CESS", r"\b(cess|compensation\s*cess)\b"),
    ("TAX_OTHER", r"\b(duties\s*&\s*taxes|tax|gst|vat|tds|tcs)\b"),
    ("ROUND_OFF", r"\b(round\s*off|rounding|roundoff|round\s*adjustment)\b"),
    ("DISCOUNT", r"\b(discount|rebate|trade\s*disc|cash\s*disc|disc\s*allowed|disc\s*received)\b"),
    ("ADDITIONAL_CHARGES",
     r"\b(freight|transport|cartage|shipping|courier|insurance|packing|loading|handling|forwarding|delivery\s*charges)\b"),
]

# Goods-movement voucher names, tested before the money classes.
MOVEMENT_PATTERN = ("delivery note|delivery challan|receipt note|material in|material out|rejections|physical stock|stock journal")
FLOW_OF_CLASS = {"CREDIT_NOTE": "SALES_RETURN", "DEBIT_NOTE": "PURCHASE_RETURN", "SALES": "SALES", "PURCHASE": "PURCHASE",
                 "RECEIPT": "RECEIPT", "PAYMENT": "PAYMENT", "CONTRA": "CONTRA"}
MONEY_FLOWS = ("SALES", "PURCHASE", "RECEIPT", "PAYMENT")


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    """One pattern per class keeps the generated code small; words are matched literally."""
    return text.rlike("|".join(re.escape(w) for w in words))


def _first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, cond in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def ledger_class(parent: Column, name: Column) -> Column:
    p, n = F.lower(F.coalesce(parent, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    rules: list[tuple[str, Column]] = []
    for cls, words in LEDGER_PARENT_WORDS:
        cond = _has_any(p, words)
        if cls in LEDGER_NAME_WORDS:
            cond = cond | _has_any(n, LEDGER_NAME_WORDS[cls])
        if cls == "CASH":
            cond = cond | (n == "cash")
        rules.append((cls, cond))
    return _first_match(rules, "GENERAL")


def class_text(name: Column, parent: Column) -> Column:
    return F.concat_ws(" ", _text(name), _text(parent))


def voucher_class(text: Column) -> Column:
    """Class of a ``class_text``; put the text in a column of its own so that it is built once per row."""
    return _first_match([(cls, _has_any(text, words)) for cls, words in VOUCHER_WORDS], "OTHER")


def ledger_role(name: Column, who: Column) -> Column:
    """Role of a ledger given normalised ledger and party names."""
    any_role = "|".join(pattern for _, pattern in ROLE_PATTERNS)
    # Most lines are party or base lines: the party test and one combined pattern settle them.
    rules = [("PARTY", (F.length(who) > 0) & (name == who)), ("BASE_AMOUNT", ~name.rlike(any_role))]
    rules += [(role, name.rlike(pattern)) for role, pattern in ROLE_PATTERNS]
    return _first_match(rules, "BASE_AMOUNT")


def coarse_role(role: Column) -> Column:
    return F.when(role.startswith("TAX_"), F.lit("TAX")).otherwise(role)


def classify_ledger(ledgers: DataFrame) -> DataFrame:
    return ledgers.withColumn("classification", ledger_class(F.col("parent"), F.col("name")))


def classify_voucher_type(types: DataFrame) -> DataFrame:
    return types.withColumn("_text", class_text(F.col("name"), F.col("parent"))).withColumn(
        "voucher_class", voucher_class(F.col("_text"))).drop("_text")


def classify_ledger_role(lines: DataFrame) -> DataFrame:
    """Expects ``ledger`` and ``party`` on every line."""
    named = lines.withColumn("_name", _text(F.col("ledger"))).withColumn("_who", _text(F.col("party")))
    return named.withColumn("role", ledger_role(F.col("_name"), F.col("_who"))).drop("_name", "_who")


MAX_PARENT_HOPS = 5


def _company(*frames: DataFrame) -> list[str]:
    """The company column where every frame has one: names are a company's own then."""
    return ["company_id"] if all("company_id" in x.columns for x in frames) else []


def voucher_type_classes(types: DataFrame) -> DataFrame:
    """type_key, parent_key, root_key, voucher_class for every voucher type, by company where ``types`` has company_id.

    The parent chain is walked at most five hops inside its company and stops at a missing or self parent.
    The frame has one row per voucher type, so these are joins of small dimension rows.
    """
    own = _company(types)
    keyed = (
        types.select(*own, _text(F.col("name")).alias("type_key"), _text(F.coalesce("parent", "name")).alias("parent_key"))
        .filter(F.length("type_key") > 0)
        .groupBy(*own, "type_key").agg(F.max("parent_key").alias("parent_key"))
    )
    edges = keyed.filter(F.col("type_key") != F.col("parent_key"))
    walk = keyed.withColumn("root_key", F.col("type_key"))
    for _ in range(MAX_PARENT_HOPS):
        step = edges.select(*own, F.col("type_key").alias("root_key"), F.col("parent_key").alias("_up"))
        walk = walk.join(step, [*own, "root_key"], "left").withColumn("root_key", F.coalesce("_up", "root_key")).drop("_up")
    return walk.withColumn("_text", class_text(F.col("type_key"), F.col("root_key"))).withColumn(
        "voucher_class", voucher_class(F.col("_text"))).drop("_text")


def resolve_voucher_type(vouchers: DataFrame, types: DataFrame) -> DataFrame:
    """Add ``voucher_class``; a type without a master row in the voucher's company is classed by its own name.

    Types without a company_id are shared by all companies.
    """
    own, shown = _company(vouchers, types), [x for x in vouchers.columns if x != "voucher_class"]
    classes = voucher_type_classes(types if own else types.drop("company_id")).select(*own, F.col("type_key").alias("_type"), F.col("voucher_class").alias("_cls"))
    keyed = vouchers.withColumn("_type", _text(F.col("voucher_type")))
    resolved = F.when(F.length("_type") == 0, "OTHER").otherwise(F.coalesce("_cls", voucher_class(F.col("_type"))))
    return keyed.join(classes, [*own, "_type"], "left").select(*shown, resolved.alias("voucher_class"))


def flow_rules(name: Column, parent: Column, cls: Column) -> Column:
    pairs = [F.lit(x) for pair in FLOW_OF_CLASS.items() for x in pair]
    by_class = F.coalesce(F.element_at(F.create_map(*pairs), cls), F.lit("OTHER"))
    moves = name.rlike(MOVEMENT_PATTERN) | parent.rlike(MOVEMENT_PATTERN)
    return F.when(name.contains("order") | parent.contains("order"), "ORDER").when(moves, "INVENTORY").otherwise(by_class)


def resolve_flow(vouchers: DataFrame, types: DataFrame) -> DataFrame:
    """Add the dashboard ``flow``: the type's own name and direct parent in its company decide, goods movement first."""
    own, shown = _company(vouchers, types), [x for x in vouchers.columns if x != "flow"]
    dim = types.select(*own, _text(F.col("name")).alias("_type"), _text(F.col("parent")).alias("_parent")).groupBy(*own, "_type").agg(
        F.max("_parent").alias("_parent"))
    keyed = vouchers.withColumn("_type", _text(F.col("voucher_type")))
    joined = keyed.join(dim, [*own, "_type"], "left").withColumn("_parent", F.coalesce("_parent", F.lit("")))
    joined = joined.withColumn("_text", class_text(F.col("_type"), F.col("_parent"))).withColumn("_cls", voucher_class(F.col("_text")))
    return joined.select(*shown, flow_rules(F.col("_type"), F.col("_parent"), F.col("_cls")).alias("flow"))
