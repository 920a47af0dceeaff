"""The sales fact table: voucher lines joined to their masters, charges allocated, quality noted.

Inputs are flat canonical tables (see README): vouchers, stock_lines, ledger_lines and
masters, all carrying ``company_id``. A voucher's lines are never gathered into one
row: totals are aggregated per voucher (map-side first) and joined back, so a voucher
or party that holds a third of all lines is an ordinary skewed equi-join for AQE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import parent_chains
from ..functions.classify import classify_ledger_role, coarse_role, ledger_class, resolve_voucher_type
from ..functions.identity import name_key, row_id
from ..functions.places import parse_city
from ..session import written_down

MONEY = "decimal(18,2)"
KEY = ["company_id", "voucher_id"]
c = F.col

# Voucher types that are sales documents, by fragment of their name.
SALES_TYPE_PATTERN = "sales|credit note|delivery|tax invoice"
# Where a customer classification may come from.
CLASSIFICATION_SOURCES = ("manual", "external_master", "ledger_group", "tdl_udf")


def one_per_key(master: DataFrame, key: Column, order: str = "source_object_id") -> DataFrame:
    """One master row per (company, key), the last in source order; NULL keys are dropped."""
    cols = [x for x in master.columns if x not in ("company_id",)]
    keyed = master.withColumn("_key", key).filter(c("_key").isNotNull())
    picked = keyed.groupBy("company_id", "_key").agg(F.max_by(F.struct(*cols), c(order)).alias("m"))
    return picked.select("company_id", "_key", "m.*")


def lookup_master(facts: DataFrame, master: DataFrame, name: str, prefix: str, ident: str | None = None) -> DataFrame:
    """Left equi-join to a master within the company: by id where given and found, else by name key.

    Master columns arrive as ``<prefix>_<column>``. At most one match, so no row is multiplied.
    """
    cols = [x for x in master.columns if x != "company_id"]

    def side(keyed: DataFrame, tag: str) -> DataFrame:
        return keyed.select(c("company_id").alias(f"_{tag}c"), c("_key").alias(f"_{tag}k"), *[c(x).alias(f"_{tag}_{x}") for x in cols])

    by_name = side(one_per_key(master, name_key(c("name"))), "n")
    out = _join_name(facts, by_name, name)
    if ident:
        by_id = side(one_per_key(master, c("source_object_id")), "i")
        out = out.join(by_id, (c("company_id") == c("_ic")) & (c(ident) == c("_ik")), "left")
        picked = [F.coalesce(f"_i_{x}", f"_n_{x}").alias(f"{prefix}_{x}") for x in cols]
    else:
        picked = [c(f"_n_{x}").alias(f"{prefix}_{x}") for x in cols]
    return out.select(*facts.columns, *picked)


def _join_name(facts: DataFrame, by_name: DataFrame, name: str) -> DataFrame:
    right = by_name.withColumnRenamed("_nk", "_name_key")
    return facts.join(right, (c("company_id") == c("_nc")) & (name_key(c(name)) == c("_name_key")), "left")


def party_profile(ledgers: DataFrame) -> DataFrame:
    """One row per party ledger: country, state, city and how sure the city is."""
    place = parse_city(c("address_lines"), c("state"))
    return ledgers.select("company_id", "source_object_id", "name", "country", "state", place.alias("p")).select(
        "company_id", "source_object_id", "name", "country", "state", c("p.city").alias("city"),
        c("p.confidence").alias("city_confidence"), c("p.reason").alias("city_reason"), c("p.raw_address").alias("raw_address"))


def parties(ledgers: DataFrame, kind: str) -> DataFrame:
    """Customers (debtor ledgers) or suppliers (creditor ledgers)."""
    wanted = {"customers": "SUNDRY_DEBTOR", "suppliers": "SUNDRY_CREDITOR"}[kind]
    return ledgers.withColumn("classification", ledger_class(c("parent"), c("name"))).filter(c("classification") == wanted)


def classify_customers(ledgers: DataFrame, classes: DataFrame) -> DataFrame:
    """Ledgers with tier and customer type from allowed sources only; the latest row wins."""
    allowed = classes.filter(c("source").isin(*CLASSIFICATION_SOURCES)).groupBy("company_id", "ledger_id").agg(
        F.max_by(F.struct("tier", "customer_type", "source"), F.struct("updated_at", "source", "tier")).alias("k"))
    right = allowed.select(c("company_id").alias("_c"), c("ledger_id").alias("_l"), "k.*").select(
        "_c", "_l", "tier", "customer_type", c("source").alias("classification_source"))
    return ledgers.join(right, (c("company_id") == c("_c")) & (c("source_object_id") == c("_l")), "left").drop("_c", "_l")


def with_roles(ledger_lines: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Ledger lines with their role; PARTY needs the voucher's own party name."""
    who = vouchers.select("company_id", "voucher_id", "party")
    return classify_ledger_role(ledger_lines.join(who, KEY))


def signed_round_off() -> Column:
    """Round-off of one voucher as it moves the total: what stands opposite to the party adds, what stands on its side is taken off.

    An aggregate over lines with ``role``, ``amount`` (a magnitude) and ``is_credit``. Without a party line the voucher
    is read as a sale, where credits add; a line without a side counts as a credit.
    """
    credit = F.when(~c("is_credit"), -c("amount")).otherwise(c("amount"))
    at = lambda role: F.coalesce(F.sum(F.when(c("role") == role, credit)), F.lit(0))
    return F.when(at("PARTY") > 0, -at("ROUND_OFF")).otherwise(at("ROUND_OFF"))


def first_base_ledger() -> Column:
    """First base ledger of one voucher: an aggregate over lines with ``role``, so it needs no reading of the lines of its own."""
    return F.min_by("ledger", F.when(c("role") == "BASE_AMOUNT", F.struct("line", "ledger"))).alias("base_ledger")


def voucher_charges(roled: DataFrame, *more: Column) -> DataFrame:
    """Per voucher: tax, charges, round-off signed by its posting side, discount, base ledgers, and the net load; and ``more`` aggregates.

    A line whose role is NULL counts in none of them. Without ``more`` there are sums only, so this stays a hash
    aggregation with map-side combine.
    """
    roled = roled.withColumn("_role", coarse_role(c("role")))
    role = c("_role")
    part = lambda r, v: F.coalesce(F.sum(F.when(role == r, v)), F.lit(0)).cast(MONEY)
    size = F.abs("amount")
    out = roled.groupBy(*KEY).agg(
        part("TAX", size).alias("tax"), part("ADDITIONAL_CHARGES", size).alias("charges"), signed_round_off().cast(MONEY).alias("round_off"),
        part("DISCOUNT", size).alias("discount"), part("BASE_AMOUNT", size).alias("base_amount"), *more)
    return out.withColumn("charge_load", (c("tax") + c("charges") + c("round_off") - c("discount")).cast(MONEY))


def base_ledgers(ledger_lines: DataFrame, only: DataFrame) -> DataFrame:
    """First base ledger of the vouchers in ``only`` (service vouchers, the only ones whose name it becomes).

    The join that brings the party's name cuts the lines to those vouchers, so roles are worked out for theirs only.
    """
    rows = with_roles(ledger_lines.select(*KEY, "ledger", "line"), only).filter(c("role") == "BASE_AMOUNT")
    return rows.groupBy(*KEY).agg(F.min_by("ledger", F.struct("line", "ledger")).alias("base_ledger"))


def arrived_roles(ledger_lines: DataFrame, live: DataFrame) -> DataFrame:
    """Lines of live vouchers with their role, by one join; of vouchers with ``copies`` those of the kept arrival.

    With column ``arrival`` the lines of later arrivals stay with role NULL, so that their voucher counts as posted. Without
    it, of equal lines of a voucher that came more than once one stays.
    """
    if "arrival" in ledger_lines.columns:
        who = live.select(*KEY, "party", "copies", c("arrival").alias("_arrival"))
        roled = classify_ledger_role(ledger_lines.join(who, KEY))
        return roled.withColumn("role", F.when((c("copies") == 1) | (c("arrival") == c("_arrival")), c("role")))
    once, twice = (live.filter(cond).select(*KEY, "party", "copies") for cond in (c("copies") == 1, c("copies") > 1))
    # A stage of its own, so that its rows are counted before the lines are read for it: with none of them nothing is read.
    repeated = ledger_lines.join(twice.repartition("voucher_id"), KEY).distinct()
    return classify_ledger_role(ledger_lines.join(once, KEY).unionByName(repeated))


def with_line_totals(lines: DataFrame) -> DataFrame:
    """Lines with size and number of all lines of their voucher."""
    return lines.join(lines.groupBy(*KEY).agg(F.sum(F.abs("amount")).alias("_total"), F.count(F.lit(1)).alias("_lines")), KEY)


def share_load(joined: DataFrame) -> DataFrame:
    """``line_share`` and ``amount_with_charges`` of lines that carry their voucher's totals and ``charge_load``."""
    load = F.coalesce(c("charge_load"), F.lit(0)).cast("double")
    share = F.when(c("_total") == 0, 1.0 / c("_lines")).otherwise(F.abs("amount").cast("double") / F.when(c("_total") != 0, c("_total")).cast("double"))
    value = F.round(c("amount").cast("double") + load * share, 2).cast(MONEY)
    return joined.withColumn("line_share", share).withColumn("amount_with_charges", value).drop("_total", "_lines", "charge_load")


def allocate_charges(lines: DataFrame, charges: DataFrame) -> DataFrame:
    """Spread each voucher's charge load over its lines by size (evenly when all lines are zero)."""
    return share_load(with_line_totals(lines).join(charges.select(*KEY, "charge_load"), KEY, "left"))


def with_invoice_base(j: DataFrame) -> DataFrame:
    """``base_value``, ``base_with_charges`` and ``product`` of vouchers that carry their charges and first base ledger."""
    has_base = F.coalesce(c("base_amount"), F.lit(0)) != 0
    header = F.abs(F.coalesce("amount", F.lit(0)))
    return j.withColumn("base_value", F.when(has_base, c("base_amount")).otherwise(header).cast(MONEY)).withColumn(
        "base_with_charges", F.when(has_base, c("base_amount") + c("charge_load")).otherwise(header).cast(MONEY)).withColumn(
        "product", F.coalesce("base_ledger", F.lit("(Service / Accounting Invoice)")))


def accounting_invoice_base(service: DataFrame, charges: DataFrame, ledger_lines: DataFrame | None = None) -> DataFrame:
    """Base value of vouchers without stock lines: their base ledgers, else the header amount (then without charges).

    Without ``ledger_lines`` the charges carry ``first_base_ledger``.
    """
    j = service.join(charges, KEY, "left")
    return with_invoice_base(j if ledger_lines is None else j.join(base_ledgers(ledger_lines, service), KEY, "left"))


def dedupe_rows(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the first row of each key in ``order``; the others with how often each occurs.

    Exact copies collapse in a map-side aggregation before anything is shuffled, and the
    kept row is an aggregate (min of the ordering struct), so a key that a third of all
    rows share never has to be sorted in one task.
    """
    rest = [x for x in rows.columns if x not in key]
    ordering = [*order, *[x for x in rest if x not in order]]
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = distinct.groupBy(*key).agg(F.min(F.struct(*ordering)).alias("_first"))
    kept = first.select(*key, "_first.*").select(*rows.columns)
    joined = distinct.join(first.select(*key, c("_first").alias("_f")), key)
    is_kept = F.struct(*ordering).eqNullSafe(c("_f")).cast("bigint")
    rejected = joined.withColumn("copies", c("copies") - is_kept).filter(c("copies") > 0).drop("_f").withColumn(
        "reason", F.lit("DUPLICATE_ROW_ID"))
    return kept, rejected


def first_arrivals(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key with ``copies``: the earliest by column ``arrival`` where there is one, then by the other columns.

    One aggregation with map-side combine gives the kept row and how many more came, so a key that a third of all rows
    share is folded before the shuffle.
    """
    first = ["arrival"] if "arrival" in rows.columns else []
    rest = [x for x in rows.columns if x not in [*key, *first]]
    tagged = rows.groupBy(*key).agg(F.min(F.struct(*first, *rest)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return tagged.select(*key, *[c(f"_first.{x}").alias(x) for x in [*first, *rest]], "copies")


def eligible_vouchers(vouchers: DataFrame) -> DataFrame:
    """Sales-type vouchers (or untyped ones) before cancelled and optional ones are taken out."""
    kind = F.lower(F.trim(F.coalesce("voucher_type", F.lit(""))))
    return vouchers.filter((F.length(kind) == 0) | kind.rlike(SALES_TYPE_PATTERN))


def live_vouchers(vouchers: DataFrame) -> DataFrame:
    """First arrival of each eligible voucher that is neither cancelled nor optional, with ``copies``."""
    return first_arrivals(eligible_vouchers(vouchers).filter(~(c("is_cancelled") | c("is_optional"))), KEY)


def rejected_vouchers(vouchers: DataFrame, stock_lines: DataFrame, ledger_lines: DataFrame) -> DataFrame:
    """Side output: voucher and why it produced no fact row, once for each arrival."""
    e = eligible_vouchers(vouchers)
    off = e.filter(c("is_cancelled") | c("is_optional")).select(*KEY, F.lit("VOUCHER_CANCELLED_OR_OPTIONAL").alias("reason"))
    bare = e.filter(~(c("is_cancelled") | c("is_optional"))).filter(F.coalesce("amount", F.lit(0)) == 0).join(
        stock_lines.select(*KEY), KEY, "left_anti").join(ledger_lines.select(*KEY), KEY, "left_anti").select(
        *KEY, F.lit("NO_INVENTORY_OR_LEDGER_ENTRIES").alias("reason"))
    return off.unionByName(bare)


@dataclass
class FactBuild:
    """``facts``, and ``rejected``: company_id, voucher_id, row_id (NULL for whole vouchers), reason and how many copies."""

    facts: DataFrame
    rejected: DataFrame


def build_facts(
    vouchers: DataFrame,
    stock_lines: DataFrame,
    ledger_lines: DataFrame,
    ledgers: DataFrame,
    items: DataFrame,
    groups: DataFrame,
    cost_centres: DataFrame,
    classes: DataFrame,
    types: DataFrame,
    salesman_enabled: bool = True,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> FactBuild:
    """One row per stock line of a live sales document, plus one row per service voucher.

    A row id that arrives again is rejected with DUPLICATE_ROW_ID before charges are shared out: vouchers and stock lines are
    reduced to their first arrivals, and the ledger lines of vouchers that came more than once to those of the first.
    Column ``arrival`` of vouchers, stock and ledger lines says which came first; without it the least row stays, and of
    equal ledger lines of such a voucher one.

    With ``keep`` (``written_down``) the vouchers with their charges, then their rows before the masters of items and centres are
    kept on the way: on large books the shuffles of one of the three steps lie on disk at a time, not those of all.
    """
    keep = keep or (lambda df, _name: df)
    live = resolve_voucher_type(live_vouchers(vouchers), types).withColumn("is_return", c("voucher_class") == "CREDIT_NOTE")
    head = live.select(*KEY, "voucher_number", "voucher_date", "party", "amount", "is_return", "voucher_class", "copies")
    centre = F.min_by("cost_centre", F.when(c("role").isNotNull() & c("cost_centre").isNotNull(), F.struct("line", "cost_centre")))
    charges = voucher_charges(arrived_roles(ledger_lines, live), first_base_ledger(), centre.alias("_voucher_centre"), F.lit(True).alias("_posted"))
    # What is one for each voucher is joined at the voucher's grain; its lines then meet it once.
    profile = classify_customers(party_profile(ledgers), classes)
    voucher = with_invoice_base(lookup_master(head.drop("copies"), profile, "party", "ledger").join(charges, KEY, "left")).withColumnRenamed("amount", "_header")
    voucher = keep(voucher.drop("tax", "charges", "round_off", "discount", "base_amount", "base_ledger"), "fact-vouchers")

    entries = first_arrivals(stock_lines, [*KEY, "entry_id"])
    lines = with_line_totals(entries.select(
        *KEY, "entry_id", "line", "item", "quantity", "unit", "rate", F.abs("amount").cast(MONEY).alias("amount"), "cost_centre"))
    rows = share_load(voucher.join(lines.withColumn("_stock", F.lit(True)), KEY, "left")).filter(
        c("_stock") | c("_posted") | (F.coalesce("_header", F.lit(0)) != 0))
    rows = rows.withColumn("is_accounting_invoice", c("_stock").isNull())
    synthetic = {
        "entry_id": F.concat(c("voucher_id"), F.lit("#ACCT1")), "line": F.lit(1).cast("bigint"), "item": c("product"),
        "quantity": F.lit(1).cast("decimal(18,3)"), "unit": F.lit("Service"), "rate": c("base_value").cast("string"), "amount": c("base_value"),
        "cost_centre": F.lit(None).cast("string"), "line_share": F.lit(1.0), "amount_with_charges": c("base_with_charges")}
    rows = rows.withColumns({name: F.when(c("is_accounting_invoice"), value).otherwise(c(name)) for name, value in synthetic.items()})
    rows = keep(rows.drop("_stock", "_posted", "_header", "base_value", "base_with_charges", "product", "line_share"), "fact-rows")

    twice = head.filter(c("copies") > 1).select(*KEY, "amount", "copies")
    repeats = entries.filter(c("copies") > 1).join(head.select(*KEY), KEY, "left_semi").select(*KEY, "entry_id", "copies")
    service_repeats = twice.join(stock_lines.select(*KEY), KEY, "left_anti").join(
        ledger_lines.groupBy(*KEY).agg(F.lit(True).alias("_posted")), KEY, "left").filter(c("_posted") | (F.coalesce("amount", F.lit(0)) != 0)).select(
        *KEY, F.concat(c("voucher_id"), F.lit("#ACCT1")).alias("entry_id"), "copies")
    duplicates = repeats.unionByName(service_repeats).select(
        *KEY, row_id(c("company_id"), c("voucher_id"), c("entry_id")).alias("row_id"), F.lit("DUPLICATE_ROW_ID").alias("reason"), (c("copies") - 1).alias("copies"))
    whole = rejected_vouchers(vouchers, stock_lines, ledger_lines).select(
        *KEY, F.lit(None).cast("string").alias("row_id"), "reason", F.lit(1).cast("bigint").alias("copies"))

    rows = lookup_master(rows, items.select("company_id", "source_object_id", "name", "parent"), "item", "item_master")
    rows = lookup_master(rows, groups.select("company_id", "source_object_id", "name"), "item_master_parent", "group_master")
    centre = F.coalesce("cost_centre", "_voucher_centre") if salesman_enabled else F.lit(None).cast("string")
    rows = rows.withColumn("_centre", centre)
    rows = lookup_master(rows, cost_centres.select("company_id", "source_object_id", "name"), "_centre", "centre_master")

    stocky = ~c("is_accounting_invoice")
    reasons = [
        (c("party").isNull(), "CUSTOMER_MISSING"),
        (c("party").isNotNull() & c("ledger_source_object_id").isNull(), "LEDGER_NOT_FOUND"),
        (c("ledger_tier").isNull(), "TIER_NOT_CONFIGURED"),
        (c("ledger_customer_type").isNull(), "CUSTOMER_TYPE_NOT_CONFIGURED"),
        (c("ledger_state").isNull(), "STATE_NOT_AVAILABLE"),
        (c("ledger_source_object_id").isNull() | (c("ledger_city_reason") == "ADDRESS_EMPTY"), "ADDRESS_EMPTY"),
        (c("ledger_city_reason") == "CITY_NOT_PARSEABLE", "CITY_NOT_PARSEABLE"),
        (stocky & c("item_master_source_object_id").isNull(), "STOCK_ITEM_NOT_FOUND"),
        (stocky & c("item_master_parent").isNotNull() & c("group_master_source_object_id").isNull(), "STOCK_GROUP_NOT_FOUND"),
        (c("_centre").isNull(), "SALESMAN_UNAVAILABLE"),
    ]
    quality = F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in reasons])))
    facts = rows.select(
        row_id(c("company_id"), c("voucher_id"), c("entry_id")).alias("row_id"), "company_id", "voucher_id", "voucher_number", "voucher_date",
        "entry_id", "line", c("party").alias("customer"),
        F.when(c("is_accounting_invoice"), F.lit("Service")).otherwise(F.coalesce("group_master_name", "item_master_parent")).alias("grp"),
        F.coalesce("item_master_name", "item").alias("item"), F.coalesce("centre_master_name", "_centre").alias("salesman"),
        F.coalesce("ledger_city", "ledger_state").alias("city"), c("ledger_state").alias("state"), c("ledger_tier").alias("tier"),
        c("ledger_customer_type").alias("customer_type"), "amount", "amount_with_charges", "quantity", "unit", "rate", "is_return",
        "is_accounting_invoice", "voucher_class", F.coalesce("ledger_city_confidence", F.lit("none")).alias("city_confidence"),
        quality.alias("data_quality"))
    return FactBuild(facts, whole.unionByName(duplicates))


def build_fact_sales(*tables: DataFrame, salesman_enabled: bool = True) -> DataFrame:
    """The fact rows of ``build_facts``."""
    return build_facts(*tables, salesman_enabled=salesman_enabled).facts


def fact_stats(facts: DataFrame, vouchers: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: vouchers, rows, rejects (with copies), net and charged totals, and the gross of the vouchers' first arrivals.

    The facts are read once: summed by voucher, then joined with the headers. The rejects are counted first and that one row is
    written down, so their shuffles are gone when the facts are read.
    """
    rej = written_down(rejected.agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("rejected")), "rejected")
    per = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("net"), F.sum("amount_with_charges").alias("with_charges"))
    first = live_vouchers(vouchers).select(*KEY, "amount", F.lit(True).alias("_live"))
    own = per.join(first, KEY, "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("net").cast("double").alias("net"), F.sum("with_charges").cast("double").alias("with_charges"),
        F.count("_live").alias("vouchers"), F.sum("amount").cast("double").alias("gross_vouchers"))
    return own.select("rows", "net", "with_charges", "vouchers", "gross_vouchers", rej.scalar().alias("rejected"))


def stock_group_tree(groups: DataFrame, items: DataFrame) -> DataFrame:
    """name, root, path, depth, item count and is_cyclic of every group; roots have parent Primary, none, or a missing one.

    Chains are followed to their end. A group whose chain runs into a cycle stands as a root with is_cyclic.
    """
    held = items.groupBy("company_id", name_key(c("parent")).alias("node")).agg(F.count(F.lit(1)).alias("items"))
    return _group_chains(groups).join(held, ["company_id", "node"], "left").select(
        "company_id", "name", "root", "path", "depth", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"), "is_cyclic")


def stock_group_items(groups: DataFrame, items: DataFrame) -> DataFrame:
    """source_object_id, name, grp, root and path of every item that is filed under a known group: the leaves of the tree."""
    leaves = items.select("company_id", "source_object_id", c("name").alias("item"), name_key(c("parent")).alias("node"))
    return leaves.join(_group_chains(groups), ["company_id", "node"]).select(
        "company_id", "source_object_id", c("item").alias("name"), c("name").alias("grp"), "root", "path")


def _group_chains(groups: DataFrame) -> DataFrame:
    node = groups.select("company_id", "name", name_key(c("name")).alias("node"), name_key(F.coalesce("parent", F.lit(""))).alias("parent"))
    node = node.groupBy("company_id", "node").agg(F.max_by(F.struct("name", "parent"), c("name")).alias("m")).select("company_id", "node", "m.*")
    return parent_chains(node.withColumn("parent", F.when(~c("parent").isin("", "primary"), c("parent"))), ["company_id"])
