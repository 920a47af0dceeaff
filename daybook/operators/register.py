"""Sales and purchase registers: signed lines, totals and breakdowns with filters.

Voucher-grain and line-grain frames are separate; taxes and charges reach the lines by
joining per-voucher totals, never by collecting a voucher's lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import resolve_voucher_type
from ..functions.identity import name_key
from ..session import written_down
from .fact import KEY, first_base_ledger, signed_round_off, with_roles
from .ranking import rank_with_other

c = F.col
NO_COUNTRY, NO_STATE, NO_CITY, NO_PARTY = "(no country)", "(no state)", "(no city)", "(no party)"
SERVICE_PRODUCT = "(Service / Accounting Invoice)"

# Voucher classes of each register; the second one is its return.
DIRECTIONS = {"SALES": ("SALES", "CREDIT_NOTE"), "PURCHASE": ("PURCHASE", "DEBIT_NOTE")}


def _d(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("decimal(38,2)")


def voucher_ledger_breakdown(roled: DataFrame, *more: Column) -> DataFrame:
    """Per voucher: taxes by kind, round-off signed by its posting side, discount, charges and base ledgers; and ``more`` aggregates.

    Union-territory tax is part of the state tax (one role); ``utgst`` is kept as a zero column.
    """
    part = lambda role: _d(F.sum(F.when(c("role") == role, c("amount"))))
    out = roled.groupBy(*KEY).agg(
        part("TAX_CGST").alias("cgst"), part("TAX_SGST").alias("sgst"), part("TAX_IGST").alias("igst"), _d(F.lit(0)).alias("utgst"),
        part("TAX_CESS").alias("cess"), part("TAX_OTHER").alias("other_tax"), _d(signed_round_off()).alias("round_off"),
        part("DISCOUNT").alias("discount"), part("ADDITIONAL_CHARGES").alias("charges"), part("BASE_AMOUNT").alias("base"), *more)
    return out.withColumn("total_tax", c("cgst") + c("sgst") + c("igst") + c("utgst") + c("cess") + c("other_tax"))


@dataclass
class Filters:
    """OR-lists; empty means no restriction. ``search`` is a contains-match over voucher, party, item and place."""

    party: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    state: list[str] = field(default_factory=list)
    city: list[str] = field(default_factory=list)
    product: list[str] = field(default_factory=list)
    search: str = ""

    @property
    def on_lines(self) -> bool:
        return bool(self.product or self.search)


@dataclass
class Register:
    """``vouchers``: one signed row per voucher. ``lines``: one signed row per line or service voucher.

    ``products``: the product of every line, without the amounts that the lines get from their vouchers. ``items``: those of
    stock lines only. The others are also ``service_product`` of ``vouchers``, so both need no second reading of the ledger lines.
    """

    vouchers: DataFrame
    lines: DataFrame
    products: DataFrame
    items: DataFrame

    def cached(self) -> Register:
        """Keep both frames while several breakdowns of the same register are read."""
        return Register(self.vouchers.persist(), self.lines.persist(), self.products, self.items)


def with_places(vouchers: DataFrame, profile: DataFrame) -> DataFrame:
    place = profile.select(c("company_id").alias("_pc"), name_key(c("name")).alias("_pk"), "country", "state", "city", "city_confidence").groupBy(
        "_pc", "_pk").agg(F.max(F.struct("country", "state", "city", "city_confidence")).alias("_p")).select("_pc", "_pk", "_p.*")
    return vouchers.join(place, (c("company_id") == c("_pc")) & (name_key(c("party")) == c("_pk")), "left").drop("_pc", "_pk").withColumn(
        "city_confidence", F.coalesce("city_confidence", F.lit("none")))


def register_filters(vouchers: DataFrame, stock_lines: DataFrame, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """Party and place restrict vouchers; product and search restrict lines and keep vouchers with a match."""
    v = vouchers
    for col, values, missing in (("party", filters.party, None), ("country", filters.country, NO_COUNTRY), ("state", filters.state, NO_STATE),
                                 ("city", filters.city, NO_CITY)):
        if values:
            v = v.filter((F.coalesce(c(col), F.lit(missing)) if missing else c(col)).isin(values))
    if not filters.on_lines:
        return v, stock_lines.join(v.select(*KEY), KEY, "left_semi")
    head = ["voucher_number", "party", "country", "state", "city"]
    lines = stock_lines.join(v.select(*KEY, *head), KEY)
    hit = lambda cols: F.lit(False) if not cols else _any_contains(cols, filters.search)
    if filters.product:
        lines = lines.filter(c("item").isin(filters.product))
    if filters.search:
        lines = lines.filter(hit([*head, "item"]))
    lines = lines.drop(*head)
    kept = v.join(lines.select(*KEY), KEY, "left_semi")
    if filters.search:
        kept = v.filter(hit(head)).unionByName(kept).dropDuplicates(KEY)
    return kept, lines


def _any_contains(cols: list[str], needle: str) -> Column:
    text = needle.strip().lower()
    out = F.lit(False)
    for col in cols:
        out = out | F.coalesce(F.lower(c(col)).contains(text), F.lit(False))
    return out


def build_register(vouchers: DataFrame, stock_lines: DataFrame, ledger_lines: DataFrame, types: DataFrame, profile: DataFrame,
                   direction: str = "SALES", filters: Filters | None = None, cache: bool = False) -> Register:
    """Normalise one direction: returns negative, taxes and charges spread over lines by size.

    With ``cache`` the joined voucher frame, which both result frames stand on, is kept.
    """
    normal, returned = DIRECTIONS[direction]
    live = resolve_voucher_type(vouchers.filter(~(c("is_cancelled") | c("is_optional"))), types).filter(c("voucher_class").isin(normal, returned))
    head = with_places(live, profile).select(*KEY, "voucher_number", "voucher_type", "voucher_class", "voucher_date", "party", "amount",
                                             "country", "state", "city", "city_confidence")
    head, lines = register_filters(head, stock_lines, filters or Filters())
    sign = F.when(c("voucher_class") == returned, F.lit(-1)).otherwise(F.lit(1))
    head = head.withColumn("is_return", c("voucher_class") == returned).withColumn("sign", sign)
    split = voucher_ledger_breakdown(with_roles(ledger_lines, head.select("company_id", "voucher_id", "party")), first_base_ledger())
    sums = lines.groupBy(*KEY).agg(F.sum("amount").alias("line_total"), F.sum(F.abs("amount")).alias("line_size"), F.count(F.lit(1)).alias("line_count"),
                                   F.sum(F.abs("quantity")).alias("line_quantity"))
    wide = head.join(split, KEY, "left").join(sums, KEY, "left").withColumn("has_items", c("line_count").isNotNull())
    wide = wide.withColumns({x: _d(c(x)) for x in ("cgst", "sgst", "igst", "utgst", "cess", "other_tax", "round_off", "discount", "charges", "base",
                                                   "total_tax", "line_total", "amount")})
    wide = wide.persist() if cache else wide
    service_product = F.coalesce("base_ledger", F.lit(SERVICE_PRODUCT))
    service_base = F.when(c("base") == 0, c("amount") - c("total_tax") - c("charges")).otherwise(c("base"))
    wide = wide.withColumn("net_unsigned", F.when(c("has_items"), c("line_total")).otherwise(service_base))
    signed = lambda name: (c("sign") * c(name)).cast("decimal(38,2)").alias(name)
    out_v = wide.select(
        *KEY, "voucher_number", "voucher_type", "voucher_class", "voucher_date", F.coalesce("party", F.lit(NO_PARTY)).alias("party"), "country", "state", "city",
        "city_confidence", "is_return", "has_items", c("amount").alias("raw_amount"), (c("sign") * c("amount")).cast("decimal(38,2)").alias("invoiced"),
        (c("sign") * c("line_total")).cast("decimal(38,2)").alias("item_value"), (c("sign") * c("net_unsigned")).cast("decimal(38,2)").alias("net"),
        F.coalesce(c("sign") * c("line_quantity"), F.lit(0)).cast("decimal(38,3)").alias("quantity"),
        *[signed(x) for x in ("cgst", "sgst", "igst", "utgst", "cess", "other_tax", "total_tax", "discount", "charges", "round_off")],
        F.when(~c("has_items"), service_product).alias("service_product"))

    extra = (c("charges") + c("round_off") - c("discount")).cast("double")
    ctx = wide.select(*KEY, "voucher_number", "voucher_class", "voucher_date", "party", "country", "state", "city", "city_confidence", "is_return", "sign",
                      c("total_tax").cast("double").alias("_tax"), extra.alias("_extra"), "line_size", "line_count", "has_items", "net_unsigned", "base_ledger")
    share = F.when(c("line_size") == 0, 1.0 / c("line_count")).otherwise(F.abs("amount").cast("double") / F.when(c("line_size") != 0, c("line_size")).cast("double"))
    # A voucher meets its lines once; one that has none stands as its own service line.
    joined = ctx.join(lines.withColumn("_line", F.lit(True)), KEY, "left").withColumn("_share", share)
    of_line = c("_line").isNotNull()
    each = lambda line, service: F.when(of_line, line).otherwise(service)
    out_l = joined.select(
        *_ctx_cols(), each(c("item"), service_product).alias("product"), each((c("sign") * F.abs("quantity")), F.lit(1)).cast("decimal(38,3)").alias("quantity"),
        each(c("unit"), F.lit("Service")).alias("unit"), each(c("sign") * c("amount"), c("sign") * c("net_unsigned")).cast("decimal(38,2)").alias("amount"),
        each(F.round(c("sign") * c("_tax") * c("_share"), 2), F.round(c("sign") * c("_tax"), 2)).alias("gst"),
        each(F.round(c("sign") * c("_extra") * c("_share"), 2), F.round(c("sign") * c("_extra"), 2)).alias("charges"), (~of_line).alias("is_accounting_invoice"))
    out_l = out_l.withColumn("total", F.round(c("amount").cast("double") + c("gst") + c("charges"), 2))
    items = lines.select(c("item").alias("product"))
    products = items.unionByName(wide.filter(~c("has_items")).select(service_product.alias("product")))
    return Register(out_v, out_l, products, items)


def _ctx_cols() -> list:
    return [*KEY, "voucher_number", "voucher_date", F.coalesce("party", F.lit(NO_PARTY)).alias("party"), "country", "state", "city", "is_return"]


def _dbl(expr: Column, name: str) -> Column:
    return F.coalesce(expr, F.lit(0)).cast("double").alias(name)


def register_totals(reg: Register) -> DataFrame:
    """One row. The vouchers are read once: summed by party, and the products of those without lines counted with the lines' own."""
    facet = lambda kind, value: F.struct(F.lit(kind).alias("facet"), value.alias("name"))
    gross, returns = F.when(~c("is_return"), c("raw_amount")), F.when(c("is_return"), c("raw_amount"))
    added = {"invoiced": c("invoiced"), "gross": gross, "returns": returns} | {x: c(x) for x in (
        "item_value", "net", "cgst", "sgst", "igst", "utgst", "cess", "total_tax", "discount", "charges", "round_off", "quantity")}
    counted = {"invoices": ~c("is_return"), "return_count": c("is_return"), "vouchers_without_items": ~c("has_items"), "vouchers": F.lit(True)}
    own = reg.vouchers.select(
        *[value.alias(x) for x, value in added.items()], *[F.when(cond, 1).alias(x) for x, cond in counted.items()],
        F.inline(F.array_compact(F.array(facet("party", c("party")), F.when(c("service_product").isNotNull(), facet("product", c("service_product")))))))
    each = own.unionByName(reg.items.select(F.lit("product").alias("facet"), c("product").alias("name")), allowMissingColumns=True)
    of_party = lambda x: F.sum(F.when(c("facet") == "party", c(x))).alias(x)
    per = each.groupBy("facet", "name").agg(*[of_party(x) for x in (*added, *counted)])
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x)
    named = (c("facet") == "product") & c("name").isNotNull() & (c("name") != SERVICE_PRODUCT)
    names = [*list(added)[:-1], "invoices", "return_count", "quantity", "parties", "vouchers_without_items", "vouchers"]
    out = per.agg(*[_dbl(F.sum(x), x) for x in added], *[count(x) for x in counted], F.count_if(c("facet") == "party").alias("parties"),
                  F.count_if(named).alias("items"))
    average = F.when(c("invoices") > 0, F.round(c("invoiced") / F.when(c("invoices") > 0, c("invoices")), 2)).otherwise(0.0)
    return out.select(*names, average.alias("average_invoice"), "items")


def register_by_month(reg: Register) -> DataFrame:
    return reg.vouchers.filter(c("voucher_date").isNotNull()).groupBy(F.date_format("voucher_date", "yyyy-MM").alias("month")).agg(
        _dbl(F.sum("invoiced"), "amount"), _dbl(F.sum("net"), "net"), _dbl(F.sum(F.when(~c("is_return"), c("raw_amount"))), "gross"),
        _dbl(F.sum(F.when(c("is_return"), c("raw_amount"))), "returns_amount"), F.count_if(~c("is_return")).alias("invoices"),
        F.count_if(c("is_return")).alias("returns"), _dbl(F.sum("total_tax"), "tax"), _dbl(F.sum("quantity"), "quantity"))


def register_by_party(reg: Register) -> DataFrame:
    """The parties' sums and their best products are written down one after the other: the shuffles of one lie on disk at a time."""
    per = written_down(reg.vouchers.groupBy("party").agg(
        F.max("country").alias("country"), F.max("state").alias("state"), F.max("city").alias("city"), _dbl(F.sum("invoiced"), "amount"), _dbl(F.sum("net"), "net"),
        _dbl(F.sum(F.when(~c("is_return"), c("raw_amount"))), "gross"), F.count_if(~c("is_return")).alias("invoices"), F.count_if(c("is_return")).alias("returns"),
        _dbl(F.sum("total_tax"), "gst"), _dbl(F.sum(c("charges") + c("round_off") - c("discount")), "charges"), _dbl(F.sum("quantity"), "quantity"),
        F.date_format(F.min("voucher_date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("voucher_date"), "yyyy-MM-dd").alias("last_date")), "parties")
    by_product = reg.lines.filter(c("product") != SERVICE_PRODUCT).groupBy("party", "product").agg(F.sum("amount").alias("a"))
    top = written_down(by_product.groupBy("party").agg(F.min_by("product", F.struct(-c("a"), c("product"))).alias("top_product")), "party-products")
    whole = per.agg(F.sum("amount")).scalar()
    base = F.when(F.coalesce(whole, F.lit(0.0)) != 0, whole).otherwise(1.0)
    return per.join(top, "party", "left").withColumn("share_pct", F.round(c("amount") / base * 100, 1)).withColumn(
        "average_invoice", F.when(c("invoices") > 0, F.round(c("gross") / F.when(c("invoices") > 0, c("invoices")), 2)).otherwise(0.0)).withColumn(
        "top_product", F.coalesce("top_product", F.lit("-")))


def register_by_item(reg: Register) -> DataFrame:
    """Unit is NULL when an item is sold in more than one unit."""
    return reg.lines.filter(c("product") != SERVICE_PRODUCT).groupBy("product").agg(
        F.when(F.min("unit") == F.max("unit"), F.min("unit")).alias("unit"), _dbl(F.sum("amount"), "net"), F.round(F.sum("total"), 2).alias("gross"),
        _dbl(F.sum("quantity"), "quantity"), F.count(F.lit(1)).alias("lines"))


CONFIDENCE = ("none", "low", "medium", "high")


def register_by_place(reg: Register, level: str = "state") -> DataFrame:
    """By state, or by city with the lowest confidence any of its vouchers has."""
    label = F.coalesce(c(level), F.lit(NO_STATE if level == "state" else NO_CITY)).alias("name")
    aggs = [_dbl(F.sum("invoiced"), "amount"), _dbl(F.sum("net"), "net"), F.count(F.lit(1)).alias("invoices")]
    if level == "city":
        order = F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), c("city_confidence"))
        aggs.append(F.min_by("city_confidence", order).alias("confidence"))
    return reg.vouchers.groupBy(label).agg(*aggs)


def ranked_breakdown(breakdown: DataFrame, label: str, amount: str, top: int = 8) -> DataFrame:
    return rank_with_other(breakdown, label, amount, top)


def filter_options(reg: Register) -> DataFrame:
    """facet, value of everything the register can be filtered by."""
    v = reg.vouchers.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("facet"), value.alias("value")) for f, value in (
            ("party", c("party")), ("country", F.coalesce("country", F.lit(NO_COUNTRY))), ("state", F.coalesce("state", F.lit(NO_STATE))),
            ("city", F.coalesce("city", F.lit(NO_CITY))))])))
    products = reg.lines.filter(~c("is_accounting_invoice")).select(F.lit("product").alias("facet"), c("product").alias("value"))
    return v.unionByName(products).distinct()


def detail_rows(reg: Register) -> DataFrame:
    return reg.lines.orderBy(c("voucher_date").desc_nulls_last(), c("voucher_number").desc_nulls_last(), "product", "amount")


def browse(df: DataFrame, search: str = "", fields: tuple[str, ...] = (), sort: str | None = None, descending: bool = False,
           page: int = 1, page_size: int = 50, tie: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(page rows, one-row meta): contains-search over ``fields``, NULLs last, offset paging."""
    found = df.filter(_any_contains(list(fields), search)) if search and fields else df
    meta = found.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).cast("bigint").alias("page"), F.lit(page_size).cast("bigint").alias("page_size"),
        F.ceil(c("total") / page_size).cast("bigint").alias("pages"))
    if sort:
        order = c(sort).desc_nulls_last() if descending else c(sort).asc_nulls_last()
        found = found.orderBy(order, *[c(t).asc_nulls_last() for t in tie])
    return found.offset((page - 1) * page_size).limit(page_size), meta
