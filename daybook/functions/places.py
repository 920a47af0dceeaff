"""City names out of free-form address lines, and their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a city segment may not look like.
NOT_A_CITY = [
    r"(?i)\b(p\.?o\.?\s*box|pin|pincode|phone|tel|mob|mobile|email|e-mail|gstin|fax)\b",
    r"(?i)\b(plot|flat|floor|room|survey|khasra|block\s*no|door\s*no|h\.?no)\b",
    r"(?i)^(india|bharat|haiti|tanzania|nepal|bangladesh|uae|usa|uk|oman|kenya)$",
]
PIN_AT_END = r"(?i)[\s,-]*(pin(code)?\s*[:.-]?\s*)?\b\d{6}\b\s*$"
EDGES = r"^[,;\-\s]+|[,;\-\s]+$"


def _clean(segment: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(segment, PIN_AT_END, ""), EDGES, ""))


def _city_like(candidate: Column, state: Column) -> Column:
    ok = F.length(candidate).between(2, 40) & candidate.rlike("[A-Za-z]") & ~candidate.rlike(r"\d")
    for pattern in NOT_A_CITY:
        ok = ok & ~candidate.rlike(pattern)
    words = F.size(F.split(candidate, r"\s+")) <= 4
    return ok & words & (F.lower(candidate) != F.lower(F.trim(F.coalesce(state, F.lit("")))))


def _city_in(line: Column, state: Column) -> Column:
    """Last city-like comma segment of a line."""
    segments = F.reverse(F.split(line, ","))
    candidates = F.transform(F.filter(segments, lambda x: F.length(F.trim(x)) > 0), lambda x: _clean(F.trim(x)))
    return F.get(F.filter(candidates, lambda x: _city_like(x, state)), 0)


def parse_city(lines: Column, state: Column) -> Column:
    """Struct (city, confidence, reason, raw_address) of an array of address lines.

    A line ending in a six-digit PIN is trusted first (high), read from the last line
    up; otherwise the last line with a city-like segment (medium, or low when it is the
    only line). Otherwise none, with the reason.
    """
    split = F.flatten(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.split(F.coalesce(x, F.lit("")), r"[\n\r]+")))
    kept = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    bottom_up = F.reverse(kept)
    pinned = F.transform(F.filter(bottom_up, lambda x: x.rlike(PIN_AT_END)), lambda x: _city_in(F.regexp_replace(x, PIN_AT_END, ""), state))
    plain = F.transform(bottom_up, lambda x: _city_in(x, state))
    high = F.get(F.filter(pinned, lambda x: x.isNotNull()), 0)
    any_city = F.get(F.filter(plain, lambda x: x.isNotNull()), 0)
    empty = F.size(kept) == 0
    city = F.coalesce(high, any_city)
    confidence = F.when(empty | city.isNull(), "none").when(high.isNotNull(), "high").when(F.size(kept) > 1, "medium").otherwise("low")
    reason = F.when(empty, "ADDRESS_EMPTY").when(city.isNull(), "CITY_NOT_PARSEABLE")
    return F.struct(city.alias("city"), confidence.alias("confidence"), reason.alias("reason"),
                    F.when(~empty, F.array_join(kept, ", ")).alias("raw_address"))


def parse_cities(df: DataFrame, lines: str = "address_lines", state: str = "state") -> DataFrame:
    return df.withColumn("_place", parse_city(F.col(lines), F.col(state))).select(
        *df.columns, "_place.city", F.col("_place.confidence").alias("city_confidence"), F.col("_place.reason").alias("city_reason"),
        F.col("_place.raw_address").alias("raw_address"))


def tidy_city(city: Column) -> Column:
    """Parentheses stripped, spaces collapsed, title case; NULL when nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(city, r"\s*\([^)]*\)", ""), r"\s+", " "))
    return F.when(F.length(text) > 0, F.initcap(text))


def canonical_city(df: DataFrame, lookup: DataFrame, default: str = "Unknown") -> DataFrame:
    """Add ``city_canonical``: alias table first, then the tidied name, then state, country, default."""
    alias = lookup.select(F.lower(F.trim("alias")).alias("_alias"), F.col("canonical").alias("_canonical")).groupBy("_alias").agg(
        F.max("_canonical").alias("_canonical"))
    keyed = df.withColumn("_tidy", tidy_city(F.col("city"))).withColumn("_key", F.lower("_tidy"))
    fallback = [F.col(c) for c in ("state", "country") if c in df.columns]
    return keyed.join(alias, keyed["_key"] == alias["_alias"], "left").withColumn(
        "city_canonical", F.coalesce("_canonical", "_tidy", *fallback, F.lit(default))
    ).drop("_tidy", "_key", "_alias", "_canonical")
