"""Keys, hashes, dates and flags of source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that change on every fetch and say nothing about the record.
VOLATILE = {"run_id", "last_run_id", "sync_run_id", "extraction_run_id", "fetched_at", "synced_at", "checksum", "alter_id", "content_hash"}


def name_key(name: Column) -> Column:
    """Join key of a name: trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def stable_id(guid: Column, master_id: Column, fallback: Column) -> Column:
    """guid, else MID_<master id>, else HASH_<first 16 of sha256>; NULL (to be rejected) when all are empty."""
    def filled(c: Column) -> Column:
        text = F.trim(c.cast("string"))
        return F.when((F.length(text) > 0) & (text != "0"), text)

    fb = F.trim(fallback)
    return F.coalesce(filled(guid), F.concat(F.lit("MID_"), filled(master_id)),
                      F.when(F.length(fb) > 0, F.concat(F.lit("HASH_"), F.substring(F.sha2(fb, 256), 1, 16))))


def row_id(company: Column, voucher: Column, entry: Column) -> Column:
    key = F.concat(company, F.lit("|"), voucher, F.lit("|"), entry)
    return F.substring(F.sha2(key, 256), 1, 32)


def content_hash(df: DataFrame, exclude: set[str] | None = None) -> Column:
    """sha256 of the record's JSON with keys in order and volatile fields left out."""
    cols = sorted(c for c in df.columns if c not in VOLATILE | (exclude or set()))
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if not _nested(df, c) else F.col(c) for c in cols])), 256)


def _nested(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("array", "struct", "map")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("yes", "true", "1", "on"), F.lit(False))


def parse_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.coalesce(F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def fiscal_year(d: Column) -> Column:
    """April-March financial year, e.g. 2023-2024."""
    y = F.year(F.add_months(d, -3))
    return F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))


def signed_text_amount(c: Column) -> Column:
    """Amount text to a signed decimal: text after the last "=", "Cr" at the end or a leading "-" is credit (negative).

    Plain numbers are cast directly; only text that does not cast takes the pattern path.
    """
    raw = c.cast("string")
    # A cast that fails costs an exception, so text with anything no number holds is not tried.
    plain = F.when(~raw.rlike(r"[^\p{Nd}eE+.\-\p{Cc}\p{Z}]"), raw).try_cast("decimal(18,2)")
    text = F.trim(F.element_at(F.split(raw, "="), -1))
    magnitude = F.abs(F.coalesce(_number(text), F.lit(0).cast("decimal(18,2)")))
    credit = text.rlike(r"(?i)cr\s*$") | text.startswith("-")
    return F.coalesce(plain, F.when(credit, -magnitude).otherwise(magnitude)).cast("decimal(18,2)")


def _number(text: Column) -> Column:
    digits = F.regexp_extract(F.regexp_replace(text, r"[^0-9.\-]", ""), r"^-?\d*\.?\d+", 0)
    return F.when(F.length(digits) > 0, digits).try_cast("decimal(18,2)")


def quantity_of(c: Column) -> Column:
    digits = F.regexp_extract(F.regexp_replace(c.cast("string"), r"[^0-9.\-]", ""), r"^-?\d*\.?\d+", 0)
    return F.when(F.length(digits) > 0, digits).try_cast("decimal(18,3)")


def unit_of(quantity: Column, rate: Column) -> Column:
    """Unit after the number of a quantity ("12 PCS"), else after the slash of a rate ("100/Nos")."""
    a = F.trim(F.regexp_extract(quantity, r"[\d.]\s*([A-Za-z%][\w%.\-\s]*)$", 1))
    b = F.trim(F.regexp_extract(rate, r"/\s*(.+)$", 1))
    return F.coalesce(F.when(F.length(a) > 0, a), F.when(F.length(b) > 0, b))
