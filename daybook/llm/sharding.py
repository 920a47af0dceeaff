"""Shards of near-equal bytes by sampled splitters. DataFrame operations only.

1. Every record gets a range key, the hash of its text, so that equal texts lie side by side.
2. A sample of keys, drawn with a chance in proportion to size, gives quantile boundaries.
3. Ranges with more than their share (one text that a third of all rows hold) are subdivided by the hash of the id
   until every cell is small, whatever the input.
4. Prefix sums over cells, then inside each cell, give each record its byte offset and rank in the whole order; the
   shard is the offset's fraction of the total. Two shards differ by less than the largest record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import staged

LAW = "bytes"


def splitters(records: DataFrame, n_ranges: int, sample_per_range: int = 4) -> list[int]:
    """Quantile boundaries of ``key`` from a sample weighted by ``size``: the smallest -ln(u) / size win.

    The sample has n_ranges * sample_per_range keys whatever the input; nothing else reaches the driver.
    """
    u = (F.pmod(F.xxhash64("tie", F.lit("draw")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = records.select("key", (-F.log(u) / F.col("size")).alias("draw")).orderBy("draw").limit(n_ranges * sample_per_range)
    keys = sorted(r.key for r in drawn.select("key").collect())
    return sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []


def range_of(bounds: list[int], key: str = "key"):
    """How many boundaries are at most the key, by a two-level search over blocks of boundaries."""
    if not bounds:
        return F.lit(0)
    block = max(1, round(len(bounds) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    heads, whole = longs(bounds[::block]), longs(bounds)
    at_most = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(key)))
    before = F.greatest(at_most(heads) - 1, F.lit(0)) * block
    return before + at_most(F.slice(whole, before + 1, F.lit(block)))


def shard(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 16, cell_bytes: int = 64 << 20, cell_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts 16 bytes and has crc 0. Rows repeated in full are rows of their own, each with its slot; which of
    them gets which slot is open. A null doc_id is a value like any other. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = staged(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.xxhash64("doc_id", F.lit(1)).alias("tie")), "shard-records")
    n_ranges = n_shards * ranges_per_shard
    bounds = splitters(base, n_ranges)
    ranged = base.withColumn("range", range_of(bounds))
    loads = {r.range: (r.bytes, r.rows) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    total, rows = sum(b for b, _ in loads.values()), sum(n for _, n in loads.values())
    most_bytes, most_rows = max(1, min(cell_bytes, total // n_ranges)), max(1, min(cell_rows, rows // n_ranges))
    parts, byte_base, row_base, b0, n0 = [], [], [], 0, 0
    for r in range(len(bounds) + 1):
        b, n = loads.get(r, (0, 0))
        parts.append(max(1, -(-b // most_bytes), -(-n // most_rows)))
        byte_base.append(b0)
        row_base.append(n0)
        b0, n0 = b0 + b, n0 + n
    of_range = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("range") + 1)
    celled = ranged.withColumn("cell", F.pmod("tie", of_range(parts)))
    before = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "range", "cell",
        (of_range(byte_base) + F.coalesce(F.sum("bytes").over(before), F.lit(0))).alias("cell_byte"),
        (of_range(row_base) + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("cell_row"))
    inside = Window.partitionBy("range", "cell").orderBy("key", "tie", "doc_id")
    placed = staged(
        celled.join(cells, ["range", "cell"]).withColumn("nth", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", "size", "text_crc32", (F.col("cell_row") + F.col("nth") - 1).alias("rank"),
                F.least(F.lit(n_shards - 1), F.floor(((F.col("cell_byte") + F.col("upto") - F.col("size") / 2) * n_shards) / F.lit(max(total, 1))))
                .cast("int").alias("shard")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
