"""Exact ranks, running sums and "top n + rest" without sorting a group in one task.

A plain ``row_number().over(orderBy(x))`` sends the whole group to one task. Here
every row first falls into a magnitude bucket (a fixed, monotone function of the
value, about 2,000 buckets at most); bucket sizes are aggregated map-side, their
prefix sums are a table of at most that many rows per group, and the row-level
sort happens inside (group, bucket). The result is the same rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_DOUBLING = 16


def magnitude_bucket(value: Column) -> Column:
    """Monotone integer level of a value: larger values get smaller (or equal) numbers."""
    v = value.cast("double")
    level = F.floor(F.log2(F.when(v != 0, F.abs(v))) * STEPS_PER_DOUBLING).cast("int")
    return F.when(v > 0, -level).when(v < 0, F.lit(20_000) + level).otherwise(F.lit(10_000))


def ranked(
    df: DataFrame,
    value: str,
    tie: tuple[str, ...] = (),
    by: tuple[str, ...] = (),
    name: str = "rank",
    competition: bool = False,
    running: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Rank rows by ``value`` (largest first) inside each ``by`` group.

    Ordinal ranks break ties with the ``tie`` columns ascending; ``competition``
    gives equal values the same rank (1224). ``running`` names a column whose
    running sum in rank order is added as ``<running>_running``.
    """
    sign = -1 if ascending else 1
    key = (F.col(value) * sign).alias("_k")
    d = df.withColumn("_k", key).withColumn("_b", magnitude_bucket(F.col("_k")))
    aggs = [F.count(F.lit(1)).alias("_n")]
    if running:
        aggs.append(F.sum(running).alias("_s"))
    sizes = d.groupBy(*by, "_b").agg(*aggs)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_s").over(before).alias("_s_before")] if running else []),
    )
    order = [F.col("_k").desc(), *([] if competition else [F.col(t).asc() for t in tie])]
    local = Window.partitionBy(*by, "_b").orderBy(*order)
    position = F.rank().over(local) if competition else F.row_number().over(local)
    out = d.join(offsets, [*by, "_b"]).withColumn(name, (F.col("_before") + position).cast("bigint"))
    if running:
        run = F.sum(running).over(local.rowsBetween(Window.unboundedPreceding, 0))
        zero = F.lit(0)
        out = out.withColumn(f"{running}_running", F.coalesce(F.col("_s_before"), zero) + run)
    return out.drop("_k", "_b", "_before", "_s_before")


def rank_with_other(
    df: DataFrame, label: str, amount: str, n: int, by: tuple[str, ...] = (), other: str = "Other"
) -> DataFrame:
    """The n largest rows, and one remainder row carrying how many others there are and their sum."""
    r = ranked(df, amount, (label,), by)
    top = r.filter(F.col("rank") <= n).select(*by, "rank", label, amount, F.lit(1).cast("bigint").alias("members"))
    rest = (
        r.filter(F.col("rank") > n)
        .groupBy(*by)
        .agg(F.sum(amount).alias(amount), F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 0)
        .select(*by, F.lit(n + 1).cast("bigint").alias("rank"), F.lit(other).alias(label), amount, "members")
    )
    return top.unionByName(rest)
