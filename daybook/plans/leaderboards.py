"""The two ranked dashboards over verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .thresholds import CRITICAL, HIGH, IDLE, MEDIUM

# Lenses whose findings a sales manager can act on directly.
ACTIONABLE_LENSES = (1, 3, 4, 6, 7, 8, 10, 11, 13, 14, 15)


def _persistence() -> Column:
    """1..5, from "<n> months" in the verdict text; 3 when none is named; at least 4 if critical."""
    months = F.expr(r"try_cast(nullif(regexp_extract(evaluated, '(?i)(\\d+)\\s*month', 1), '') as int)")
    base = F.when(months.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), months))).otherwise(F.lit(3))
    return F.when(F.col("severity") == CRITICAL, F.greatest(base, F.lit(4))).otherwise(base)


def _ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def owner_top5(verdicts: DataFrame) -> DataFrame:
    weight = F.when(F.col("severity") == CRITICAL, 4).when(F.col("severity") == HIGH, 3).when(
        F.col("severity") == MEDIUM, 2).otherwise(1)
    d = verdicts.filter(F.col("status") != IDLE).withColumn("severity_score", weight).withColumn("persistence", _persistence())
    both = (F.col("severity_score") >= 4) & (F.col("persistence") >= 4)
    d = d.withColumn("score", (F.col("severity_score") * F.col("persistence") * F.when(both, 3).otherwise(2)).cast("bigint"))
    d = d.withColumn("financial_impact", F.round(F.coalesce("coi", F.lit(0.0)) * 6, 2))
    order = [F.desc("score"), F.desc(F.coalesce("coi", F.lit(0.0))), F.asc("analysis_id")]
    return _ranked(d, order, 5).select("rank", "analysis_id", "status", "severity", "score", "financial_impact")


def manager_top10(verdicts: DataFrame) -> DataFrame:
    """Impact in thousands x recency x persistence x actionability."""
    nonzero = F.when(F.col("headline") != 0, F.abs("headline"))
    impact = F.greatest(F.lit(100.0), F.coalesce("coi", nonzero, F.lit(1000.0)))
    recency = F.when(F.col("severity") == CRITICAL, 5).otherwise(4)
    action = F.when(F.col("lens").isin(*ACTIONABLE_LENSES), 5).otherwise(4)
    d = verdicts.filter(F.col("status") != IDLE).withColumn("impact", impact).withColumn(
        "score", F.round(F.col("impact") / 1000 * recency * _persistence() * action, 4))
    order = [F.desc("score"), F.desc("impact"), F.asc("analysis_id")]
    return _ranked(d, order, 10).select("rank", "analysis_id", "status", "severity", F.round("impact", 2).alias("impact"), "score")
