"""Metric -> status, severity, priority; and the block verdict over many rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .thresholds import AMBER, CRITICAL, GREEN, HIGH, IDLE, LOW, MEDIUM, RED, Threshold, resolve

STATUS_ORDER = (IDLE, GREEN, AMBER, RED)
SEVERITY_ORDER = (LOW, MEDIUM, HIGH, CRITICAL)


@dataclass
class Analysis:
    """What one analysis yields: its table and its one-row verdict."""

    table: DataFrame
    verdict: DataFrame


def _banded(metric: Column, threshold: Threshold, field: int, base: str) -> Column:
    out = F.lit(base)
    for band in threshold.bands:
        hit = metric < band[0] if threshold.lower_is_worse else metric >= band[0]
        out = F.when(hit, F.lit(band[field])).otherwise(out)
    return out


def status_of(metric: Column, threshold: str | Threshold) -> Column:
    """NULL metric -> IDLE (not assessed), which is not the same as GREEN."""
    spec = resolve(threshold)
    return F.when(metric.isNull(), F.lit(IDLE)).otherwise(_banded(metric, spec, 1, GREEN))


def severity_of(metric: Column, threshold: str | Threshold) -> Column:
    spec = resolve(threshold)
    return F.when(metric.isNull(), F.lit(LOW)).otherwise(_banded(metric, spec, 2, LOW))


def priority_of(status: Column, severity: Column) -> Column:
    return (
        F.when(status == IDLE, 5)
        .when((status == RED) & (severity == CRITICAL), 1)
        .when(status == RED, 2)
        .when(status == AMBER, 3)
        .otherwise(4)
        .cast("bigint")
    )


def rank_in(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for i, name in enumerate(order):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def _name_at(rank: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), rank + 1)


def verdict(df: DataFrame, metric: Column, threshold: str | Threshold) -> DataFrame:
    """Append status, severity, priority and fired to every row."""
    status, severity = status_of(metric, threshold), severity_of(metric, threshold)
    return (
        df.withColumn("status", status)
        .withColumn("severity", severity)
        .withColumn("priority", priority_of(F.col("status"), F.col("severity")))
        .withColumn("fired", F.col("status").isin(AMBER, RED))
    )


def worst_of(df: DataFrame, *extra: Column) -> DataFrame:
    """One row: the worst status (then severity) any row reached, with counts."""
    worst = df.agg(
        F.max(F.struct(rank_in(F.col("status"), STATUS_ORDER).alias("st"),
                       rank_in(F.col("severity"), SEVERITY_ORDER).alias("sv"))).alias("w"),
        F.count_if(F.col("status").isin(AMBER, RED)).alias("fired"),
        F.count_if(F.col("status") != IDLE).alias("assessed"),
        *extra,
    )
    assessed = F.col("assessed") > 0
    status = F.when(assessed, _name_at(F.col("w.st"), STATUS_ORDER)).otherwise(F.lit(IDLE))
    severity = F.when(assessed, _name_at(F.col("w.sv"), SEVERITY_ORDER)).otherwise(F.lit(LOW))
    kept = [c for c in worst.columns if c not in ("w", "fired", "assessed")]
    return worst.select(status.alias("status"), severity.alias("severity"), "fired", "assessed", *kept)


def _finish(df: DataFrame, noun: str | None) -> DataFrame:
    if noun:
        text = (
            F.when(F.col("fired") > 0, F.concat(F.lit("TRIGGERED: "), F.col("fired"), F.lit(" of "),
                                                F.col("assessed"), F.lit(f" {noun} breached")))
            .when(F.col("assessed") == 0, F.lit("NOT ASSESSED"))
            .otherwise(F.concat(F.lit("NOT TRIGGERED: all "), F.col("assessed"), F.lit(f" {noun} within tolerance")))
        )
    else:
        text = (
            F.when(F.col("status") == IDLE, F.lit("NOT ASSESSED"))
            .when(F.col("fired") > 0, F.lit("TRIGGERED"))
            .otherwise(F.lit("NOT TRIGGERED"))
        )
    return df.select(
        "status",
        "severity",
        priority_of(F.col("status"), F.col("severity")).alias("priority"),
        F.col("fired").cast("bigint").alias("fired"),
        F.col("assessed").cast("bigint").alias("assessed"),
        F.col("headline").cast("double").alias("headline"),
        F.col("coi").cast("double").alias("coi"),
        text.alias("evaluated"),
    )


def per_row(rows: DataFrame, metric: Column, threshold: str | Threshold, *, noun: str,
            headline: Column, coi: Column | None = None) -> Analysis:
    """Every row is judged; the block takes the worst."""
    table = rows.withColumn("status", status_of(metric, threshold)).withColumn(
        "severity", severity_of(metric, threshold)
    )
    none = F.lit(None).cast("double")
    block = worst_of(table, headline.alias("headline"), (none if coi is None else coi).alias("coi"))
    return Analysis(table, _finish(block, noun))


def single(table: DataFrame, facts: DataFrame, metric: Column, threshold: str | Threshold, *,
           headline: Column, coi: Column | None = None) -> Analysis:
    """One metric, computed in the one-row frame ``facts``, decides the block."""
    status = status_of(metric, threshold)
    none = F.lit(None).cast("double")
    block = facts.select(
        status.alias("status"),
        severity_of(metric, threshold).alias("severity"),
        status.isin(AMBER, RED).cast("bigint").alias("fired"),
        (status != IDLE).cast("bigint").alias("assessed"),
        headline.alias("headline"),
        (none if coi is None else coi).alias("coi"),
    )
    return Analysis(table, _finish(block, None))


def contract_violations(verdicts: DataFrame) -> DataFrame:
    """Verdict rows that break the contract, with the rule they break."""
    def bad(col: str) -> Column:
        return F.isnan(F.col(col)) | F.col(col).isin(float("inf"), float("-inf"))

    rules = [
        (~F.col("analysis_id").rlike(r"^L\d{2}\.A\d{2}$"), "bad id"),
        ((F.col("lens") < 0) | (F.col("lens") > 17), "lens out of range"),
        (F.col("slot") < 1, "slot not positive"),
        (~F.col("status").isin(*STATUS_ORDER), "unknown status"),
        (~F.col("severity").isin(*SEVERITY_ORDER), "unknown severity"),
        (~F.col("priority").between(1, 5), "priority out of range"),
        (F.coalesce(bad("headline"), F.lit(False)), "headline not finite"),
        (F.coalesce(bad("coi"), F.lit(False)), "coi not finite"),
    ]
    problems = F.array_compact(F.array(*[F.when(cond | cond.isNull(), F.lit(name)) for cond, name in rules]))
    return (
        verdicts.withColumn("problems", problems)
        .filter(F.size("problems") > 0)
        .select("analysis_id", F.explode("problems").alias("problem"))
    )
