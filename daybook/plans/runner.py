"""Run one analysis, a lens, or the catalogue: verdict rows as one DataFrame."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cube import CITY, COMBO, COMPANY, GROUP, Cube
from .catalog import BY_ID, USER_ANALYSES, Entry, entries
from .thresholds import IDLE, LOW
from .verdict import Analysis


def run_one(cube: Cube, analysis_id: str, **params) -> Analysis:
    entry = BY_ID.get(analysis_id) or USER_ANALYSES[analysis_id]
    return entry.run(cube, **{**entry.params, **params})


def verdict_row(cube: Cube, entry: Entry, **params) -> DataFrame:
    """One verdict row; an empty book is not assessed (IDLE), never judged."""
    if cube.empty:
        body = cube.facts.sparkSession.range(1).select(
            F.lit(IDLE).alias("status"), F.lit(LOW).alias("severity"), F.lit(5).cast("bigint").alias("priority"),
            F.lit(0).cast("bigint").alias("fired"), F.lit(0).cast("bigint").alias("assessed"),
            F.lit(None).cast("double").alias("headline"), F.lit(None).cast("double").alias("coi"),
            F.lit("NOT ASSESSED").alias("evaluated"))
    else:
        body = entry.run(cube, **{**entry.params, **params}).verdict
    return body.select(F.lit(entry.id).alias("analysis_id"), F.lit(entry.lens).cast("bigint").alias("lens"),
                       F.lit(entry.slot).cast("bigint").alias("slot"), F.lit(entry.title).alias("title"), "*")


def run_many(cube: Cube, chosen: list[Entry], **params) -> DataFrame:
    return reduce(DataFrame.unionByName, [verdict_row(cube, e, **params) for e in chosen])


def run_lens(cube: Cube, lens: int, **params) -> DataFrame:
    return run_many(cube, [e for e in entries() if e.lens == lens], **params)


VERDICT_SCHEMA = ("analysis_id string, lens bigint, slot bigint, title string, status string, severity string, priority bigint, "
                  "fired bigint, assessed bigint, headline double, coi double, evaluated string")


def run_lenses(cube: Cube, lenses: list[int], parallel: int = 4, **params) -> DataFrame:
    """Verdicts of several lenses. Each lens is its own small job (one plan over all of them would be
    dominated by planning); the rows read back are one per catalogue entry, so their number is fixed.
    """
    spark = cube.facts.sparkSession
    if not cube.empty:
        for axis in (CITY, GROUP, COMPANY, COMBO):
            cube.all_members(axis)
    chosen = [[e for e in entries() if e.lens == lens] for lens in lenses]
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(lambda es: run_many(cube, es, **params).collect(), [es for es in chosen if es]))
    return spark.createDataFrame([tuple(r) for rows in parts for r in rows], VERDICT_SCHEMA)


def run_all(cube: Cube, **params) -> DataFrame:
    """Every verdict of the catalogue, users' own analyses included."""
    return run_lenses(cube, sorted({e.lens for e in entries()}), **params)
