"""Sixteen invariants of a cube, each side computed from a different input.

Right-hand totals come from the fact table, not from the cube being checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import live_series as S
from ..functions.numeric import ratio
from ..functions.live_series import s
from .concentration import combo_order
from .cube import CITY, COMBO, GROUP, Cube, cube_meta, month_index, signed_amount

TOLERANCE = 0.01
c = F.col


def _row(df: DataFrame, cid: str, name: str, expected: Column, actual: Column, tolerance: float = TOLERANCE) -> DataFrame:
    e, a = expected.cast("double"), actual.cast("double")
    gap = F.round(a - e, 6)
    return df.select(F.lit(cid).alias("id"), F.lit(name).alias("check"), F.round(e, 6).alias("expected"),
                     F.round(a, 6).alias("actual"), gap.alias("variance"),
                     F.when(F.abs(gap) <= tolerance, "PASS").otherwise("FAIL").alias("status"))


def verify_cube(cube: Cube) -> DataFrame:
    idx = month_index(c("month"), cube.start)
    first, final = idx == 0, idx == cube.n - 1
    v = signed_amount(cube.measure, cube.net_returns)
    on_axis = cube.facts.filter(idx.between(0, cube.n - 1))
    fact = on_axis.agg(
        F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias("total"),
        F.coalesce((F.sum(F.when(final, v)) - F.sum(F.when(first, v))).cast("double"), F.lit(0.0)).alias("delta"),
        F.countDistinct(F.when(v != 0, c("city"))).alias("cities")).persist()
    total = lambda: fact.select("total").scalar()
    sum_of = lambda df, col="total": df.agg(F.coalesce(F.sum(col), F.lit(0)).cast("double").alias("x"))
    city, group, combo = cube.all_members(CITY), cube.all_members(GROUP), cube.all_members(COMBO)
    months, series = cube.months(), lambda df: df.select(F.explode("s.v").alias("total"))
    by_dim = lambda key: combo.groupBy(key).agg(F.sum("total").alias("total"))
    share = lambda df: df.select(ratio(c("total"), F.lit(cube.total)).alias("sh"))
    meta = cube_meta(cube)

    out_of_bounds = (c("h") < 1.0 / c("n") - 1e-9) | ((c("h") > 1.0 + 1e-9) & (c("lowest") >= 0))
    hhi = group.agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("lowest"),
                    F.sum(ratio(c("total"), F.lit(cube.total)) * ratio(c("total"), F.lit(cube.total))).alias("h"))
    peak_ok = (S.peak(s()) >= c("total") / cube.n - 1e-6) & (c("total") / cube.n >= S.trough(s()) - 1e-6)
    top5 = combo.filter(c("total") > 0).orderBy(*combo_order()).limit(5)
    positive = combo.agg(F.sum(F.when(c("total") > 0, c("total"))).alias("p"))

    rows = [
        _row(sum_of(months, "revenue"), "CV01", "periods sum to the total", total(), c("x")),
        _row(sum_of(city), "CV02", "cities sum to the total", total(), c("x")),
        _row(sum_of(group), "CV03", "products sum to the total", total(), c("x")),
        _row(sum_of(by_dim("city")), "CV04", "city x product sums to the total", total(), c("x")),
        _row(sum_of(by_dim("grp")), "CV05", "product x city sums to the total", total(), c("x")),
        _row(sum_of(series(city)), "CV06", "city x period sums to the total", total(), c("x")),
        _row(sum_of(series(group)), "CV07", "product x period sums to the total", total(), c("x")),
        _row(group.agg(F.sum(S.last(s()) - S.at(s(), 0)).alias("x")), "CV08", "product changes sum to the company change",
             fact.select("delta").scalar(), c("x")),
        _row(hhi, "CV09", "HHI lies between 1/N and 1", F.lit(0), out_of_bounds.cast("int")),
        _row(share(city).agg(F.sum("sh").alias("x")), "CV10", "city shares sum to one", F.lit(1), c("x")),
        _row(city.agg(F.countDistinct("city").alias("x")), "CV11", "each city appears once", fact.select("cities").scalar(), c("x")),
        _row(group.agg(F.count_if(~peak_ok).alias("x")), "CV12", "peak >= mean >= trough", F.lit(0), c("x")),
        _row(fact, "CV13", "revenue after returns is not negative", F.lit(0), F.least(c("total"), F.lit(0.0))),
        _row(months.agg(F.count_if(c("period") != F.date_format(F.add_months(F.lit(cube.start), c("idx").cast("int")), "yyyy-MM"))
                         .alias("x")), "CV14", "period keys ascend without gaps", F.lit(0), c("x")),
        _row(top5.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("x")), "CV15", "top five do not exceed positive revenue",
             F.lit(0), F.greatest(c("x") - positive.select("p").scalar(), F.lit(0.0))),
        _row(meta, "CV16", "every input row is accounted for", c("rows_in"), c("rows_counted") + c("rows_off_axis") + c("rows_zero")),
    ]
    return reduce(DataFrame.unionByName, rows)
