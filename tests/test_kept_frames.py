"""Frames that many analyses read are few partitions, without the fact plan behind them."""

from datetime import date

from pyspark.sql import functions as F

from daybook.operators.comparison import rank_matrix
from daybook.operators.concentration import hhi_cells
from daybook.operators.cube import CITY, COMBO, COMPANY, GROUP, build_cube


def book(spark):
    return spark.range(400).select(
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("voucher_date"), F.concat(F.lit("c"), F.col("id") % 5).alias("city"),
        F.concat(F.lit("g"), F.col("id") % 3).alias("grp"), F.lit("i").alias("item"), F.lit("p").alias("customer"),
        (F.col("id") + 1).cast("decimal(18,2)").alias("amount"), F.lit(False).alias("is_return"))


def test_kept_frames_do_not_have_a_task_for_each_shuffle_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cube = build_cube(book(spark))
        frames = [cube.cells, *[cube.all_members(a) for a in (CITY, GROUP, COMPANY, COMBO)], hhi_cells(cube, CITY), rank_matrix(cube).cells, rank_matrix(cube).entities]
        assert max(f.rdd.getNumPartitions() for f in frames) <= 8
        assert cube.company().first().total == 400 * 401 / 2
        assert cube.members(CITY).count() == 5
        assert cube.all_members(CITY) is cube.all_members(CITY)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
