"""The driver's star tables as the domain's fact and dimension frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.cube import Cube, build_cube

MONEY = "decimal(18,2)"
_cubes: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's city (nation) and state (region): narrow, one row per voucher."""
    o = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
    who = cust.join(place, cust.c_nationkey == place.n_nationkey, "left").select(
        "c_custkey", F.col("c_name").alias("customer"), "city", "state")
    return o.join(who, o.o_custkey == who.c_custkey, "left").select(
        F.col("o_orderkey").alias("voucher_id"), F.col("o_orderdate").cast("date").alias("voucher_date"),
        F.col("o_totalprice").cast(MONEY).alias("header_amount"), "o_orderpriority", "o_orderstatus",
        "customer", "city", "state")


def sales_facts(spark: SparkSession, sf_dir: str, salesman: bool = False) -> DataFrame:
    """One row per line item. Dimensions a query does not read are pruned with their joins' columns."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("grp"), F.col("p_name").alias("item"))
    h = headers(spark, sf_dir)
    f = li.join(h, li.l_orderkey == h.voucher_id).join(p, li.l_partkey == p.p_partkey, "left")
    cols = [
        "voucher_id", "voucher_date", "customer", "city", "state", "grp", "item",
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        (F.col("l_extendedprice").cast(MONEY) * (1 + F.col("l_tax").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")))
        .cast(MONEY).alias("amount_with_charges"),
        F.col("l_quantity").cast("decimal(18,3)").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("is_return"),
    ]
    if salesman:
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("salesman"))
        f = f.join(sup, f.l_suppkey == sup.s_suppkey, "left")
        cols.append("salesman")
    return f.select(*cols)


def sales_cube(spark: SparkSession, sf_dir: str, salesman: bool = False, **options) -> Cube:
    """The cube of a scale factor; its cuboid stays cached in the session for the queries that share it."""
    key = (spark.sparkContext.applicationId, sf_dir, salesman, tuple(sorted(options.items())))
    if key not in _cubes:
        _cubes[key] = build_cube(sales_facts(spark, sf_dir, salesman), **options)
    return _cubes[key]


def forget_cubes() -> None:
    for cube in _cubes.values():
        cube.release()
    _cubes.clear()
