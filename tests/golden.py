"""A small book made by a rule: the live (city, product) cells over 14 months, April 2024 to May 2025.

What is expected of it comes from the SQL statements of ``checks``, which DuckDB answers over the same rows (``star``).
"""

from datetime import date
from decimal import Decimal

import duckdb
import pandas as pd

CITIES = ["Kochi", "Pune", "Lucknow", "Vizag"]
PRODUCTS = ["Clock", "Lamp", "Rug", "Tea", "Vase"]
MONTHS = 14
START = date(2024, 4, 15)
SCHEMA = ("voucher_id string, voucher_date date, city string, state string, grp string, item string, customer string, "
          "amount decimal(18,2), amount_with_charges decimal(18,2), is_return boolean")


def value(i: int, j: int, m: int) -> int:
    """Revenue of city i, product j in month m: a level, a drift that differs by city and product, a ripple, one hot season."""
    level = 9000 + 2600 * i + 1700 * j
    drift = (310, -240, 45, -520)[i] * m // (1 + j % 2)
    ripple = 350 * ((5 * m + 3 * i + 2 * j) % 7)
    season = 8000 if i == 2 and m in (7, 8) else 0
    fall = level // 2 if i == 3 and m > 6 else 0
    return level + drift + ripple + season - fall


def months():
    first = START.year * 12 + START.month - 1
    return [date((first + m) // 12, (first + m) % 12 + 1, START.day) for m in range(MONTHS)]


def live(i: int, j: int) -> bool:
    """Not every product sells in every city."""
    return (i + 2 * j) % 4 != 3


def rows(scale: int = 1):
    out = []
    for i, city in enumerate(CITIES):
        for j, product in enumerate(PRODUCTS):
            for m, day in enumerate(months()):
                if live(i, j):
                    amount = value(i, j, m) * scale
                    out.append((f"V{len(out)}", day, city, None, product, product, f"C-{city}", amount, amount, False))
    return out


def facts(spark, scale: int = 1):
    data = [(*r[:7], Decimal(r[7]), Decimal(r[8]), r[9]) for r in rows(scale)]
    return spark.createDataFrame(data, SCHEMA)


def series(place: int, name: str) -> list[int]:
    """Monthly totals of one city (place 2) or product (place 4)."""
    return [sum(r[7] for r in rows() if r[place] == name and r[1] == day) for day in months()]


def star() -> duckdb.DuckDBPyConnection:
    """The same rows as the star tables which the SQL statements read."""
    con = duckdb.connect()
    book = rows()
    frames = {
        "region": pd.DataFrame({"r_regionkey": [0], "r_name": ["Land"]}),
        "nation": pd.DataFrame({"n_nationkey": range(len(CITIES)), "n_name": CITIES, "n_regionkey": 0}),
        "customer": pd.DataFrame({"c_custkey": range(len(CITIES)), "c_name": [f"C-{x}" for x in CITIES], "c_nationkey": range(len(CITIES))}),
        "part": pd.DataFrame({"p_partkey": range(len(PRODUCTS)), "p_name": PRODUCTS, "p_brand": PRODUCTS}),
        "supplier": pd.DataFrame({"s_suppkey": [0], "s_name": ["S"]}),
        "orders": pd.DataFrame({"o_orderkey": range(len(book)), "o_custkey": [CITIES.index(r[2]) for r in book], "o_orderdate": [r[1] for r in book]}),
        "lineitem": pd.DataFrame({"l_orderkey": range(len(book)), "l_partkey": [PRODUCTS.index(r[4]) for r in book], "l_suppkey": 0,
                                  "l_extendedprice": [float(r[7]) for r in book], "l_returnflag": "N"}),
    }
    for name, frame in frames.items():
        con.register(f"{name}_frame", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_frame")
    return con
