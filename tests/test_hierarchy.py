"""Parent chains: depth without a bound, cycles, missing parents, scopes."""

from daybook.functions.hierarchy import parent_chains
from daybook.operators.fact import stock_group_items, stock_group_tree


def test_deep_chain_and_cycles(spark):
    rows = [("A", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    rows += [("A", "x", "y"), ("A", "y", "x"), ("A", "under", "x"), ("A", "self", "self"), ("A", "lost", "nowhere"), ("B", "n39", "n1"), ("B", "n1", None)]
    nodes = spark.createDataFrame(rows, "company_id string, node string, parent string").selectExpr("*", "node AS name")
    got = {(r.company_id, r.node): r for r in parent_chains(nodes, ["company_id"], "/").collect()}
    assert len(got) == len(rows)
    assert (got["A", "n39"].root, got["A", "n39"].depth) == ("n0", 39) and got["A", "n39"].path == "/".join(f"n{i}" for i in range(40))
    assert (got["B", "n39"].root, got["B", "n39"].path) == ("n1", "n1/n39")
    assert {k for (_, k), r in got.items() if r.is_cyclic} == {"x", "y", "under"}
    assert all((got["A", k].root, got["A", k].path, got["A", k].depth) == (k, k, 0) for k in ("x", "y", "under", "self", "lost"))
    assert parent_chains(nodes.limit(0), ["company_id"]).collect() == []


def test_items_hang_under_their_group(spark):
    groups = spark.createDataFrame([("A", "Oils", "Primary"), ("A", "Hair Oils", "Oils"), ("A", None, "Oils")], "company_id string, name string, parent string")
    items = spark.createDataFrame([("A", "1", "Amla", "Hair Oils"), ("A", "2", "Bulk", "oils"), ("A", "3", "Stray", "None such"), ("A", "4", "Null", None)],
                                  "company_id string, source_object_id string, name string, parent string")
    tree = {r.name: (r.path, r.items) for r in stock_group_tree(groups.filter("name IS NOT NULL"), items).collect()}
    assert tree == {"Oils": ("Oils", 1), "Hair Oils": ("Oils > Hair Oils", 1)}
    leaves = {r.name: r.path for r in stock_group_items(groups.filter("name IS NOT NULL"), items).collect()}
    assert leaves == {"Amla": "Oils > Hair Oils", "Bulk": "Oils"}
