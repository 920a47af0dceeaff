"""Registered queries against their SQL on the smallest tables, a few per family."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
NAMES = """T01_decline_streak_city T17_rank_stability_city K02_ranking_scale_gap_city K11_hhi_register_group K21_top_n_combos_5
B01_red_flags_group R10_rank_revenue_divergence_product V01_peak_trough_register_group G09_dominant_counterpart_city
A12_run_lens_10 E03_resolve_voucher_type E06_parse_city J02_build_fact_sales J06_dedupe_rows
L06_register_by_party H01_dashboard_kpis Q03_reconcile_vouchers F08_item_ranking_by_city F00_executive_overview S04_normalize_sales_vouchers
M01_upsert_by_hash M05_cdc_stream M08_streaming_register""".split()


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import __spark_entry__ as entry
    from checks.compare import compare, connect

    ok, message, rows = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert ok, message
    assert rows > 0


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
