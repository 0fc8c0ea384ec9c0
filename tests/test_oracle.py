"""Registered queries against their DuckDB oracles. All of them with STALLKEEPER_ALL=1, otherwise one or two per family."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import check, duck  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "funnel_by_segment", "pr07_stock_status", "pr08_age_band", "jn04_offer_positions", "jn07_reconcile_outer", "jn08_interval_join_week",
    "jn09_topic_pattern_join", "jn13_fan_out_offers", "jn15_access_decision", "ag07_sales_velocity", "ag15_column_mean_median", "ag17_table_summary",
    "wn02_running_balance", "wn04_prior_avg_price", "wn05_sessionize", "wn08_sequence_ids", "tk05_sample_k_per_key", "fn21_promo_multiplier",
    "fn36_conversion_probability", "rn09_weighted_sample_no_replace", "rn12_weighted_date", "tb08_build_views", "tb12_build_sales",
    "iv02_greedy_allocate", "iv05_plan_restocks", "dq03_customer_id_duplicated", "dq38_sold_out_of_stock", "sch01_schema_profile",
    "src01_csv_scan", "st05_session_stream",
]


def test_every_query_is_callable_and_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("STALLKEEPER_ALL") else SOME)
def test_matches_oracle(spark, name):
    text, _, _, good = check(spark, duck(FOLDER), FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, text
