"""Every registered query against its DuckDB twin (the driver's check).

A fast subset runs by default on sf0.001; CHURNLENS_FULL_ORACLE=1 runs every
key (at CHURNLENS_ORACLE_SF, default sf0.01).
"""

import os

import pytest

from churnlens.registry import all_queries, all_sql
from tests.harness import compare, duck

FAST = ["plan_summary", "plan_ticket_rate", "downgrade_risk", "tier_transitions", "downgrade_ticket_counts",
        "monthly_growth_churn", "duplicate_accounts", "activity_week_preview", "sessions_per_user_week",
        "feature_dau", "feature_retention", "onboarding_steps", "onboarding_funnel", "upsell_targets",
        "clean_customers", "clean_team", "null_profile", "table_shape", "kpi_overview", "churn_by_plan",
        "retention_by_fiscal_year", "trial_conversion", "table_previews", "export_clean_csv", "ttest_paid_free", "segment_summary",
        "dedupe_rows", "winsorized_features"]
FULL = os.environ.get("CHURNLENS_FULL_ORACLE") == "1"
SF = os.environ.get("CHURNLENS_ORACLE_SF", "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001")
KEYS = sorted(all_sql()) if FULL else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    r = compare(all_queries()[key](spark, SF), con, all_sql()[key])
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["plan_name", "plan_tier", "active_customers", "avg_monthly_revenue", "tickets_per_customer"]
