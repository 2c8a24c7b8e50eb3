"""Query registry: survey key -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnlens.sources.bindings import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Domain(spark, sf_dir))
        QUERIES[name].__name__ = name
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


def _register():
    from churnlens.operators import reports as R

    query("plan_summary")(R.plan_summary)
    query("plan_ticket_rate")(R.plan_ticket_rate)
    query("ltv_rank")(R.ltv_rank)
    query("downgrade_risk")(R.q_downgrade_risk)
    query("subscription_history")(R.subscription_history)
    query("tier_transitions")(R.tier_transitions)
    query("downgrades_all")(R.downgrades_all)
    query("downgrade_ticket_counts")(R.downgrade_ticket_counts)
    query("monthly_growth_churn")(R.monthly_growth_churn)
    query("duplicate_accounts")(R.duplicate_accounts)

    from churnlens.operators import activity as A

    query("activity_week_preview")(A.q_week_preview)
    query("sessions_per_user_week")(A.q_sessions)
    query("feature_dau")(A.q_dau)
    query("feature_retention")(A.q_retention)
    query("onboarding_steps")(A.q_onboarding_steps)
    query("onboarding_funnel")(A.q_onboarding_funnel)
    query("onboarding_funnel_nested")(A.q_onboarding_funnel_nested)
    query("upsell_targets")(A.q_upsell)
    query("upsell_company_details")(A.q_upsell_details)

    from churnlens.operators import quality as Q

    query("clean_activity")(Q.q_clean_activity)
    query("clean_surveys")(Q.q_clean_surveys)
    query("clean_onboarding")(Q.q_clean_onboarding)
    query("clean_customers")(Q.q_clean_customers)
    query("clean_plans")(Q.q_clean_plans)
    query("clean_team")(Q.q_clean_team)
    query("clean_subscriptions")(Q.q_clean_subscriptions)
    query("clean_billing")(Q.q_clean_billing)
    query("clean_features")(Q.q_clean_features)
    query("null_profile")(Q.q_null_profile)
    query("duplicate_profile")(Q.q_duplicate_profile)
    query("table_shape")(Q.q_table_shape)
    query("table_preview")(Q.q_table_preview)
    query("table_previews")(Q.q_table_previews)

    from churnlens.operators import features as FE

    query("activity_enriched")(FE.q_activity_enriched)
    query("engagement_by_customer")(FE.q_engagement_by_customer)
    query("engagement_score")(FE.q_engagement_score)
    query("dedupe_rows")(FE.q_dedupe_rows)
    query("calendar_features")(FE.q_calendar_features)
    query("customer_features")(FE.q_customer_features)
    query("winsorized_features")(FE.q_winsorized)
    query("scaled_features")(FE.q_scaled)

    from churnlens.operators import segments as SG
    from churnlens.operators import stats as ST

    query("ttest_engagement_churn")(ST.q_ttest_churn)
    query("ttest_paid_free")(ST.q_ttest_paid_free)
    query("customer_segments")(SG.q_segments)
    query("segment_summary")(SG.q_segment_summary)
    query("export_clean_csv")(Q.q_export_clean_csv)

    from churnlens.operators import kpis as K

    query("kpi_overview")(K.kpi_overview)
    query("churn_by_plan")(K.churn_by_plan)
    query("churn_by_country")(K.churn_by_country)
    query("churn_by_billing_cycle")(K.churn_by_billing_cycle)
    query("retention_by_fiscal_year")(K.retention_by_fiscal_year)
    query("trial_conversion")(K.trial_conversion)
    query("mrr_by_plan")(K.mrr_by_plan)
    query("nps_by_plan")(K.nps_by_plan)
    query("churn_by_engagement_band")(K.churn_by_engagement_band)
    query("revenue_opportunity")(K.revenue_opportunity)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not QUERIES:
        _register()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from churnlens.oracle.queries import SQL
    keys = all_queries().keys()
    return {k: v for k, v in SQL.items() if k in keys}
