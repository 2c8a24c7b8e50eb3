"""Dashboard KPIs (survey K1-K10).

The dashboard itself is not part of the analysed project, only its figures;
All are grouped aggregations over the domain tables; rates are
``round(part * 100 / whole, 2)`` with NULL for an empty whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.features import Cleaned, engagement_score, materialise
from churnlens.plans.joins import small
from churnlens.plans.quantiles import quantile_values
from churnlens.sources.bindings import Domain

CONVERSION_SHARE = 0.10   # share of engaged free customers assumed to convert
ENGAGED = 0.6             # engagement score above which a free customer is engaged
UPSELL_PLAN = "2-HIGH"    # plan whose price values a conversion


def _rate(part, whole):
    return F.round(F.try_divide(F.col(part).cast("double") * 100, F.col(whole)), 2)


def _subs_plans(d: Domain) -> DataFrame:
    return d.subscriptions().join(small(d.plans()), "plan_id", "left")


def _per_customer_trial(d: Domain) -> DataFrame:
    sp = _subs_plans(d)
    return sp.groupBy("customer_id").agg(
        F.max(F.col("trial_end_date").isNotNull().cast("int")).alias("trial"),
        F.max(F.coalesce(F.col("plan_tier") != "free", F.lit(False)).cast("int")).alias("paid"))


def trial_conversion(d: Domain) -> DataFrame:
    """K6: customers, trial users, trial users with a paid plan, and rates."""
    cu = d.customers().select("customer_id")
    j = cu.join(_per_customer_trial(d), "customer_id", "left")
    g = j.agg(F.count(F.lit(1)).alias("total_customers"),
              F.coalesce(F.sum("trial"), F.lit(0)).cast("long").alias("trial_users"),
              F.coalesce(F.sum(F.col("trial") * F.col("paid")), F.lit(0)).cast("long").alias("converted"))
    return g.select("*", _rate("converted", "trial_users").alias("conversion_rate"),
                    _rate("converted", "total_customers").alias("converted_share_of_customers"))


def kpi_overview(d: Domain) -> DataFrame:
    """K1 as (kpi, value) rows: revenue, MRR, customers, active, churned,
    churn rate, mean NPS, trial conversion, lost MRR and its share."""
    inv = d.billing_invoices().filter(F.col("status") == "paid").agg(
        F.sum("total_usd").cast("double").alias("total_revenue"))
    subs = d.subscriptions().agg(
        F.sum("mrr_usd").cast("double").alias("total_mrr"),
        F.sum(F.when(F.col("status") == "cancelled", F.col("mrr_usd"))).cast("double").alias("lost_mrr"))
    cus = d.customers().agg(
        F.count(F.lit(1)).cast("double").alias("total_customers"),
        F.sum(F.col("is_active").cast("int")).cast("double").alias("active_customers"),
        F.count("churned_at").cast("double").alias("churned_customers"),
        F.round(F.avg("nps_score"), 2).alias("avg_nps"))
    tc = trial_conversion(d).select(F.col("conversion_rate").alias("trial_conversion_rate"))

    def rows(df, names):
        return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).cast("double").alias("value"))
                                             for n in names])))
    derived_c = cus.select("*", _rate("churned_customers", "total_customers").alias("churn_rate"))
    derived_s = subs.select("*", _rate("lost_mrr", "total_mrr").alias("lost_mrr_share"))
    parts = [rows(inv, ["total_revenue"]),
             rows(derived_s, ["total_mrr", "lost_mrr", "lost_mrr_share"]),
             rows(derived_c, ["total_customers", "active_customers", "churned_customers", "churn_rate", "avg_nps"]),
             rows(tc, ["trial_conversion_rate"])]
    return reduce(DataFrame.unionByName, parts)


def churn_by_plan(d: Domain) -> DataFrame:
    """K2: cancelled subscriptions / subscriptions per plan."""
    g = _subs_plans(d).groupBy("plan_name").agg(
        F.count(F.lit(1)).alias("subscriptions"),
        F.sum((F.col("status") == "cancelled").cast("long")).alias("churned"))
    return g.select("*", _rate("churned", "subscriptions").alias("churn_rate"))


def churn_by_country(d: Domain) -> DataFrame:
    """K3: churned customers / customers per country."""
    g = d.customers().groupBy("country_name").agg(
        F.count(F.lit(1)).alias("customers"), F.count("churned_at").alias("churned"))
    return g.select("*", _rate("churned", "customers").alias("churn_rate"))


def churn_by_billing_cycle(d: Domain) -> DataFrame:
    """K4: cancelled subscriptions / subscriptions per billing cycle."""
    g = d.subscriptions().groupBy("billing_cycle").agg(
        F.count(F.lit(1)).alias("subscriptions"),
        F.sum((F.col("status") == "cancelled").cast("long")).alias("churned"))
    return g.select("*", _rate("churned", "subscriptions").alias("churn_rate"))


def retention_by_fiscal_year(d: Domain, start_month: int = 4) -> DataFrame:
    """K5: subscription cohorts by fiscal year of their start (the year
    starting in ``start_month``, assumption A4); retention = 100 - churn."""
    s = d.subscriptions()
    fy = F.year("start_date") - F.when(F.month("start_date") < start_month, 1).otherwise(0)
    label = F.concat(F.lit("FY"), fy.cast("string"), F.lit("-"), F.lpad(((fy + 1) % 100).cast("string"), 2, "0"))
    g = s.groupBy(label.alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        F.sum((F.col("status") == "cancelled").cast("long")).alias("churned"))
    g = g.select("*", _rate("churned", "subscriptions").alias("churn_rate"))
    return g.withColumn("retention_rate", F.round(100 - F.col("churn_rate"), 2))


def mrr_by_plan(d: Domain) -> DataFrame:
    """K7: MRR per plan, per customer, lost MRR (cancelled) and its share."""
    g = _subs_plans(d).groupBy("plan_name").agg(
        F.sum("mrr_usd").cast("double").alias("total_mrr"),
        F.count_distinct("customer_id").alias("customers"),
        F.coalesce(F.sum(F.when(F.col("status") == "cancelled", F.col("mrr_usd"))), F.lit(0)).cast("double").alias("lost_mrr"))
    return g.select("plan_name", F.round("total_mrr", 2).alias("total_mrr"), "customers",
                    F.round(F.try_divide(F.col("total_mrr"), F.col("customers")), 2).alias("mrr_per_customer"),
                    F.round("lost_mrr", 2).alias("lost_mrr"), _rate("lost_mrr", "total_mrr").alias("lost_mrr_share"))


def nps_by_plan(d: Domain) -> DataFrame:
    """K8: mean NPS of the customers holding each plan (each customer once)."""
    cp = _subs_plans(d).select("customer_id", "plan_name").distinct()
    j = cp.join(d.customers().select("customer_id", "nps_score"), "customer_id")
    return j.groupBy("plan_name").agg(F.round(F.avg("nps_score"), 2).alias("avg_nps"),
                                      F.count("nps_score").alias("respondents"))


def churn_by_engagement_band(d: Domain) -> DataFrame:
    """K9: customers cut into low/mid/high engagement at the exact 1/3 and
    2/3 quantiles of the score; churned customers / customers per band."""
    sc = materialise(engagement_score(Cleaned(d)).select("customer_id", "engagement_score"))
    q = quantile_values(sc, "engagement_score", {"t1": 1 / 3, "t2": 2 / 3})
    band = (F.when(F.col("engagement_score") <= F.lit(q["t1"]), "low")
            .when(F.col("engagement_score") <= F.lit(q["t2"]), "mid")
            .when(F.col("engagement_score").isNotNull(), "high"))
    j = sc.join(d.customers().select("customer_id", "churned_at"), "customer_id")
    g = j.groupBy(band.alias("engagement_band")).agg(
        F.count(F.lit(1)).alias("customers"), F.count("churned_at").alias("churned"))
    return g.select("*", _rate("churned", "customers").alias("churn_rate"))


def revenue_opportunity(d: Domain) -> DataFrame:
    """K10: customers whose latest subscription is on the free tier, those
    with engagement above 0.6, and the MRR if 10 % of them took the
    upsell plan."""
    latest = _subs_plans(d).groupBy("customer_id").agg(
        F.max_by("plan_tier", F.struct("start_date", "subscription_id")).alias("tier"))
    free = latest.filter(F.col("tier") == "free")
    sc = engagement_score(Cleaned(d)).select("customer_id", "engagement_score")
    j = free.join(sc, "customer_id", "left")
    price = d.plans().where(F.col("plan_id") == UPSELL_PLAN).agg(F.max("monthly_price_usd").cast("double")).first()[0] or 0.0
    g = j.agg(F.count(F.lit(1)).alias("free_customers"),
              F.coalesce(F.sum((F.col("engagement_score") > ENGAGED).cast("long")), F.lit(0)).alias("engaged_free_customers"))
    return g.select("*", _rate("engaged_free_customers", "free_customers").alias("engaged_share"),
                    F.round(F.col("engaged_free_customers") * CONVERSION_SHARE * price, 2).alias("potential_mrr"))

