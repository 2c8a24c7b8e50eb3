"""Activity pipelines: weekly sessions and session-length percentiles, daily
active users per feature, 7-day feature retention, the onboarding funnel and
upsell targets (survey Q11-Q18).

Inputs are activity records with ``customer_id, member_id, event_type,
session_duration_sec, timestamp, subscription_tier``; ``timestamp`` may be text
(parsed strictly, as the pipelines' date conversion fails on bad text) or a
timestamp.  Every aggregation is a plain ``groupBy`` (partial aggregation
first), percentiles use the mergeable ``percentile_approx`` sketch, and no
per-group array is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.exprs import day_text, days_between, parse_ts_strict, safe_div, seconds_between, sunday_week
from churnlens.sources.bindings import Domain

# The onboarding steps of the funnel, in order, and the output
# names of their flags and gaps.
FUNNEL_STEPS = ["signup", "first_login", "workspace_created", "first_project", "invited_teammate"]
STEP_FLAGS = ["did_signup", "did_first_login", "did_workspace", "did_project", "did_teammate"]
STEP_TOTALS = ["signup", "first_login", "workspace_created", "first_project", "invited_teammate"]
GAP_NAMES = ["signup_to_login", "login_to_workspace", "workspace_to_project", "project_to_teammate"]
# The driver's events carry five event types; the registered funnel maps the
# five stages onto them in this order (FIXTURES.md parameters).
BOUND_STEPS = ["signup", "view", "click", "purchase", "error"]

# Upsell priority labels (with their leading blanks) and bounds.
HIGH, MEDIUM, MONITOR = " HIGH PRIORITY", "MEDIUM PRIORITY", " MONITOR"

PERCENTILE_ACCURACY = 100000


def with_ts(activity: DataFrame) -> DataFrame:
    return activity.withColumn("_ts", parse_ts_strict("timestamp"))


# ------------------------------------------------------------------------- Q11
def activity_week_preview(activity: DataFrame, n: int = 2) -> DataFrame:
    """customer, timestamp, Sunday-based week and year of the first ``n``
    records (ordered by time, then customer, so the preview is stable)."""
    a = with_ts(activity)
    return (a.select("customer_id", F.col("_ts").alias("timestamp"),
                     sunday_week("_ts").alias("week"), F.year("_ts").alias("year"))
            .orderBy("timestamp", "customer_id").limit(n))


# ------------------------------------------------------------------------- Q12
def sessions_per_user_week(activity: DataFrame, accuracy: int = PERCENTILE_ACCURACY) -> DataFrame:
    """Per tier: mean records per customer-week (weeks Sunday-based, with
    year) and the 25/50/75th percentile of session length over all records."""
    a = with_ts(activity)
    weekly = a.groupBy("customer_id", "subscription_tier", sunday_week("_ts").alias("week"),
                       F.year("_ts").alias("year")).agg(F.count(F.lit(1)).alias("sessions"))
    per_tier = weekly.groupBy("subscription_tier").agg(
        F.bround(F.avg("sessions"), 2).alias("avg_sessions_per_user_per_week"))
    pct = a.groupBy(F.col("subscription_tier").alias("_tier")).agg(
        F.percentile_approx("session_duration_sec", [0.25, 0.5, 0.75], accuracy).alias("_p"))
    j = per_tier.join(pct, per_tier["subscription_tier"].eqNullSafe(pct["_tier"]), "left")
    return j.select("subscription_tier", "avg_sessions_per_user_per_week",
                    F.col("_p")[0].alias("p25_session_duration"),
                    F.col("_p")[1].alias("p50_session_duration"),
                    F.col("_p")[2].alias("p75_session_duration"))


# ------------------------------------------------------------------------- Q13
def feature_dau(activity: DataFrame) -> DataFrame:
    """Distinct customers per feature per day (a missing customer counts as
    one user, as a grouping key would)."""
    a = with_ts(activity)
    distinct = a.select(F.col("event_type").alias("feature"), day_text("_ts").alias("day"), "customer_id").distinct()
    return (distinct.groupBy("feature", "day").agg(F.count(F.lit(1)).alias("daily_active_users"))
            .orderBy("day", "feature"))


# ------------------------------------------------------------------------- Q14
def feature_retention(activity: DataFrame, days: int = 7) -> DataFrame:
    """Per feature: customers, those who used it again after their first use
    and within ``days`` days of it, and the rate in %.

    The records are reduced to the first and last use of each (customer,
    feature, day) before the shuffle.  A use counts if the first day has a later
    one, or if the next day with any begins in time.  The window orders the days
    of one customer and feature, so the calendar bounds it."""
    a = with_ts(activity).select("customer_id", F.col("event_type").alias("feature"), "_ts")
    per_day = a.groupBy("customer_id", "feature", F.to_date("_ts").alias("_day")).agg(
        F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    w = Window.partitionBy("customer_id", "feature").orderBy(F.col("_day").asc_nulls_last())
    by_day = per_day.withColumns({"_next": F.lead("_first").over(w), "_rn": F.row_number().over(w)})
    again = ((F.col("_last") > F.col("_first")) | (F.col("_next") <= F.col("_first") + F.expr(f"INTERVAL {int(days)} DAYS"))
             if days >= 1 else F.lit(False))
    per_user = by_day.filter(F.col("_rn") == 1).select("feature", F.when(again, 1).otherwise(0).alias("retained"))
    return (per_user.groupBy("feature").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.sum("retained").cast("long").alias("retained_count"),
        F.bround(F.avg("retained") * 100, 2).alias("retention_rate_percentage"))
        .orderBy(F.desc("retention_rate_percentage"), "feature"))


# --------------------------------------------------------------------- Q15/Q16
def onboarding_steps(activity: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """Per customer: whether each of the five steps occurred (independently,
    T33) and the seconds between consecutive steps' first occurrences."""
    steps = steps or FUNNEL_STEPS
    a = with_ts(activity).filter(F.col("event_type").isin(*steps))
    firsts = a.groupBy("customer_id").agg(
        *[F.min(F.when(F.col("event_type") == s, F.col("_ts"))).alias(f"_t{i}") for i, s in enumerate(steps)])
    cols = [F.col("customer_id")]
    cols += [F.col(f"_t{i}").isNotNull().cast("int").alias(flag) for i, flag in enumerate(STEP_FLAGS)]
    for i, gap in enumerate(GAP_NAMES):
        t0, t1 = F.col(f"_t{i}"), F.col(f"_t{i + 1}")
        cols.append(F.when(t0.isNotNull() & t1.isNotNull(), seconds_between(t0, t1)).alias(f"time_{gap}"))
    return firsts.select(*cols)


def onboarding_funnel(activity: DataFrame, steps: list[str] | None = None, nested: bool = False,
                      accuracy: int = PERCENTILE_ACCURACY) -> DataFrame:
    """Step totals, drop-off % between consecutive steps and approximate
    median gaps, as one row (no row for empty input)."""
    per_c = onboarding_steps(activity, steps)
    aggs = [F.count(F.lit(1)).alias("_customers")]
    aggs += [F.sum(flag).cast("long").alias(tot) for flag, tot in zip(STEP_FLAGS, STEP_TOTALS)]
    aggs += [F.percentile_approx(f"time_{g}", 0.5, accuracy).alias(f"median_{g}") for g in GAP_NAMES]
    g = per_c.agg(*aggs).filter(F.col("_customers") > 0)
    drops = [F.bround((F.lit(1.0) - safe_div(F.col(STEP_TOTALS[i + 1]).cast("double"), F.col(STEP_TOTALS[i]))) * 100, 2)
             .alias(f"dropoff_{gap}") for i, gap in enumerate(GAP_NAMES)]
    flat = g.select(*STEP_TOTALS, *drops, *[f"median_{gap}" for gap in GAP_NAMES])
    if not nested:
        return flat
    return flat.select(
        F.struct(*STEP_TOTALS).alias("funnel_summary"),
        F.struct(*[F.col(f"dropoff_{g}").alias(g) for g in GAP_NAMES]).alias("dropoff_rates"),
        F.struct(*[F.col(f"median_{g}").alias(g) for g in GAP_NAMES]).alias("median_times_seconds"))


# --------------------------------------------------------------------- Q17/Q18
def upsell_targets(activity: DataFrame, as_of=None, days: int = 90,
                   n: int = 20) -> DataFrame:
    """Top ``n`` free-tier customers of the last ``days`` days by the weighted
    engagement score (as coded: sessions/10, duration/600, diversity/20,
    recency (days - d)/days; T31, T32), with a priority label.  ``as_of`` is now by default."""
    as_of_ts = F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    a = with_ts(activity).filter(
        (F.col("subscription_tier") == "free")
        & (F.col("_ts") >= as_of_ts - F.expr(f"INTERVAL {int(days)} DAYS")))
    g = a.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg("session_duration_sec").alias("_avg"),
        # distinct features, where a missing type counts as one more value
        (F.count_distinct("event_type") + F.max(F.col("event_type").isNull().cast("int"))).alias("feature_diversity"),
        F.max("_ts").alias("last_activity"))
    g = (g.withColumn("avg_session_duration_sec", F.bround("_avg", 2))
         .withColumn("_days", days_between(F.col("last_activity"), as_of_ts)))
    score = (F.col("total_sessions") / 10 * 0.30
             + F.col("avg_session_duration_sec") / 600 * 0.25
             + F.col("feature_diversity") / 20 * 0.25
             + (F.lit(float(days)) - F.col("_days")) / float(days) * 0.20)
    g = g.withColumn("engagement_score", F.bround(score, 4))
    top = g.orderBy(F.desc_nulls_last("engagement_score"), "customer_id").limit(n)
    label = (F.when(F.col("engagement_score") >= 0.7, HIGH)
             .when(F.col("engagement_score") >= 0.4, MEDIUM).otherwise(MONITOR))
    return top.select("customer_id", "engagement_score", "total_sessions", "avg_session_duration_sec",
                      F.col("feature_diversity").cast("long").alias("feature_diversity"),
                      F.bround("_days", 1).alias("days_since_last_activity"), "last_activity",
                      label.alias("upsell_priority"))


def upsell_company_details(targets: DataFrame, customers: DataFrame) -> DataFrame:
    """Enrich the (at most ``n``) targets with company data.  The broadcast list
    of ids, bounded by ``n``, reduces the customers first, so they are not
    shuffled; a target without a customer row keeps its place."""
    details = ["company_name", "industry", "company_size", "country_name"]
    c = (customers.select("customer_id", *details)
         .join(F.broadcast(targets.select("customer_id")), "customer_id", "left_semi"))
    rest = [x for x in targets.columns if x != "customer_id"]
    return targets.join(c, "customer_id", "left").select("customer_id", *details, *rest)


# ------------------------------------------------------------ Domain adapters
def q_week_preview(d: Domain):
    return activity_week_preview(d.activity())


def q_sessions(d: Domain):
    return sessions_per_user_week(d.activity())


def q_dau(d: Domain):
    return feature_dau(d.activity())


def q_retention(d: Domain):
    return feature_retention(d.activity())


def q_onboarding_steps(d: Domain):
    return onboarding_steps(d.activity(), BOUND_STEPS)


def q_onboarding_funnel(d: Domain):
    return onboarding_funnel(d.activity(), BOUND_STEPS)


def q_onboarding_funnel_nested(d: Domain):
    return onboarding_funnel(d.activity(), BOUND_STEPS, nested=True)


#: "Now" of the given events, whose last are of January 2024.
FIXTURE_NOW = "2024-01-31 00:00:00"


def q_upsell(d: Domain):
    return upsell_targets(d.activity(), FIXTURE_NOW)


def q_upsell_details(d: Domain):
    return upsell_company_details(upsell_targets(d.activity(), FIXTURE_NOW), d.customers())
