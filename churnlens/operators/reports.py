"""Subscription reports: plan summary, lifetime value, downgrades, monthly
growth and churn, duplicate accounts (survey Q01-Q10).

Each function reproduces the report's result as written (including its
fan-outs, traps T9-T13, T24-T29), but computes it from pre-aggregated sides so
that no join multiplies fact rows before they are reduced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.exprs import month_text, safe_div
from churnlens.plans.joins import small
from churnlens.plans.windows import lag_by_key, rank_desc, running_sum_by_key
from churnlens.sources.bindings import Domain

ALERT = "ALERT ⚠️"
NORMAL = "NORMAL ✅"


def _plans(d: Domain) -> DataFrame:
    return small(d.plans())


def subs_with_plans(d: Domain) -> DataFrame:
    return d.subscriptions().join(_plans(d), "plan_id")


def _round2(col) -> F.Column:
    return F.round(col, 2).cast("double")


# --------------------------------------------------------------------- Q01/Q02
def _plan_ticket_parts(d: Domain) -> DataFrame:
    """Per plan: distinct customers, the fanned-out MRR mean and ticket count
    of ``subs JOIN plans LEFT JOIN tickets ON customer_id`` (T13), computed
    from (customer, plan) and customer aggregates instead of the fan-out."""
    active = d.subscriptions().filter(F.col("status") == "active")
    sp = active.join(_plans(d), "plan_id")
    per_cp = sp.groupBy("customer_id", "plan_name", "plan_tier").agg(
        F.count(F.lit(1)).alias("n_subs"),
        F.sum("mrr_usd").alias("sum_mrr"),
        F.count("mrr_usd").alias("n_mrr"))
    tickets = d.support_tickets().groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("ticket_rows"), F.count("ticket_id").alias("ticket_ids"))
    j = per_cp.join(tickets, "customer_id", "left")
    fan = F.when(F.col("ticket_rows") > 0, F.col("ticket_rows")).otherwise(F.lit(1))
    return j.groupBy("plan_name", "plan_tier").agg(
        F.count("customer_id").alias("active_customers"),
        F.sum(F.col("sum_mrr") * fan).alias("_mrr_w"),
        F.sum(F.col("n_mrr") * fan).alias("_n_w"),
        F.sum(F.col("n_subs") * F.coalesce(F.col("ticket_ids"), F.lit(0))).alias("_tickets"))


def plan_summary(d: Domain) -> DataFrame:
    p = _plan_ticket_parts(d)
    return p.select(
        "plan_name", "plan_tier", "active_customers",
        _round2(safe_div(F.col("_mrr_w"), F.col("_n_w"))).alias("avg_monthly_revenue"),
        _round2(safe_div(F.col("_tickets").cast("decimal(20,2)"), F.col("active_customers"))).alias("tickets_per_customer"),
    ).orderBy(F.desc("active_customers"), "plan_name")


def plan_ticket_rate(d: Domain) -> DataFrame:
    p = _plan_ticket_parts(d)
    return p.select(
        "plan_name", "plan_tier",
        _round2(safe_div(F.col("_tickets").cast("decimal(20,2)"), F.col("active_customers"))).alias("tickets_per_customer"))


# ------------------------------------------------------------------------- Q03
def ltv_rank(d: Domain) -> DataFrame:
    """Lifetime value (sum of paid invoices) per customer x tier, its RANK in
    the tier, the tier mean and the % difference from it."""
    paid = (d.billing_invoices().filter(F.col("status") == "paid")
            .groupBy("subscription_id").agg(F.sum("total_usd").alias("sub_value")))
    s = d.subscriptions().select("subscription_id", "customer_id", "plan_id")
    sp = s.join(paid, "subscription_id").join(_plans(d).select("plan_id", "plan_tier"), "plan_id")
    per_ct = sp.groupBy("customer_id", "plan_tier").agg(F.sum("sub_value").alias("value"))
    # customer rows per (id, name): the written join repeats the sum per copy
    cust = d.customers().groupBy("customer_id", "company_name").agg(F.count(F.lit(1)).alias("copies"))
    base = per_ct.join(cust, "customer_id").select(
        "customer_id", "company_name", "plan_tier",
        (F.col("value") * F.col("copies")).alias("lifetime_value"))
    j = rank_desc(base, "plan_tier", "lifetime_value", "customer_rank", mean="tier_avg")
    return j.select(
        "customer_id", "company_name", "plan_tier",
        F.col("lifetime_value").cast("double").alias("lifetime_value"),
        F.col("customer_rank").cast("long").alias("customer_rank"),
        _round2(F.col("tier_avg")).alias("tier_average_ltv"),
        # in double, as the wide intermediate scale of the written query does
        _round2(safe_div(F.col("lifetime_value").cast("double") - F.col("tier_avg").cast("double"),
                         F.col("tier_avg").cast("double")) * 100).alias("percentage_difference"),
    )


# --------------------------------------------------------------------- Q04-Q08
def is_downgrade(prev_tier="previous_tier", cur_tier="current_tier") -> F.Column:
    """Tier-fall rule of the report, null-propagating like SQL (T9)."""
    p, c = F.col(prev_tier), F.col(cur_tier)
    return (((p == "enterprise") & (c != "enterprise"))
            | ((p == "professional") & c.isin("starter", "free"))
            | ((p == "starter") & (c == "free")))


def tier_history(d: Domain) -> DataFrame:
    """Every subscription with the plan of the customer's previous one
    (LAG by start_date; subscription_id breaks ties, T12)."""
    sp = subs_with_plans(d).select("customer_id", "subscription_id", "start_date",
                                   F.col("plan_name").alias("current_plan"),
                                   F.col("plan_tier").alias("current_tier"))
    return lag_by_key(sp, "customer_id", ["start_date", "subscription_id"],
                      {"current_plan": "previous_plan", "current_tier": "previous_tier"})


def subscription_history(d: Domain) -> DataFrame:
    return (subs_with_plans(d)
            .select("customer_id", "start_date", "plan_name", "plan_tier", "subscription_id")
            .orderBy("customer_id", "start_date", "subscription_id")
            .drop("subscription_id"))


def tier_transitions(d: Domain) -> DataFrame:
    return tier_history(d).select("customer_id", "start_date", "current_tier", "previous_tier")


def downgrades_all(d: Domain) -> DataFrame:
    return (tier_history(d).filter(is_downgrade())
            .select("customer_id", "start_date", "current_plan", "current_tier", "previous_plan", "previous_tier"))


_GROUP = ["customer_id", "company_name", "previous_plan", "previous_tier", "current_plan", "current_tier"]


def downgrade_risk(d: Domain, as_of=None, window_days: int = 90, ticket_days: int = 30,
                   min_tickets: int = 3, until_downgrade: bool = False) -> DataFrame:
    """Customers whose tier fell within ``window_days`` before ``as_of`` (default: today) with
    more than ``min_tickets`` tickets since ``ticket_days`` before the change
    (no upper bound unless ``until_downgrade``, T10; strictly more, T11).

    Tickets and falls are one stream, per customer from the latest instant to the earliest;
    the tickets counted when a fall's bound is reached are those since it.  The
    running count is split by range (``plans.windows``), so neither a customer's falls nor
    their tickets meet in one task, and no pair of them is ever formed."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    since = day - F.expr(f"INTERVAL {int(window_days)} DAYS")
    dg = (tier_history(d)
          .filter(F.col("start_date") >= since.cast("timestamp_ntz"))
          .filter(is_downgrade()))
    cust = d.customers().select("customer_id", "company_name")
    dgc = dg.join(cust, "customer_id")
    # tickets reduced to (customer, instant) counts first
    tickets = (d.support_tickets().where("customer_id is not null and created_at is not null").groupBy("customer_id", "created_at")
               .agg(F.count("ticket_id").alias("n")).select("customer_id", F.col("created_at").alias("at"), "n", F.lit(0).alias("sign"), F.lit(None).alias("fall")))
    bounds = [F.struct((F.col("start_date") - F.expr(f"INTERVAL {int(ticket_days)} DAYS")).alias("at"), F.lit(1).alias("sign"))]
    if until_downgrade:
        bounds.append(F.struct(F.col("start_date").alias("at"), F.lit(-1).alias("sign")))
    falls = (dgc.select("customer_id", F.struct(*_GROUP[1:]).alias("fall"), F.explode(F.array(*bounds)).alias("b"))
             .select("customer_id", F.col("b.at").alias("at"), F.lit(0).cast("long").alias("n"), F.col("b.sign").alias("sign"), "fall"))
    stream = tickets.withColumn("fall", F.col("fall").cast(falls.schema["fall"].dataType)).unionByName(falls)
    # at one instant tickets come first: the bound counts them
    counted = running_sum_by_key(stream, "customer_id", [F.col("at").desc(), F.abs(F.col("sign"))], "n", "since").where("sign <> 0")
    out = (counted.select("customer_id", "fall.*", (F.col("since") * F.col("sign")).alias("_n"))
           .groupBy(*_GROUP).agg(F.sum("_n").cast("long").alias("tickets_before_downgrade")))
    return out.filter((F.col("tickets_before_downgrade") > min_tickets) & (F.col("tickets_before_downgrade") > 0))


def downgrade_ticket_counts(d: Domain, min_tickets: int = 3) -> DataFrame:
    """All downgrades with the customer's lifetime ticket count (left join),
    more than ``min_tickets``."""
    dg = downgrades_all(d)
    cust = d.customers().select("customer_id", "company_name")
    tk = d.support_tickets().groupBy("customer_id").agg(F.count("ticket_id").alias("n_tickets"))
    j = dg.join(cust, "customer_id").join(tk, "customer_id", "left")
    out = j.groupBy(*_GROUP).agg(F.sum(F.coalesce(F.col("n_tickets"), F.lit(0))).cast("long").alias("total_tickets"))
    return out.filter(F.col("total_tickets") > min_tickets)


# ------------------------------------------------------------------------- Q09
def monthly_growth_churn(d: Domain) -> DataFrame:
    """Per start month x tier: new subscriptions, month-over-month growth,
    cancelled count (by start month, T24), its mean over the current and two
    previous *rows* (T25) and the ALERT flag (T26)."""
    sp = subs_with_plans(d)
    monthly = sp.groupBy(month_text("start_date").alias("month"), "plan_tier").agg(
        F.count(F.lit(1)).alias("new_subscriptions"),
        F.sum(F.when(F.col("status") == "cancelled", 1).otherwise(0)).cast("long").alias("churn_count"))
    # one row per (month, tier): a tier's window holds at most its months
    w = Window.partitionBy("plan_tier").orderBy("month")
    g = (monthly
         .withColumn("prev", F.lag("new_subscriptions").over(w))
         .withColumn("roll", F.avg("churn_count").over(w.rowsBetween(-2, 0))))
    return g.select(
        "month", "plan_tier", "new_subscriptions",
        _round2(safe_div((F.col("new_subscriptions") - F.col("prev")).cast("double"), F.col("prev")) * 100).alias("mom_growth_rate"),
        "churn_count",
        _round2(F.col("roll")).alias("rolling_avg_churn"),
        F.when(F.col("churn_count") > 2 * F.col("roll"), ALERT).otherwise(NORMAL).alias("churn_flag"))


# ------------------------------------------------------------------------- Q10
def _pairs_on(df: DataFrame, key) -> DataFrame:
    a = df.select(F.col("customer_id").alias("customer_1"), key.alias("_k"))
    b = df.select(F.col("customer_id").alias("customer_2"), key.alias("_k2"))
    return (a.join(b, (F.col("_k") == F.col("_k2")) & (F.col("customer_1") < F.col("customer_2")))
            .select("customer_1", "customer_2"))


def duplicate_accounts(d: Domain, accounts: DataFrame | None = None, members: DataFrame | None = None,
                       shared_only: bool = False) -> DataFrame:
    """Account pairs sharing a normalised name, an e-mail domain or a team
    member e-mail, with the written report's row multiplicity (T28).

    The written form compares all pairs (a nested-loop join).  Here the
    candidates come from three equi self-joins - one per blocking key - so
    only accounts that share a key ever meet; the pair list is de-duplicated
    and then expanded with the members exactly as the report does.
    """
    acc = accounts if accounts is not None else d.accounts()
    tm = members if members is not None else d.team_members()
    name_key = F.lower(F.replace(F.col("company_name"), F.lit(" "), F.lit("")))
    dom_key = F.substring_index(F.col("contact_email"), "@", -1)
    m = tm.select("customer_id", "email").filter(F.col("email").isNotNull()).distinct()
    cand = (_pairs_on(acc, name_key)
            .unionByName(_pairs_on(acc, dom_key))
            .unionByName(_pairs_on(m.withColumnRenamed("email", "_e"), F.col("_e")))
            .distinct())
    c1 = acc.select(F.col("customer_id").alias("customer_1"), F.col("company_name").alias("company_name_1"),
                    F.col("contact_email").alias("email_1"))
    c2 = acc.select(F.col("customer_id").alias("customer_2"), F.col("company_name").alias("company_name_2"),
                    F.col("contact_email").alias("email_2"))
    pairs = cand.join(c1, "customer_1").join(c2, "customer_2")
    tm1 = tm.select(F.col("customer_id").alias("_c1"), F.col("email").alias("_tm1"))
    tm2 = tm.select(F.col("customer_id").alias("_c2"), F.col("email").alias("_tm2"))
    j = (pairs.join(tm1, F.col("customer_1") == F.col("_c1"), "left")
         .join(tm2, (F.col("customer_2") == F.col("_c2")) & (F.col("_tm1") == F.col("_tm2")), "left"))
    n1 = F.lower(F.replace(F.col("company_name_1"), F.lit(" "), F.lit("")))
    n2 = F.lower(F.replace(F.col("company_name_2"), F.lit(" "), F.lit("")))
    d1 = F.substring_index(F.col("email_1"), "@", -1)
    d2 = F.substring_index(F.col("email_2"), "@", -1)
    keep = F.coalesce(n1 == n2, F.lit(False)) | F.coalesce(d1 == d2, F.lit(False)) | F.coalesce(F.col("_tm1") == F.col("_tm2"), F.lit(False))
    shared = F.col("_tm2") if shared_only else F.col("_tm1")
    return j.filter(keep).select("customer_1", "company_name_1", "customer_2", "company_name_2",
                                 "email_1", "email_2", shared.alias("shared_team_member"))


# ------------------------------------------------------------ Domain adapters
#: "Today" of the given orders, whose last are of 2001.
FIXTURE_TODAY = "2001-08-01"


def q_downgrade_risk(d: Domain):
    return downgrade_risk(d, FIXTURE_TODAY)
