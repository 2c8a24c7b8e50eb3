"""Domain tables derived from the driver's TPC-H-like tables.

The analysed project reads a subscription database (customers, subscriptions,
plans, invoices, tickets, team members, feature flags) and three document
collections.  None of that data exists here, so every domain table is a
deterministic projection of a driver table (FIXTURES.md section 3).  The same
definitions are written in SQL in ``churnlens.oracle.bindings`` so that both
engines see identical inputs.

Everything stays lazy: each binding is a projection (plus at most one join)
over a parquet scan, so Catalyst prunes the unread columns and pushes filters
into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.sources.tables import read_table

# The five plans keyed by the driver's order priorities
# (plan_id, plan_name, plan_tier, monthly_price_usd, max_users, max_projects).
PLAN_ROWS = [
    ("1-URGENT", "Enterprise Custom", "enterprise", "499.00", None, 100),
    ("2-HIGH", "Professional", "professional", "199.00", 50, 50),
    ("3-MEDIUM", "Starter Plus", "starter", "79.00", 20, 20),
    ("4-NOT SPECIFIED", "Starter", "starter", "49.00", 10, 10),
    ("5-LOW", "Free", "free", "0.00", 3, 1),
]

PLANS_SCHEMA = T.StructType([
    T.StructField("plan_id", T.StringType()),
    T.StructField("plan_name", T.StringType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("monthly_price_usd", T.DecimalType(18, 2)),
    T.StructField("max_users", T.IntegerType()),
    T.StructField("max_projects", T.IntegerType()),
])

# Market segment -> subscription tier of an activity record.
SEGMENT_TIER = [("AUTOMOBILE", "enterprise"), ("BUILDING", "professional"), ("FURNITURE", "starter")]

DAYS = "INTERVAL {n} DAYS"


def _days(n: int):
    return F.expr(DAYS.format(n=n))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities that orders have, with the attributes of ``PLAN_ROWS``; any other
    is a free plan under its own name."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("plan_id")).where("plan_id is not null").distinct()
    other = (F.col("plan_id"), F.lit("free"), F.lit("0.00"), F.lit(None), F.lit(None))
    cols = []
    for i, (field, rest) in enumerate(zip(PLANS_SCHEMA.fields[1:], other, strict=True), 1):
        by = rest
        for row in PLAN_ROWS:
            by = F.when(F.col("plan_id") == row[0], F.lit(row[i])).otherwise(by)
        cols.append(by.cast(field.dataType).alias(field.name))
    return o.select("plan_id", *cols)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "O", "active")
              .when(F.col("o_orderstatus") == "F", "cancelled")
              .when(F.col("o_orderstatus") == "P", "paused"))
    key = F.col("o_orderkey")
    cancelled = F.col("o_orderstatus") == "F"
    return o.select(
        key.alias("subscription_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("plan_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("start_date"),
        F.when(cancelled, F.col("o_orderdate") + _days(180)).alias("end_date"),
        F.when(key % 4 == 0, F.col("o_orderdate") + _days(14)).alias("trial_end_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("mrr_usd"),
        F.when(key % 3 == 0, "annual").otherwise("monthly").alias("billing_cycle"),
        F.when(cancelled & (key % 2 == 0), "price").alias("cancellation_reason"),
    )


def billing_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    paid = F.col("l_linestatus") == "F"
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("invoice_id"),
        F.col("l_orderkey").alias("subscription_id"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)")))
        .cast("decimal(18,2)").alias("amount_usd"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_usd"),
        F.when(paid, "paid").when(F.col("l_linestatus") == "O", "open").alias("status"),
        F.when(paid, F.col("l_shipdate")).alias("paid_at"),
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ticket_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "F", "closed").otherwise("open").alias("status"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_table(spark, sf_dir, "customer")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = cu.join(na, cu["c_nationkey"] == na["n_nationkey"], "left")
    k = F.col("c_custkey")
    neg = F.col("c_acctbal") < 0
    size = (F.when(k % 4 == 0, "1-10").when(k % 4 == 1, "11-50")
            .when(k % 4 == 2, "51-200").otherwise("201+"))
    return j.select(
        k.alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.when(k % 17 == 0, None).otherwise(
            F.concat(F.lit("contact"), k.cast("string"), F.lit("@d"), (k % 50).cast("string"), F.lit(".com"))
        ).alias("contact_email"),
        # blanks, quotes, commas and line breaks, which an export has to keep
        F.when(k % 19 == 0, None).when(k % 41 == 0, F.concat(F.lit(' "Contact",\n'), k.cast("string"), F.lit(" "))).when(k % 43 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("Contact "), k.cast("string"))).alias("contact_name"),
        F.when(k % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("industry"),
        F.when(k % 29 == 0, None).otherwise(size).alias("company_size"),
        F.upper(F.substring(F.col("n_name"), 1, 2)).alias("country_code"),
        F.col("n_name").alias("country_name"),
        F.when(k % 23 == 0, None).otherwise(F.lit("UTC")).alias("timezone"),
        F.when(k % 7 == 0, None).otherwise((k % 11).cast("double")).alias("nps_score"),
        F.when(neg, "price").alias("churn_reason"),
        F.when(k % 13 == 0, "bad").otherwise("1995-01-01").alias("signup_date"),
        F.when(k % 31 == 0, "").otherwise("1995-01-01 00:00:00").alias("created_at"),
        F.when(k % 37 == 0, None).otherwise("2001-08-01 00:00:00").alias("updated_at"),
        F.when(neg, "2000-06-30").alias("churned_at"),
        (~neg).alias("is_active"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' accounts for the duplicate-account report.  Names and
    domains grow with the table: a few accounts share each, whatever its size."""
    s = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return s.select(
        k.alias("customer_id"),
        F.concat(F.when(k % 2 == 0, "Acme N ").otherwise("ACMEN"), F.floor(k / 4).cast("string")).alias("company_name"),
        F.concat(F.lit("ops@d"), F.floor(k / 3).cast("string"), F.lit(".com")).alias("contact_email"),
    )


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    # one member per (account, part); the earliest ship date is the last login
    d = li.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first_ship"))
    p = F.col("l_partkey")
    return d.select(
        (F.col("l_suppkey") * 10000000 + p).alias("member_id"),
        F.col("l_suppkey").alias("customer_id"),
        F.concat(F.lit("u"), p.cast("string"), F.lit("."), F.floor(F.col("l_suppkey") / 2).cast("string"), F.lit("@x.com")).alias("email"),
        F.when(p % 5 == 0, "admin").otherwise("member").alias("role"),
        F.when(p % 3 == 0, None).otherwise(F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).alias("joined_at"),
        F.when(p % 4 == 0, None).otherwise(F.col("first_ship")).alias("last_login_at"),
    )


def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    plan = F.element_at(F.array(*[F.lit(r[0]) for r in PLAN_ROWS]), (k % 5 + 1).cast("int"))
    even = F.col("p_size") % 2 == 0
    return pa.select(
        k.alias("flag_id"),
        plan.alias("plan_id"),
        F.col("p_type").alias("feature_key"),
        even.alias("is_enabled"),
        F.when(even, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).alias("enabled_at"),
    )


def _tier_expr(seg):
    e = None
    for s, t in SEGMENT_TIER:
        e = F.when(seg == s, t) if e is None else e.when(seg == s, t)
    return e.when(seg.isNotNull(), "free")


def _events_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ev.join(cu, ev["user_id"] == cu["c_custkey"], "left")


def user_activity_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity documents as the pipelines see them (ids already merged)."""
    j = _events_with_segment(spark, sf_dir)
    return j.select(
        F.col("user_id").alias("customer_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("member_id"),
        F.col("event_type"),
        F.col("value").alias("session_duration_sec"),
        F.col("ts").alias("timestamp"),
        _tier_expr(F.col("c_mktsegment")).alias("subscription_tier"),
    )


def _split_id(key_col, even_name: str, odd_name: str, eid):
    return [F.when(eid % 2 == 0, key_col).alias(even_name), F.when(eid % 2 == 1, key_col).alias(odd_name)]


def raw_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw activity collection: ids under two names, text timestamps."""
    j = _events_with_segment(spark, sf_dir)
    eid = F.col("event_id")
    member = F.col("user_id") * 10 + eid % 7
    return j.select(
        F.concat(F.lit("a"), eid.cast("string")).alias("_id"),
        *_split_id(F.col("user_id"), "customer_id", "customerId", eid),
        *_split_id(member, "member_id", "userId", eid),
        F.col("event_type"),
        F.col("value").alias("session_duration_sec"),
        F.col("ts").cast("string").alias("timestamp"),
        _tier_expr(F.col("c_mktsegment")).alias("subscription_tier"),
    )


def raw_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    member = F.col("user_id") * 10 + eid % 7
    return ev.select(
        F.concat(F.lit("s"), eid.cast("string")).alias("_id"),
        *_split_id(F.col("user_id"), "customer_id", "customerId", eid),
        *_split_id(member, "member_id", "memberId", eid),
        (eid % 11).cast("double").alias("nps_score"),
        F.col("event_type").alias("feedback"),
        F.date_format(F.col("ts"), "yyyy-MM-dd").alias("survey_date"),
    )


def raw_onboarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    member = F.col("user_id") * 10 + eid % 7
    return ev.select(
        F.concat(F.lit("o"), eid.cast("string")).alias("_id"),
        *_split_id(F.col("user_id"), "customer_id", "customerId", eid),
        *_split_id(member, "member_id", "memberId", eid),
        F.col("event_type").alias("step"),
        F.col("ts").cast("string").alias("timestamp"),
        (eid % 5 != 0).alias("completed"),
    )


class Domain:
    """Lazy accessors for the domain tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def plans(self):
        return plans(self.spark, self.sf_dir)

    def subscriptions(self):
        return subscriptions(self.spark, self.sf_dir)

    def billing_invoices(self):
        return billing_invoices(self.spark, self.sf_dir)

    def support_tickets(self):
        return support_tickets(self.spark, self.sf_dir)

    def customers(self):
        return customers(self.spark, self.sf_dir)

    def accounts(self):
        return accounts(self.spark, self.sf_dir)

    def team_members(self):
        return team_members(self.spark, self.sf_dir)

    def feature_flags(self):
        return feature_flags(self.spark, self.sf_dir)

    def activity(self):
        return user_activity_logs(self.spark, self.sf_dir)

    def raw_activity(self):
        return raw_activity(self.spark, self.sf_dir)

    def raw_surveys(self):
        return raw_surveys(self.spark, self.sf_dir)

    def raw_onboarding(self):
        return raw_onboarding(self.spark, self.sf_dir)
