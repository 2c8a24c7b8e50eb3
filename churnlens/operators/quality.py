"""Cleaning and profiling (survey Q19-Q30, Q34, D1-D13).

Column-name work (normalising, de-duplicating, alias coalescing) only
rewrites the projection.  Scalar parameters (IQR fences, medians) come from
``plans.quantiles``: distributed aggregations whose few summary numbers are
inlined as literals; no data is collected to the driver.
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.exprs import nan_to_null, parse_ts_coerce
from churnlens.plans.quantiles import quantile_scalars
from churnlens.plans.session import materialise
from churnlens.sources.bindings import Domain
from churnlens.sources.sinks import default_export_dir, export_verified, row_text

DUP = "__dup"
SUFFIX = re.compile(DUP + r"\d+$")


# ------------------------------------------------------------ column names
def normalise_columns(df: DataFrame, lower: bool = True) -> DataFrame:
    """Trim (and lower-case) names; a repeated name (whatever its case) gets a positional suffix
    so that later steps can address every copy (T2).  Renaming is positional
    (``toDF``), so it works even when the source has names equal up to case."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        n = name.strip().lower() if lower else name
        k = seen.get(n.lower(), 0)
        out.append(n if k == 0 else f"{n}{DUP}{k}")
        seen[n.lower()] = k + 1
    return df.toDF(*out)


def _variants(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c == name or c.startswith(name + DUP)]


def coalesce_alias(df: DataFrame, target: str, *aliases: str) -> DataFrame:
    """Fill ``target`` from its aliases, left to right over every copy, then
    drop the aliases (missing names are ignored)."""
    sources = _variants(df, target) + [v for a in aliases for v in _variants(df, a)]
    if not sources:
        return df
    first = df.columns.index(sources[0])
    merged = F.coalesce(*[F.col(s) for s in sources]) if len(sources) > 1 else F.col(sources[0])
    cols = []
    for i, c in enumerate(df.columns):
        if c in sources:
            if i == first:
                cols.append(merged.alias(target))
            continue
        cols.append(F.col(c))
    return df.select(*cols)


def drop_repeated(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns."""
    return df.select(*[c for c in df.columns if not SUFFIX.search(c)])


# ---------------------------------------------------------------- Q19-Q21
def clean_activity(raw: DataFrame, iqr_fence: float = 1.5) -> DataFrame:
    """Normalise names, merge id aliases, drop ``_id`` and rows without a
    customer, fill duration 0 / event 'unknown', then keep durations inside
    the inclusive Tukey fence (exact linear-interpolation quartiles).
    All rows are kept up to the fence (the inspection-slip trap T1 is not
    reproduced).  What comes before the fence is written once: the quartiles' passes
    and whatever is made of the result read that, not the collection and its joins."""
    df = normalise_columns(raw)
    df = coalesce_alias(df, "customer_id", "customerid")
    df = coalesce_alias(df, "member_id", "userid")
    df = drop_repeated(df).drop("_id")
    df = df.filter(F.col("customer_id").isNotNull())
    df = df.withColumn("session_duration_sec", F.coalesce(nan_to_null(F.col("session_duration_sec").cast("double")), F.lit(0.0)))
    df = df.withColumn("event_type", F.coalesce(F.col("event_type"), F.lit("unknown")))
    df = materialise(df, "activity")
    q = quantile_scalars(df, "session_duration_sec", {"q1": 0.25, "q3": 0.75})
    iqr = q["q3"] - q["q1"]
    lo, hi = q["q1"] - iqr_fence * iqr, q["q3"] + iqr_fence * iqr
    return df.filter((F.col("session_duration_sec") >= lo) & (F.col("session_duration_sec") <= hi))


def clean_documents(raw: DataFrame) -> DataFrame:
    """Surveys and onboarding events: merge every copy of ``customerId`` and
    ``memberId``, whatever their case, into the snake-case ids (the intent of the
    notebook, T3), then keep the first of other repeated columns and drop ``_id``."""
    df = normalise_columns(raw, lower=False)
    for target in ("customer_id", "member_id"):
        plain = target.replace("_", "")
        names = [c for c in df.columns if SUFFIX.sub("", c).strip().lower() in (target, plain)]
        df = coalesce_alias(df, target, *dict.fromkeys(SUFFIX.sub("", c) for c in names if c != target))
    return drop_repeated(df).drop("_id")


# ---------------------------------------------------------------- Q22-Q27
CUSTOMER_TEXT = ["industry", "company_size", "country_code", "country_name", "timezone", "contact_email", "contact_name"]
CUSTOMER_DATES = ["signup_date", "created_at", "updated_at", "churned_at"]


def clean_customers(customers: DataFrame) -> DataFrame:
    med = quantile_scalars(customers, "nps_score", {"m": 0.5})["m"]
    cols = []
    for c in customers.columns:
        if c in CUSTOMER_TEXT:
            cols.append(F.coalesce(F.col(c), F.lit("Unknown")).alias(c))
        elif c == "nps_score":
            cols.append(F.coalesce(nan_to_null(F.col(c)), med).alias(c))
        elif c == "churn_reason":
            cols.append(F.coalesce(F.col(c), F.lit("Not Churned")).alias(c))
        elif c in CUSTOMER_DATES:
            cols.append(parse_ts_coerce(c).alias(c))
        else:
            cols.append(F.col(c))
    return customers.select(*cols)


def clean_plans(plans: DataFrame) -> DataFrame:
    return plans.fillna(0, subset=["max_users", "max_projects"])


def clean_team(team: DataFrame) -> DataFrame:
    return (team.withColumn("joined_at", F.coalesce(F.col("joined_at").cast("string"), F.lit("Not Joined")))
            .withColumn("last_login_at", F.coalesce(F.col("last_login_at").cast("string"), F.lit("Never Logged In"))))


def clean_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.withColumns({
        "is_active_subscription": F.col("end_date").isNull(),
        "is_on_trial": F.col("trial_end_date").isNotNull(),
        "is_cancelled": F.col("cancellation_reason").isNotNull(),
        "is_churned": F.col("end_date").isNotNull(),
    })


def clean_billing(billing: DataFrame) -> DataFrame:
    return billing.withColumn("is_paid", F.col("paid_at").isNotNull())


def clean_features(features: DataFrame) -> DataFrame:
    return features.withColumn("is_enabled_flag", F.col("enabled_at").isNotNull())


# ---------------------------------------------------------------- Q28-Q30
def null_profile(df: DataFrame, table: str | None = None) -> DataFrame:
    """Null count per column: one aggregation, then unpivot (NaN counts as
    null, as in pandas)."""
    def is_missing(c, t):
        m = F.col(c).isNull()
        return m | F.isnan(F.col(c)) if t in ("double", "float") else m
    types = dict(df.dtypes)
    agg = df.agg(*[F.sum(is_missing(c, types[c]).cast("long")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("null_count"))
                               for i, c in enumerate(df.columns)]))
    out = agg.select(stack)
    return out.select(F.lit(table).alias("table_name"), "*") if table else out


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits of a row: two hashes over its values and which of them are null."""
    flags = [F.shiftleft(F.col(c).isNull().cast("long"), i % 60) for i, c in enumerate(df.columns)]
    nulls = [reduce(Column.bitwiseOR, flags[i:i + 60]) for i in range(0, len(flags), 60)]
    return [F.xxhash64(*nulls, *df.columns).alias("_a"), F.xxhash64(*reversed(df.columns), *nulls).alias("_b")]


def duplicate_profile(df: DataFrame, table: str | None = None) -> DataFrame:
    """Rows that repeat an earlier row (``duplicated().sum()``): 16 bytes a row are
    grouped, with partial aggregation, not the rows (two of n rows would have to meet in 128 bits
    to count wrongly)."""
    g = df.select(*row_digest(df)).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    out = g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return out.select(F.lit(table).alias("table_name"), "*") if table else out


def table_shape(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(table).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# ------------------------------------------------------------ Domain adapters
def q_clean_activity(d: Domain):
    return clean_activity(d.raw_activity())


def q_clean_surveys(d: Domain):
    return clean_documents(d.raw_surveys())


def q_clean_onboarding(d: Domain):
    return clean_documents(d.raw_onboarding())


def q_clean_customers(d: Domain):
    return clean_customers(d.customers())


def q_clean_plans(d: Domain):
    return clean_plans(d.plans())


def q_clean_team(d: Domain):
    return clean_team(d.team_members())


def q_clean_subscriptions(d: Domain):
    return clean_subscriptions(d.subscriptions())


def q_clean_billing(d: Domain):
    return clean_billing(d.billing_invoices())


def q_clean_features(d: Domain):
    return clean_features(d.feature_flags())


PROFILED = ["customers", "subscriptions", "plans", "billing_invoices", "support_tickets", "team_members", "feature_flags"]
COLLECTIONS = ["raw_activity", "raw_surveys", "raw_onboarding"]


def _tables(d: Domain) -> dict[str, DataFrame]:
    """The seven tables, the three collections and the merged frame."""
    from churnlens.operators.features import Cleaned, activity_enriched
    return {t: getattr(d, t)() for t in PROFILED + COLLECTIONS} | {"merged": activity_enriched(Cleaned(d))}


def q_null_profile(d: Domain):
    return reduce(DataFrame.unionByName, [null_profile(df, t) for t, df in _tables(d).items()])


def q_duplicate_profile(d: Domain):
    return reduce(DataFrame.unionByName, [duplicate_profile(df, t) for t, df in _tables(d).items()])


def q_table_shape(d: Domain):
    return reduce(DataFrame.unionByName, [table_shape(df, t) for t, df in _tables(d).items()])


def table_preview(d: Domain, name: str = "subscriptions", n: int = 5) -> DataFrame:
    """The first ``n`` rows of a table or collection, by its first column (ties: by the rows as text)."""
    if name not in PROFILED + COLLECTIONS:
        raise ValueError(f"no table {name}; there are {', '.join(PROFILED + COLLECTIONS)}")
    df = getattr(d, name)()
    return df.orderBy(df.columns[0], row_text(df.columns)).limit(n)


def q_table_preview(d: Domain):
    return table_preview(d)


def q_table_previews(d: Domain, n: int = 5):
    """``table_preview`` of every table and collection: its name, the row's place and
    the row as text."""
    parts = []
    for name in PROFILED + COLLECTIONS:
        df = table_preview(d, name, n)
        place = F.row_number().over(Window.orderBy(df.columns[0], row_text(df.columns))).cast("long")  # over at most n rows
        parts.append(df.select(F.lit(name).alias("table_name"), place.alias("place"), F.regexp_replace(row_text(df.columns), "\x1f", "|").alias("row")))
    return reduce(DataFrame.unionByName, parts)


# -------------------------------------------------------------------- Q43
EXPORTS = ["activity_clean", "survey_clean", "onboarding_clean", "clean_customer_data", "clean_plan",
           "clean_team", "clean_subscription", "clean_billing", "clean_feature"]


def cleaned_tables(d: Domain) -> dict[str, DataFrame]:
    """The nine cleaned tables the notebook exports (tickets are read but
    never cleaned or written, T40)."""
    return dict(zip(EXPORTS, [q_clean_activity(d), q_clean_surveys(d), q_clean_onboarding(d), q_clean_customers(d),
                              q_clean_plans(d), q_clean_team(d), q_clean_subscriptions(d), q_clean_billing(d),
                              q_clean_features(d)]))


def q_export_clean_csv(d: Domain, out_dir: str | None = None):
    """Write the cleaned tables as CSV with a header and return the manifest: row
    counts and digests of the content read back from the written files."""
    return export_verified(cleaned_tables(d), out_dir or default_export_dir(d.spark))
