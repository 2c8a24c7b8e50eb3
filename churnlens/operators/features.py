"""Merged activity frame, engagement, calendar and customer features
(survey Q31-Q35, Q38-Q40).

The notebook merges every activity record with every subscription of its
customer (a per-customer cross product, T16) and then aggregates.  The merged
rows themselves are returned by ``activity_enriched``/``dedupe_rows`` because
they are those queries' result; every *aggregate* of the merge is computed
from per-customer aggregates of each side instead, using

    rows(c)      = |A(c)| * max(|S(c)|, 1) * max(|C(c)|, 1)
    sum_x(c)     = sum_A(x) * max(|S(c)|, 1) * max(|C(c)|, 1)
    mean_S(y)(c) = sum_S(y) / count_S(y)          (same for customer columns)

(A: activity rows, S: subscription x plan rows, C: customer rows of c), so the
fan-out is never materialised and a customer with a third of all records is
reduced map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators import quality
from churnlens.plans.joins import hot_left_join, is_small
from churnlens.plans.quantiles import multi_quantiles
from churnlens.plans.session import materialise
from churnlens.sources.bindings import Domain

FEATURES = ["total_session_time", "total_events", "avg_revenue", "avg_nps"]


class Cleaned:
    """The cleaned inputs of the merge (Q19, Q22, Q23, Q25)."""

    def __init__(self, d: Domain):
        self.activity = quality.clean_activity(d.raw_activity())
        self.subscriptions = quality.clean_subscriptions(d.subscriptions())
        self.customers = quality.clean_customers(d.customers())
        self.plans = quality.clean_plans(d.plans())
        self._few: bool | None = None

    def few(self, plans: DataFrame) -> DataFrame:
        """The plans, marked for broadcast where they are few (looked up once)."""
        if self._few is None:
            self._few = is_small(self.plans)
        return F.broadcast(plans) if self._few else plans


def _prefix_clashes(left: list[str], right: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Rename right-side non-key columns that already exist on the left
    (pandas would suffix them ``_x``/``_y``; T14)."""
    clash = [c for c in right.columns if c in left and c not in keys]
    for c in clash:
        right = right.withColumnRenamed(c, f"{prefix}_{c}")
    return right


def subs_with_plans(c: Cleaned) -> DataFrame:
    """Subscriptions left-joined to the plans with a null-safe key, as a pandas
    merge matches missing keys (T15)."""
    plans = _prefix_clashes(c.subscriptions.columns, c.plans, ["plan_id"], "plans").withColumnRenamed("plan_id", "_plan_id")
    j = c.subscriptions.join(c.few(plans), c.subscriptions["plan_id"].eqNullSafe(plans["_plan_id"]), "left")
    return j.drop("_plan_id")


def _merge(c: Cleaned, a: DataFrame, s: DataFrame, cu: DataFrame, p: DataFrame) -> DataFrame:
    """The merge of the given sides; a customer with very many records is split over
    tasks (``plans.joins``), by the records before any are dropped, which are at hand."""
    s = _prefix_clashes(a.columns, s, ["customer_id"], "subscriptions")
    cu = _prefix_clashes(a.columns + s.columns, cu, ["customer_id"], "customers")
    j = hot_left_join(a, [s, cu], "customer_id", counted=c.activity)
    p = _prefix_clashes(j.columns, p, ["plan_id"], "plans").withColumnRenamed("plan_id", "_plan_id")
    return j.join(c.few(p), j["plan_id"].eqNullSafe(p["_plan_id"]), "left").drop("_plan_id")


def activity_enriched(c: Cleaned) -> DataFrame:
    """activity LEFT JOIN subscriptions LEFT JOIN customers LEFT JOIN plans,
    one row per (record, subscription) pair (Q31)."""
    return _merge(c, c.activity, c.subscriptions, c.customers, c.plans)


def dedupe_rows(c: Cleaned) -> DataFrame:
    """Exact duplicate rows of the merge removed (Q34).  The merge keeps every column of
    its sides, so its rows are distinct where theirs are: the sides lose
    their duplicates before anything is multiplied."""
    return _merge(c, c.activity.dropDuplicates(), c.subscriptions.dropDuplicates(), c.customers.dropDuplicates(), c.plans.dropDuplicates())


def calendar_features(c: Cleaned) -> DataFrame:
    """De-duplicated merge with the timestamp coerced (bad -> NULL) and ISO
    week, month and date added (Q35; ISO week, T30)."""
    df = dedupe_rows(c).withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))
    return df.withColumns({"week": F.weekofyear("timestamp"), "month": F.month("timestamp"),
                           "day": F.to_date("timestamp")})


# ------------------------------------------------------------ aggregates
def _side_sizes(c: Cleaned, distinct: bool):
    a = c.activity.dropDuplicates() if distinct else c.activity
    sp = subs_with_plans(c)
    sp = sp.dropDuplicates() if distinct else sp
    cu = c.customers.dropDuplicates() if distinct else c.customers
    return a, sp, cu


def engagement_by_customer(c: Cleaned) -> DataFrame:
    """Per customer of the raw merge (before de-duplication, T17): summed
    duration, event count, mean MRR and mean NPS (T4) - from per-side
    aggregates (see module doc)."""
    a, sp, cu = _side_sizes(c, distinct=False)
    A = a.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("a_rows"), F.count("event_type").alias("a_events"),
        F.sum("session_duration_sec").alias("a_dur"))
    S = sp.groupBy("customer_id").agg(F.count(F.lit(1)).alias("s_rows"), F.sum("mrr_usd").alias("s_mrr"),
                                      F.count("mrr_usd").alias("s_nmrr"))
    C = cu.groupBy("customer_id").agg(F.count(F.lit(1)).alias("c_rows"), F.sum("nps_score").alias("c_nps"),
                                      F.count("nps_score").alias("c_nnps"))
    j = A.join(S, "customer_id", "left").join(C, "customer_id", "left")
    fs = F.greatest(F.coalesce(F.col("s_rows"), F.lit(0)), F.lit(1))
    fc = F.greatest(F.coalesce(F.col("c_rows"), F.lit(0)), F.lit(1))
    return j.select(
        "customer_id",
        F.coalesce(F.col("a_dur") * fs * fc, F.lit(0.0)).alias("total_session"),
        (F.col("a_events") * fs * fc).alias("total_events"),
        (F.col("s_mrr") / F.col("s_nmrr")).cast("double").alias("avg_mrr"),
        (F.col("c_nps") / F.col("c_nnps")).cast("double").alias("avg_nps"))


def engagement_score(c: Cleaned, eng: DataFrame | None = None) -> DataFrame:
    """Min-max scaled total_session, total_events, avg_nps (with the 1e-9
    guard, T39) and their mean as ``engagement_score`` (assumption A1)."""
    eng = eng if eng is not None else engagement_by_customer(c)
    # one row a customer, read for the bounds and again for the score
    eng = materialise(eng)
    cols = ["total_session", "total_events", "avg_nps"]
    mm = eng.agg(*[F.min(x).alias(f"mn_{x}") for x in cols], *[F.max(x).alias(f"mx_{x}") for x in cols]).first()
    norms = {}
    for x in cols:
        lo, hi = mm[f"mn_{x}"], mm[f"mx_{x}"]
        norms[f"{x}_norm"] = ((F.col(x) - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + F.lit(1e-9))).cast("double") \
            if lo is not None else F.lit(None).cast("double")
    out = eng.withColumns(norms)
    return out.withColumn("engagement_score",
                          (F.col("total_session_norm") + F.col("total_events_norm") + F.col("avg_nps_norm")) / 3)


def customer_features(c: Cleaned) -> DataFrame:
    """Per customer of the de-duplicated merge: total session time, row
    count, mean MRR and mean NPS with missing values as 0 (T21, T22)."""
    a, sp, cu = _side_sizes(c, distinct=True)
    A = a.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("a_rows"),
        F.sum(F.coalesce(F.col("session_duration_sec").try_cast("double"), F.lit(0.0))).alias("a_dur"))
    S = sp.groupBy("customer_id").agg(F.count(F.lit(1)).alias("s_rows"),
                                      F.sum(F.coalesce(F.col("mrr_usd").cast("double"), F.lit(0.0))).alias("s_mrr"))
    C = cu.groupBy("customer_id").agg(F.count(F.lit(1)).alias("c_rows"),
                                      F.sum(F.coalesce(F.col("nps_score").try_cast("double"), F.lit(0.0))).alias("c_nps"))
    j = A.join(S, "customer_id", "left").join(C, "customer_id", "left")
    fs = F.greatest(F.coalesce(F.col("s_rows"), F.lit(0)), F.lit(1))
    fc = F.greatest(F.coalesce(F.col("c_rows"), F.lit(0)), F.lit(1))
    return j.select(
        "customer_id",
        F.coalesce(F.col("a_dur") * fs * fc, F.lit(0.0)).alias("total_session_time"),
        F.coalesce(F.col("a_rows") * fs * fc, F.lit(0)).cast("long").alias("total_events"),
        F.coalesce(F.col("s_mrr") / F.col("s_rows"), F.lit(0.0)).alias("avg_revenue"),
        F.coalesce(F.col("c_nps") / F.col("c_rows"), F.lit(0.0)).alias("avg_nps"))


def winsorized_features(features: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip each feature to its exact ``lo``/``hi`` quantiles (Q39), all
    bounds selected together."""
    cols = {}
    q = multi_quantiles(features, {f"{end}_{x}": (x, p) for x in FEATURES for end, p in (("lo", lo), ("hi", hi))})
    for x in FEATURES:
        if q[f"lo_{x}"] is None:
            cols[x] = F.col(x)
            continue
        clipped = F.greatest(F.lit(q[f"lo_{x}"]), F.least(F.col(x), F.lit(q[f"hi_{x}"])))
        cols[x] = F.when(F.col(x).isNotNull(), clipped).cast("double")
    return features.withColumns(cols)


def scaled_features(features: DataFrame) -> DataFrame:
    """z-scores with the population standard deviation; a zero deviation
    divides by 1 (as the notebook's scaler does) (Q40)."""
    st = features.agg(*[F.avg(x).alias(f"m_{x}") for x in FEATURES],
                      *[F.stddev_pop(x).alias(f"s_{x}") for x in FEATURES]).first()
    cols = []
    for x in FEATURES:
        m, s = st[f"m_{x}"], st[f"s_{x}"]
        s = 1.0 if (s is None or s == 0) else s
        cols.append(((F.col(x) - F.lit(m)) / F.lit(s)).alias(f"{x}_scaled"))
    return features.select("customer_id", *cols)


# ------------------------------------------------------------ Domain adapters
def q_activity_enriched(d: Domain):
    return activity_enriched(Cleaned(d))


def q_engagement_by_customer(d: Domain):
    return engagement_by_customer(Cleaned(d))


def q_engagement_score(d: Domain):
    return engagement_score(Cleaned(d))


def q_dedupe_rows(d: Domain):
    return dedupe_rows(Cleaned(d))


def q_calendar_features(d: Domain):
    return calendar_features(Cleaned(d))


def q_customer_features(d: Domain):
    return customer_features(Cleaned(d))


def q_winsorized(d: Domain):
    return winsorized_features(materialise(customer_features(Cleaned(d))))


def q_scaled(d: Domain):
    return scaled_features(materialise(winsorized_features(materialise(customer_features(Cleaned(d))))))
