"""Two-sample t-tests on the engagement score (survey Q36, Q37; M1-M3).

The notebook tests on the rows of the de-duplicated merge (one row per
activity record x subscription, T8), where every row of a customer carries
that customer's score.  A group's moments are therefore weighted sums over
customers: weight = distinct records x matching subscription rows x customer
rows.  They come from per-customer aggregates; the one-row result gets its
p-value from ``functions.tdist``.  ``unit='customer'`` counts each customer
once per group instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.tdist import p_value
from churnlens.operators.features import Cleaned, engagement_score, materialise, subs_with_plans
from churnlens.sources.bindings import Domain

ALPHA = 0.05


def _weights(c: Cleaned, group_flags: dict[str, F.Column], unit: str, without_plan: str | None = None) -> DataFrame:
    """Per customer: score and the number of merged rows in each group.  A customer
    without subscriptions has one merged row per record; it counts in the group
    ``without_plan``, if any."""
    a = c.activity.dropDuplicates().filter(F.col("customer_id").isNotNull())
    A = a.groupBy("customer_id").agg(F.count(F.lit(1)).alias("a_rows"))
    sp = subs_with_plans(c).dropDuplicates()
    S = sp.groupBy("customer_id").agg(F.count(F.lit(1)).alias("s_rows"),
                                      *[F.sum(flag.cast("long")).alias(f"s_{g}") for g, flag in group_flags.items()])
    C = c.customers.dropDuplicates().groupBy("customer_id").agg(F.count(F.lit(1)).alias("c_rows"))
    score = engagement_score(c).select("customer_id", "engagement_score")
    j = A.join(S, "customer_id", "left").join(C, "customer_id", "left").join(score, "customer_id")
    fc = F.greatest(F.coalesce(F.col("c_rows"), F.lit(0)), F.lit(1))
    cols = [F.col("customer_id"), F.col("engagement_score").alias("x")]
    for g in group_flags:
        rows = F.when(F.col("s_rows").isNull(), F.lit(int(g == without_plan))).otherwise(F.coalesce(F.col(f"s_{g}"), F.lit(0)))
        cols.append((F.when(rows > 0, F.lit(1)).otherwise(F.lit(0)) if unit == "customer" else F.col("a_rows") * fc * rows).alias(f"w_{g}"))
    # one row a customer, which the passes over the moments read
    return materialise(j.select(*cols).filter(F.col("x").isNotNull() & ~F.isnan("x")))


def _moments(w: DataFrame, groups: list[str], nunique: bool = False) -> DataFrame:
    """n, mean and sample variance per group in two passes (mean first, then
    squared deviations) for numerical stability; one row."""
    m = w.agg(*[F.sum(f"w_{g}").alias(f"n_{g}") for g in groups],
              *[F.try_divide(F.sum(F.col(f"w_{g}") * F.col("x")), F.sum(f"w_{g}")).alias(f"mean_{g}") for g in groups],
              *([F.count_distinct(F.when(F.col(f"w_{g}") > 0, F.col("x"))).alias(f"nunique_{g}") for g in groups] if nunique else [])).first()
    dev = w.agg(*[F.sum(F.col(f"w_{g}") * (F.col("x") - F.lit(m[f"mean_{g}"]).cast("double")) ** 2).alias(f"ss_{g}") for g in groups])
    out = [F.lit(m[f"n_{g}"] or 0).cast("long").alias(f"n_{g}") for g in groups]
    if nunique:
        out += [F.lit(m[f"nunique_{g}"]).cast("long").alias(f"nunique_{g}") for g in groups]
    out += [F.lit(m[f"mean_{g}"]).cast("double").alias(f"mean_{g}") for g in groups]
    out += [F.try_divide(F.col(f"ss_{g}"), F.lit((m[f"n_{g}"] or 0) - 1).cast("double")).alias(f"var_{g}") for g in groups]
    return dev.select(*out)


def _finish(r: DataFrame, t, dof, extra_reject=None) -> DataFrame:
    r = r.withColumn("t_statistic", t).withColumn("df", dof)
    r = r.withColumn("p_value", p_value(F.col("t_statistic"), F.col("df")))
    reject = F.col("p_value") < ALPHA
    if extra_reject is not None:
        reject = reject & extra_reject
    return r.withColumn("reject_h0", F.coalesce(reject, F.lit(False)))


def _welch(a: str, b: str):
    """t and degrees of freedom; null for a group of fewer than two or without any variance."""
    va, vb = (F.try_divide(F.col(f"var_{g}"), F.col(f"n_{g}")) for g in (a, b))
    t = F.try_divide(F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.sqrt(va + vb))
    parts = F.try_divide(va ** 2, F.col(f"n_{a}") - 1) + F.try_divide(vb ** 2, F.col(f"n_{b}") - 1)
    return t, F.try_divide((va + vb) ** 2, parts)


def ttest_engagement_churn(c: Cleaned, unit: str = "row") -> DataFrame:
    """Welch test of engagement, active vs churned subscriptions (Q36)."""
    flags = {"active": F.col("is_churned") == F.lit(False), "churned": F.col("is_churned") == F.lit(True)}
    m = _moments(_weights(c, flags, unit), ["active", "churned"])
    return _finish(m, *_welch("active", "churned"))


def ttest_paid_free(c: Cleaned, unit: str = "row", equal_var: bool = True) -> DataFrame:
    """Pooled-variance test (as coded, T7), paid vs free; a missing tier
    counts as paid (pandas ``!=``, T20); reject only if paid is higher."""
    tier = F.lower(F.trim(F.col("plan_tier")))
    flags = {"paid": F.coalesce(tier != "free", F.lit(True)), "free": F.coalesce(tier == "free", F.lit(False))}
    w = _weights(c, flags, unit, without_plan="paid")
    m = _moments(w, ["paid", "free"], nunique=True)
    n1, n2 = F.col("n_paid"), F.col("n_free")
    if equal_var:
        sp2 = F.try_divide((n1 - 1) * F.col("var_paid") + (n2 - 1) * F.col("var_free"), n1 + n2 - 2)
        t = F.try_divide(F.col("mean_paid") - F.col("mean_free"), F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
        dof = (n1 + n2 - 2).cast("double")
    else:
        t, dof = _welch("paid", "free")
    return _finish(m, t, dof, F.col("mean_paid") > F.col("mean_free"))


def q_ttest_churn(d: Domain):
    return ttest_engagement_churn(Cleaned(d))


def q_ttest_paid_free(d: Domain):
    return ttest_paid_free(Cleaned(d))
