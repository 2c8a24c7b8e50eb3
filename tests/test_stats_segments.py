"""The queries without an SQL twin: t-tests checked against moments computed
row by row in DuckDB from the literal merge, k-means against its invariants."""

import math

import numpy as np
import pytest

from churnlens.operators.features import FEATURES, Cleaned, customer_features, materialise, winsorized_features
from churnlens.operators.segments import fit_segments, segment_summary
from churnlens.operators.stats import ttest_engagement_churn, ttest_paid_free
from churnlens.oracle import queries as OQ
from churnlens.oracle.bindings import with_bindings
from churnlens.sources.bindings import Domain

SF = "/root/testdata/sf0.001"


def _rows_sql(select: str) -> str:
    body = f"""
SELECT {select}
FROM (SELECT DISTINCT * FROM merged) m JOIN score s ON m.customer_id = s.customer_id
WHERE s.engagement_score IS NOT NULL"""
    return with_bindings(body, *OQ._MERGE_DEPS, extra=OQ._WITH_MERGED + [("eng", OQ._ENG), ("score", OQ._ENG_SCORE)])


def _moments(con, cond):
    n, mean, var = con.execute(_rows_sql(
        f"COUNT(*), AVG(s.engagement_score), VAR_SAMP(s.engagement_score)") + f" AND ({cond})").fetchone()
    return n, mean, var


def test_welch_churn_matches_row_level_moments(spark, con001):
    r = ttest_engagement_churn(Cleaned(Domain(spark, SF))).collect()[0]
    na, ma, va = _moments(con001, "m.is_churned = false")
    nc, mc, vc = _moments(con001, "m.is_churned = true")
    assert (r.n_active, r.n_churned) == (na, nc)
    assert r.mean_active == pytest.approx(ma, rel=1e-9) and r.var_churned == pytest.approx(vc, rel=1e-9)
    t = (ma - mc) / math.sqrt(va / na + vc / nc)
    assert r.t_statistic == pytest.approx(t, rel=1e-9)
    assert 0.0 <= r.p_value <= 1.0 and r.reject_h0 == (r.p_value < 0.05)


def test_pooled_paid_free_matches_row_level_moments(spark, con001):
    r = ttest_paid_free(Cleaned(Domain(spark, SF))).collect()[0]
    paid = "coalesce(lower(trim(m.plan_tier)) <> 'free', true)"
    n1, m1, v1 = _moments(con001, paid)
    n2, m2, v2 = _moments(con001, f"NOT {paid}")
    assert (r.n_paid, r.n_free) == (n1, n2)
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t = (m1 - m2) / math.sqrt(sp2 * (1 / n1 + 1 / n2))
    assert r.t_statistic == pytest.approx(t, rel=1e-9) and r.df == n1 + n2 - 2
    assert r.reject_h0 == (r.p_value < 0.05 and m1 > m2)


def test_kmeans_invariants(spark):
    w = materialise(winsorized_features(materialise(customer_features(Cleaned(Domain(spark, SF))))))
    out, model, costs = fit_segments(w, k=3, n_init=4)
    rows = out.collect()
    assert {r.segment for r in rows} == {0, 1, 2}
    assert len(rows) == w.count()
    assert model.summary.trainingCost == pytest.approx(min(costs))
    summary = segment_summary(out).collect()
    assert [r.segment for r in summary] == [0, 1, 2]


def test_kmeans_of_three_clear_groups(spark):
    """Each start ends as the plain Lloyd iteration does, and the best finds the groups."""
    rng = np.random.default_rng(8)
    groups = np.repeat([[0, 0, 0, 0], [100, 5, 1, 9], [5, 90, 40, 1]], 40, axis=0) + rng.normal(0, 1, (120, 4))
    df = spark.createDataFrame([(i, *map(float, g)) for i, g in enumerate(groups)], "customer_id long, " + ", ".join(f"{x} double" for x in FEATURES))
    out, fit, costs = fit_segments(df, n_init=4)
    rows = {r["customer_id"]: r["segment"] for r in out.collect()}
    assert len({tuple(rows[i] for i in range(a, a + 40)) for a in (0, 40, 80)}) == 3
    assert all(len({rows[i] for i in range(a, a + 40)}) == 1 for a in (0, 40, 80))
    z = (groups - groups.mean(0)) / groups.std(0)
    near = ((z[:, None, :] - np.array(fit.centres)[None]) ** 2).sum(2)
    assert fit.trainingCost == pytest.approx(near.min(1).sum()) and min(costs) == pytest.approx(fit.trainingCost)
    for c in range(3):
        assert np.array(fit.centres[c]) == pytest.approx(z[near.argmin(1) == c].mean(0))
    few, _, _ = fit_segments(df.limit(2), n_init=2)
    assert sorted(r["segment"] for r in few.collect()) == [0, 1]
    assert fit_segments(df.limit(0), n_init=2)[0].collect() == []
