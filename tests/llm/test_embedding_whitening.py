"""Whitening against numpy's covariance and exact sums; the update against a dense solver; odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import embedding_whitening as ew
from churnlens.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(rows, ids, c, components=32):
    """The rows against a second computation from the entries ``c`` (n x d)."""
    x = np.floor(64 * c.astype(np.float64)).astype(np.int64) + 1_000_000
    n, d = x.shape
    s = [sum(col) for col in x.T.tolist()]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x.tolist()])
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    many = min(components, d)
    assert len(rows) == n * many and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    dev = {i: sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in zip(ids, x.tolist(), strict=True)}
    assert all(r["deviation"] == dev[r["vec_id"]] for r in rows)
    white = np.full((n, many), np.nan)
    at = {i: k for k, i in enumerate(ids)}
    for r in rows:
        if r["whitened"] is not None:
            white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / cov.trace(), rel=1e-9, abs=1e-12)
    good = e[:many] > 1e-10 * e[0]
    assert np.isnan(white[:, ~good]).all() and not np.isnan(white[:, good]).any()
    w = white[:, good]
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-9 and rows[0]["identity_error"] < 1e-9
    for k in np.flatnonzero(good):
        alone = min([abs(e[k] - e[j]) for j in range(d) if j != k], default=1) > 1e-6 * e[0]
        want = z @ v[:, k] / np.sqrt(e[k])
        if alone:
            assert np.abs(white[:, k] - want * np.sign(want @ white[:, k])).max() < 1e-7


def test_query(spark):
    rows = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.01").collect()
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    check(rows, [r["vec_id"] for r in t], np.array([r["embedding"] for r in t]))


@pytest.mark.parametrize("case", ["random", "equal", "spikes", "flat", "few"])
def test_update(case):
    rng = np.random.default_rng(7)
    d = 12
    rows = {"random": rng.normal(size=(400, d)), "equal": np.tile(np.eye(d), (6, 1)), "spikes": rng.normal(size=(300, d)) * 10.0 ** -np.arange(d),
            "flat": np.outer(rng.normal(size=50), np.ones(d)), "few": rng.normal(size=(5, d))}[case]
    s, folded = ew.Spectrum(d), ew.Spectrum(d)
    for r in rows:
        s.update(r)
    folded.fold(rows)
    want = np.linalg.eigvalsh(rows.T @ rows)
    for x in (s, folded):
        assert np.abs(x.values - want).max() <= 1e-12 * want[-1]
        assert np.abs(x.vectors.T @ x.vectors - np.eye(d)).max() < 1e-11
        assert np.abs((x.vectors * x.values) @ x.vectors.T - rows.T @ rows).max() <= 1e-12 * want[-1]


def test_secular_roots_interlace():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m = int(rng.integers(1, 40))
        d = np.cumsum(10.0 ** rng.uniform(-9, 2, m))
        z = rng.normal(size=m) * 10.0 ** rng.uniform(-5, 1, m)
        roots, apart = ew.secular_roots(d, z)
        assert (apart.diagonal() < 0).all() and (np.diag(apart, -1) > 0).all()
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(roots - want).max() <= 1e-13 * want[-1] * m


def test_odd_input(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(90, 5)).astype(np.float32)
    c[40:60] = c[0]  # repeated rows
    good = [(i, r.tolist(), 1) for i, r in enumerate(c)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 5, 1),
           (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    for name in ("n", "component", "id", "vector", "Value", "row"):
        df = df.withColumn(name, F.lit(1))
    check(ew.whiten(df.repartition(7)).collect(), list(range(90)), c)
    assert {r["component"] for r in ew.whiten(df, components=2).collect()} == {1, 2}
    # an id may be null and may repeat
    twice = spark.createDataFrame([(None, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (5, [3.0, 1.0], 0)], SCHEMA)
    assert sorted(str(r["vec_id"]) for r in ew.whiten(twice).collect()) == ["5"] * 4 + ["None"] * 2


def test_no_variance_and_nothing(spark):
    assert ew.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25, 1.0], 0) for i in range(4)], SCHEMA)
    rows = ew.whiten(same).collect()
    assert len(rows) == 12 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in rows)
    line = np.outer(np.arange(8), [1.0, 2.0, 0.0]).astype(np.float32)
    check(ew.whiten(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(line)], SCHEMA)).collect(), list(range(8)), line)
    huge = spark.createDataFrame([(1, [3e30], 0), (2, [-3e30], 0)], SCHEMA)
    assert [r["deviation"] for r in ew.whiten(huge).collect()] == [None, None]
