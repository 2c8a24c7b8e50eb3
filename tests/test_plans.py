"""Skew-safe window helpers and exact quantiles against plain references."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.plans.joins import hot_keys, hot_left_join
from churnlens.plans.quantiles import from_bits, multi_quantiles, ordered_bits, quantile_values
from churnlens.plans.windows import lag_by_key, rank_desc, running_sum_by_key


def _hot_key_frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one key holds about a third of all rows
        k = 0 if rnd.random() < 0.34 else rnd.randint(1, 40)
        rows.append((k, rnd.randint(0, 50), i, rnd.choice(["a", "b", "c", None])))
    rows.append((None, 3, n + 1, "z"))
    rows.append((None, 1, n + 2, "y"))
    return spark.createDataFrame(rows, "k long, d long, id long, v string")


def test_lag_by_key_matches_window(spark):
    df = _hot_key_frame(spark)
    got = lag_by_key(df, "k", ["d", "id"], {"v": "prev_v", "d": "prev_d"}, num_partitions=16)
    w = Window.partitionBy("k").orderBy("d", "id")
    ref = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_d", F.lag("d").over(w))
    a = sorted(got.select("id", "prev_v", "prev_d").collect())
    b = sorted(ref.select("id", "prev_v", "prev_d").collect())
    assert a == b


def test_rank_desc_matches_window(spark):
    df = _hot_key_frame(spark).withColumn("g", (F.col("k") % 3))
    got = rank_desc(df, "g", "d", "r", num_partitions=16)
    ref = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(F.col("d").desc_nulls_last())))
    assert sorted(got.select("id", "r").collect()) == sorted(ref.select("id", "r").collect())


def _q(values, probs):
    return {str(p): float(np.quantile(values, p)) for p in probs}


@pytest.mark.parametrize("case", ["ties", "gap", "tail", "signs", "same", "many"])
def test_quantiles_match_numpy(spark, case):
    """Ties, a gap, a tail over 600 powers of ten, subnormal and huge numbers of both signs, one value, 150,000 rows."""
    rnd = np.random.default_rng(3)
    vals = {"ties": np.concatenate([rnd.exponential(100, 4000).round(2), np.zeros(1500)]),
            "gap": np.concatenate([rnd.normal(0, 1, 700), rnd.normal(1e12, 1, 701)]),
            "tail": 10.0 ** rnd.uniform(-300, 300, 900),
            "signs": np.concatenate([[5e-324, -5e-324, 1e-310, -1e-310, 0.0, -0.0, 1.7e308, -1.7e308, 2.0, -2.0, 1.0, -1.0, 4.0, 8.0, 0.5], rnd.normal(0, 1e-308, 60)]),
            "same": np.full(500, 7.25), "many": rnd.lognormal(0, 3, 150_000)}[case]
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    got = quantile_values(df, "x", {str(p): p for p in probs})
    for name, want in _q(vals, probs).items():
        assert got[name] == pytest.approx(want, rel=1e-12, abs=0 if want else 1e-300), name


def test_ordered_bits_order_and_round_trip(spark):
    rnd = np.random.default_rng(4)
    vals = np.concatenate([rnd.normal(0, 1, 200) * 10.0 ** rnd.integers(-320, 300, 200), 2.0 ** np.arange(-1074, 1024, 7),
                           np.nextafter(2.0 ** np.arange(-1000, 1000, 37), 0), [np.inf, -np.inf, 0.0, -0.0]])
    rows = spark.createDataFrame([(float(v),) for v in vals], "x double").select("x", ordered_bits(F.col("x")).alias("u")).collect()
    assert all(from_bits(r["u"]) == r["x"] for r in rows)
    by = sorted(rows, key=lambda r: r["u"])
    assert all(a["x"] <= b["x"] for a, b in zip(by, by[1:], strict=False))


def test_many_columns_share_five_passes(spark):
    df = spark.range(1000).select(*[(F.col("id") * (i + 1) % 97).cast("double").alias(f"c{i}") for i in range(4)], F.lit(None).cast("double").alias("none"))
    wanted = {f"{c}{p}": (c, p) for c in ("c0", "c1", "c2", "c3", "none") for p in (0.01, 0.99)}
    runs = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: runs.append(1) or collect(self)
        got = multi_quantiles(df, wanted)
    finally:
        type(df).collect = collect
    assert len(runs) == 5
    for i in range(4):
        v = [(k * (i + 1)) % 97 for k in range(1000)]
        assert got[f"c{i}0.01"] == pytest.approx(np.quantile(v, 0.01)) and got[f"c{i}0.99"] == pytest.approx(np.quantile(v, 0.99))
    assert got["none0.01"] is None and got["none0.99"] is None


def test_quantiles_empty_and_single(spark):
    assert quantile_values(spark.createDataFrame([], "x double"), "x", {"m": 0.5}) == {"m": None}
    assert quantile_values(spark.createDataFrame([(4.0,)], "x double"), "x", {"m": 0.5, "a": 0.01}) == {"m": 4.0, "a": 4.0}


def test_running_sum_matches_window(spark):
    df = _hot_key_frame(spark)
    order = [F.col("d").desc(), F.col("id")]
    got = running_sum_by_key(df, "k", order, "d", "s", num_partitions=16)
    ref = df.withColumn("s", F.sum("d").over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(got.select("id", "s").collect()) == sorted(ref.select("id", "s").collect())


def test_hot_left_join_splits_the_hot_key(spark):
    """With broadcasts off and a third of the rows under one key, no task gets twice the median."""
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 4000)
    left = spark.range(n).select(key.alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 4000, 2).select((F.col("id") - F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    other = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("c"))
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = hot_left_join(left, [right, other], "k")
        sizes = sorted(r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("a").alias("n")).collect())
        rows = sorted(map(str, got.select("k", "a", "b", "c").collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    want = left.join(right, "k", "left").join(other, "k", "left")
    assert rows == sorted(map(str, want.select("k", "a", "b", "c").collect()))
    assert hot_keys(left, "k", 100).collect()[0]["k"] == 7 and hot_keys(left, "k", 100).count() == 1
    assert hot_left_join(left.limit(0), [right], "k").count() == 0
