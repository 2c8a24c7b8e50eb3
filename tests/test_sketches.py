"""Percentiles of merged sketches against exact ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from churnlens.operators import sketches
from churnlens.sources.bindings import Domain
from tests.conftest import SF01


def test_weeks_added_later_give_the_exact_ranks_within_the_error(spark, tmp_path):
    a = Domain(spark, SF01).activity()
    path = str(tmp_path / "kept")
    for part in range(3):  # records come in three parts; old ones are not read again
        sketches.append_weeks(a.where(F.pmod(F.dayofyear("timestamp"), F.lit(3)) == part), path)
    got = {r["subscription_tier"]: r for r in sketches.session_percentiles(spark.read.parquet(path)).collect()}
    rows = a.select("subscription_tier", "session_duration_sec").collect()
    assert sum(r["records"] for r in got.values()) == len(rows)
    for tier, r in got.items():
        values = np.sort([x["session_duration_sec"] for x in rows if x["subscription_tier"] == tier])
        for p in (25, 50, 75):
            lo, hi = (np.searchsorted(values, r[f"p{p}_session_duration"], side) / len(values) for side in ("left", "right"))
            assert lo - 0.005 <= p / 100 <= hi + 0.005


def test_no_records(spark):
    a = Domain(spark, SF01).activity()
    assert sketches.session_percentiles(sketches.sketch_sessions(a.limit(0))).collect() == []
    none = a.limit(5).withColumn("session_duration_sec", F.lit(None).cast("double"))
    assert all(r["p50_session_duration"] is None for r in sketches.session_percentiles(sketches.sketch_sessions(none)).collect())
