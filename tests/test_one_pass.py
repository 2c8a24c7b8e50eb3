"""Work that several steps need is run once (findings F1 to F6 of round 3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from churnlens.operators import features, quality
from churnlens.plans.quantiles import multi_quantiles, ordered_bits, ordered_columns
from churnlens.sources.sinks import content_digest, export_verified

ACTIVITY = ("_id string, customer_id long, member_id long, event_type string, session_duration_sec double, "
            "timestamp string, subscription_tier string")


@pytest.fixture
def counted(spark):
    """A function that makes a table which counts the rows it gives, and that count."""
    seen = spark.sparkContext.accumulator(0)

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema).coalesce(1)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    return make, seen


def _activity(n):
    return [(f"a{i}", i % 3, i, "view", float(i), "2024-01-01 00:00:00", "free") for i in range(n)]


def test_quantiles_run_their_input_once(counted):
    make, seen = counted
    got = multi_quantiles(make([(float(i), float(-i)) for i in range(11)], "x double, y double"),
                          {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("y", 0.5)})
    assert got == {"a": 2.5, "b": 5.0, "c": -5.0}
    assert seen.value == 11


def test_clean_activity_reads_the_collection_once(counted):
    make, seen = counted
    out = quality.clean_activity(make(_activity(12), ACTIVITY))
    assert out.count() == 12 and out.count() == 12
    assert seen.value == 12


def test_materialise_runs_the_work_once(counted):
    make, seen = counted
    assert features.materialise(make([(1,), (None,)], "x long")).count() == 2
    assert seen.value == 2


def test_export_makes_each_table_once(spark, tmp_path, counted):
    make, seen = counted
    rows = [(i, f' "t", \n{i}' if i % 2 else None) for i in range(7)]
    got = export_verified({"t": make(rows, "k long, s string")}, str(tmp_path / "out")).collect()
    assert seen.value == 7
    assert [tuple(r) for r in got] == [("t", *content_digest(spark.createDataFrame(rows, "k long, s string")).first())]


def test_digest_is_the_sum_of_60_bits(spark):
    import hashlib

    df = spark.range(50).select(F.col("id").cast("string").alias("s"))
    want = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(50))
    assert tuple(content_digest(df).first()) == (50, str(want))
    assert tuple(content_digest(df.limit(0)).first()) == (0, "0")


def test_images_in_steps_are_the_images(spark):
    inf, nan = float("inf"), float("nan")
    xs = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, inf, -inf, nan, None, 8.0, 7.999999999999999]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    both = [r["u0"] for r in ordered_columns(df, [F.col("x")]).collect()]
    assert both == [r["u"] for r in df.select(ordered_bits(F.col("x")).alias("u")).collect()]


def test_duplicates_need_no_text_of_the_nulls(spark):
    cols = [f"c{i}" for i in range(130)]
    row = [None] * 130
    other = row.copy()
    other[129] = 0
    df = spark.createDataFrame([row, row, other], ", ".join(f"{c} long" for c in cols))
    assert quality.duplicate_profile(df).first()["duplicate_rows"] == 1
    assert df.select(*quality.row_digest(df)).distinct().count() == 2
    assert "concat" not in str(quality.row_digest(df)[0]).lower()


def test_dedupe_counts_heavy_keys_once_in_the_records(spark, counted):
    """The merge's heavy keys come from the cleaned records, not from a second de-duplication."""
    from churnlens.plans.joins import hot_left_join

    left = spark.createDataFrame([(1, i) for i in range(40)] + [(None, 1), (2, 1)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k long, w string")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, hot_left_join(left, [right], "k", shares=8, counted=left.union(left)).collect())) == want
