"""Fixtures for results that were wrong once: ids merged from any spelling, CSV
that round-trips, t-tests on small groups and customers without subscriptions."""

import csv
import glob

import pytest

from churnlens.operators import quality, stats
from churnlens.plans import session
from churnlens.sources.sinks import CSV_READ, export_tables, read_back_counts


@pytest.mark.parametrize("names", [("customerId", "customerid", "customer_id"), ("customer_id", "CUSTOMERID", "customerId")])
def test_ids_of_any_spelling(spark, names):
    raw = spark.createDataFrame([("a", 5, None, None, 1), ("b", None, 6, None, 2), ("c", None, None, 7, 3)],
                                ["_id", "x", "y", "z", "memberId"]).toDF("_id", *names, "memberId")
    out = quality.clean_documents(raw)
    assert sorted(out.columns) == ["customer_id", "member_id"]
    assert sorted(r.customer_id for r in out.collect()) == [5, 6, 7]


def test_own_columns_with_dup_in_the_name_stay(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "a__dup_of_b", "a__dup1"])
    assert quality.drop_repeated(df).columns == ["a", "a__dup_of_b"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, " lead trail "), (2, 'say "hi"'), (3, "two\nlines, and a comma"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    paths = export_tables({"t": df}, str(tmp_path))
    assert read_back_counts(spark, paths).first().rows == 5
    back = {r.id: r.text for r in spark.read.options(**CSV_READ).schema("id int, text string").csv(paths["t"]).collect()}
    assert back == {k: v or None for k, v in rows}  # CSV does not tell an empty text from none
    with open(glob.glob(f"{paths['t']}/*.csv")[0], newline="") as f:  # a plain CSV reader sees the same
        plain = {int(r["id"]): r["text"] for r in csv.DictReader(f)}
    assert plain == {k: v or "" for k, v in rows}


def _moments(spark, rows):
    return stats._moments(spark.createDataFrame(rows, "x double, w_a long, w_b long"), ["a", "b"])


@pytest.mark.parametrize("rows", [
    [(1.0, 1, 0), (2.0, 1, 0)],  # an empty group
    [(1.0, 1, 0), (2.0, 1, 0), (5.0, 0, 1)],  # a group of one
    [(1.0, 2, 0), (1.0, 1, 2)],  # no variance
    [],
])
def test_t_test_of_small_groups(spark, rows):
    t, dof = stats._welch("a", "b")
    r = stats._finish(_moments(spark, rows), t, dof).first()
    assert (r.t_statistic, r.p_value, r.reject_h0) == (None, None, False)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
