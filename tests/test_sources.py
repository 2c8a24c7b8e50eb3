"""Extended JSON, verified export, profiles and the catalog."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from churnlens.operators import quality as Q
from churnlens.sources import catalog
from churnlens.sources.bindings import Domain
from churnlens.sources.sinks import content_digest, export_verified
from churnlens.sources.tables import read_collection
from tests.conftest import SF001

PLAIN = [{"_id": "a", "customerId": 1, "memberId": 10, "nps_score": 9.5, "step": "x"}, {"_id": "b", "customerid": 2, "memberId": 11, "nps_score": 3},
         {"_id": "c", "customer_id": 3, "member_id": 12, "nps_score": None, "step": "y"}]


def _write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_extended_json_equals_plain(spark, tmp_path):
    extended = [{**d, "_id": {"$oid": d["_id"]}} for d in PLAIN]
    extended[0] |= {"customerId": {"$numberLong": "1"}, "memberId": {"$numberInt": "10"}, "nps_score": {"$numberDouble": "9.5"}}
    extended[1] |= {"nps_score": {"$numberDecimal": "3"}}
    before = spark.conf.get("spark.sql.caseSensitive")
    a = read_collection(spark, _write(tmp_path / "plain.json", PLAIN))
    b = read_collection(spark, _write(tmp_path / "extended.json", extended))
    assert spark.conf.get("spark.sql.caseSensitive") == before
    assert a.columns == b.columns and a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    clean = [sorted(map(str, Q.clean_documents(x).collect())) for x in (a, b)]
    assert clean[0] == clean[1] and "customer_id=2" in clean[0][1]


def test_dates_mixed_types_and_bad_lines(spark, tmp_path):
    path = _write(tmp_path / "c.json", [
        {"at": {"$date": "2024-01-05T06:07:08Z"}, "n": 1, "mixed": 1, "deep": {"a": 1}}, {"at": {"$date": {"$numberLong": "1704434828000"}}, "n": 2.5, "mixed": "x"},
        {"at": {"$date": 1704434828000}, "n": {"$numberLong": "3"}, "mixed": True}, "{broken", "[1, 2]", "{}"])
    df = read_collection(spark, path, rescue="_bad")
    assert dict(df.dtypes) == {"at": "timestamp", "n": "double", "mixed": "string", "deep": "struct<a:bigint>", "_bad": "string"}
    rows = df.collect()
    assert [r["at"] for r in rows[:3]] == [dt.datetime(2024, 1, 5, 6, 7, 8)] * 3 and [r["n"] for r in rows[:3]] == [1.0, 2.5, 3.0]
    assert [r["mixed"] for r in rows[:3]] == ["1", "x", "true"] and rows[0]["deep"]["a"] == 1
    assert [r["_bad"] for r in rows] == [None, None, None, "{broken", "[1, 2]", None]
    assert read_collection(spark, _write(tmp_path / "none.json", ["{bad"]), rescue="_bad").columns == ["_bad"]


def test_export_is_verified_before_it_is_published(spark, tmp_path, monkeypatch):
    rows = [(1, ' "a",\nb ', 1.5, None), (2, "", None, dt.datetime(2024, 1, 2, 3, 4, 5)), (2, "", None, dt.datetime(2024, 1, 2, 3, 4, 5))]
    df = spark.createDataFrame(rows, "id long, text string, x double, at timestamp_ntz")
    out = str(tmp_path / "out")
    m = export_verified({"t": df, "empty": df.limit(0)}, out).collect()
    assert [(r["table_name"], r["rows"]) for r in m] == [("t", 3), ("empty", 0)]
    assert m[0]["digest"] == content_digest(df.repartition(3)).first()["digest"] != content_digest(df.limit(2)).first()["digest"]
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_staging")} == {"t", "empty", "_manifest"}
    assert sorted(r["table_name"] for r in spark.read.json(f"{out}/_manifest").collect()) == ["empty", "t"]
    from churnlens.sources import sinks
    monkeypatch.setitem(sinks.CSV_WRITE, "escape", "\\")  # a writer that the reader does not undo
    with pytest.raises(RuntimeError):
        export_verified({"t": df}, str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "t").exists()


def test_duplicates_by_digest(spark):
    df = spark.createDataFrame([(None, "a", 1.0), ("a", None, 1.0), ("a", None, 1.0), ("", "a", 1.0), ("ab", "c", None), ("a", "bc", None)] , "a string, b string, c double")
    assert Q.duplicate_profile(df).first()[0] == df.count() - df.distinct().count() == 1


def test_catalog_and_previews(spark):
    d = Domain(spark, SF001)
    catalog.register(d)
    listed = {r["table_name"]: r["n_columns"] for r in catalog.list_tables(spark).collect()}
    assert listed == {t: len(getattr(d, t)().columns) for t in catalog.TABLES} and catalog.current_database(spark) == "default"
    assert spark.table("churnlens_plans").count() == 5
    for name in ("customers", "raw_surveys"):
        assert Q.table_preview(d, name, 3).count() == 3
    with pytest.raises(ValueError):
        Q.table_preview(d, "nothing")
    assert Q.q_table_previews(d, 2).groupBy("table_name").agg(F.count("place").alias("n")).where("n <> 2").count() == 0
