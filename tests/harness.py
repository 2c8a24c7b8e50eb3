"""Spark-vs-DuckDB comparison used by the tests and ``check_oracle.py``.

Mirrors the driver's check: same column names, same row count, and the same
multiset of rows after normalising values (floats rounded, decimals and
timestamps turned into comparable scalars).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
         "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in VIEWS:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=6):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def spark_rows(df):
    cols = df.columns
    return cols, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall()


def compare(spark_df, con, sql, digits=6):
    scols, srows = spark_rows(spark_df)
    dcols, drows = duck_rows(con, sql)
    out = {"spark_cols": scols, "duck_cols": dcols, "spark_rows": len(srows), "duck_rows": len(drows)}
    if sorted(scols) != sorted(dcols):
        out["ok"] = False
        out["why"] = "columns differ"
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    sc = Counter(tuple(_norm(r[i], digits) for i in order) for r in srows)
    dc = Counter(tuple(_norm(r[i], digits) for i in dorder) for r in drows)
    out["ok"] = sc == dc
    if not out["ok"]:
        out["why"] = "values differ"
        out["only_spark"] = list((sc - dc).items())[:5]
        out["only_duck"] = list((dc - sc).items())[:5]
    return out
