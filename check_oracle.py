"""Run registered queries in Spark and their SQL twins in DuckDB; report matches.

usage: python check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
import sys
import time

from churnlens.plans.session import build_session
from churnlens.registry import all_queries, all_sql
from tests.harness import compare, duck


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    qs, sql = all_queries(), all_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if k in sql:
                r = compare(df, con, sql[k])
                status = "OK" if r["ok"] else "MISMATCH"
            else:
                r = {"spark_rows": df.count()}
                status = "ROWS-ONLY"
        except Exception as e:  # report and continue
            r, status = {"error": str(e)[:400]}, "ERROR"
        if status in ("MISMATCH", "ERROR"):
            bad += 1
        print(json.dumps({"key": k, "status": status, "sec": round(time.time() - t, 2),
                          **{x: r.get(x) for x in ("spark_rows", "duck_rows", "why", "only_spark", "only_duck", "error", "spark_cols", "duck_cols") if r.get(x) is not None}},
                         default=str), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
