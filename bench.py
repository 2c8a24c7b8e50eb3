"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built (including its eager summary jobs, e.g. quantile bounds)
and fully executed with the ``noop`` sink, which runs the whole plan without
collecting rows.  Each headline query runs $BENCH_REPEAT times (default 3) and its
median counts; the further queries run once and are no part of the total.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnlens.plans.session import build_session  # noqa: E402
from churnlens.registry import all_queries  # noqa: E402

HEADLINE = [
    "plan_summary", "ltv_rank", "downgrade_risk", "monthly_growth_churn", "duplicate_accounts",
    "sessions_per_user_week", "feature_dau", "feature_retention", "onboarding_funnel", "upsell_targets",
    "clean_activity", "clean_customers", "customer_features", "engagement_score", "ttest_engagement_churn",
    "kpi_overview", "churn_by_plan", "retention_by_fiscal_year",
]
#: Reported beside the headline: the merge, its de-duplication, winsorising, segments, bands.
FURTHER = ["activity_enriched", "dedupe_rows", "winsorized_features", "customer_segments", "churn_by_engagement_band"]


def run(spark, fn, sf_dir):
    t = time.perf_counter()
    df = fn(spark, sf_dir)
    df.write.mode("overwrite").format("noop").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="churnlens-bench", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")})
    qs = all_queries()
    # warm-up: JVM, parquet footers, Python workers
    run(spark, qs["churn_by_plan"], sf_dir)
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    times = {k: round(statistics.median(run(spark, qs[k], sf_dir) for _ in range(repeat)), 3) for k in keys}
    further = {} if sys.argv[1:] else {k: round(run(spark, qs[k], sf_dir), 3) for k in FURTHER}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times | further, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
