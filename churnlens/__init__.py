"""churnlens: subscription churn and retention analytics on Spark.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing is collected to the driver.  Sub-packages:

* ``sources``   - table loaders, document-collection readers, CSV/parquet sinks
                  and the bindings that derive the domain tables from the
                  driver's TPC-H-like tables.
* ``functions`` - column expressions (Sunday weeks, millisecond gaps, rounding,
                  t-distribution tail).
* ``plans``     - session settings, bounded broadcasts, lineage cuts and the
                  skew-safe window helpers (range-split lag and rank, exact
                  quantiles).
* ``operators`` - the user-level reports, cleaning steps, features, tests,
                  segments and KPIs.
* ``streaming`` - intentionally empty: the analysed project is batch only.
"""

__all__ = ["sources", "functions", "plans", "operators"]
