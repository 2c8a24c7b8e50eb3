"""The domain tables as views of the current database (survey S4).

``register`` makes one temporary view a table and collection; ``list_tables`` and
``current_database`` answer what a console's listing does, through Spark's catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.sources.bindings import Domain

#: The prefix of the views, so that a session's own tables keep their names.
PREFIX = "churnlens_"
TABLES = ("customers", "subscriptions", "plans", "billing_invoices", "support_tickets", "team_members", "feature_flags",
          "raw_activity", "raw_surveys", "raw_onboarding")


def register(d: Domain) -> None:
    """Views of all domain tables; they stay lazy, so nothing is read."""
    for name in TABLES:
        getattr(d, name)().createOrReplaceTempView(PREFIX + name)


def current_database(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()


def list_tables(spark: SparkSession) -> DataFrame:
    """Rows (database, table_name, n_columns) of the registered views."""
    rows = [(current_database(spark), t.name.removeprefix(PREFIX), len(spark.table(t.name).columns))
            for t in spark.catalog.listTables() if t.name.startswith(PREFIX)]
    return spark.createDataFrame(rows, "database string, table_name string, n_columns int")
