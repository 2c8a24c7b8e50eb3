"""Sinks: CSV (header, no index column) or parquet export of cleaned tables
(survey Q43, S5).

Spark writes a directory of part files per table, one per partition, in
parallel; nothing is gathered into a single file on the driver.  ``export_verified``
writes to a staging folder, reads the files back, compares rows and a digest of their
content with the table's own, and only then gives the folder its name.
"""

from __future__ import annotations

import os
import uuid
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from churnlens.plans.session import ensure_checkpoint_dir


#: Quotes are doubled, blanks around values and line breaks in them kept: what any CSV reader undoes.
CSV_WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_READ = CSV_WRITE | {"multiLine": True, "nullValue": "", "emptyValue": ""}


def default_export_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temporary folder)."""
    return os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex)


def row_text(columns: list[str]) -> Column:
    """A row as text: its values, null as empty, between unit separators."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


#: The bits of an MD5 are summed in parts of so many, each in a long of its own.
PART_BITS = 20


def digest_columns(df: DataFrame) -> list[Column]:
    """Aggregates (rows, digest): the number of rows and, whatever their order, the sum over them
    of the first 60 bits of the MD5 of their text."""
    bits = F.conv(F.substring(F.md5(row_text(df.columns)), 1, 15), 16, 10).cast("long")
    parts = [F.sum(F.shiftright(bits, PART_BITS * k).bitwiseAND((1 << PART_BITS) - 1)) for k in range(3)]
    whole = [F.coalesce(p, F.lit(0)).cast("decimal(20,0)") * F.lit(Decimal(1 << PART_BITS * k)) for k, p in enumerate(parts)]
    return [F.count(F.lit(1)).alias("rows"), (whole[0] + whole[1] + whole[2]).cast("string").alias("digest")]


def content_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) of ``digest_columns``."""
    return df.agg(*digest_columns(df))


def export_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    paths = {}
    for name, df in tables.items():
        path = os.path.join(out_dir, name)
        w = df.write.mode("overwrite")
        if fmt == "csv":
            # CSV has no timestamp_ntz type: write its text form
            cols = [F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
            df.select(*cols).write.mode("overwrite").options(**CSV_WRITE).csv(path)
        else:
            w.parquet(path)
        paths[name] = path
    return paths


def read_back_counts(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    """Row count per exported table, read from the written files."""
    parts = []
    for name, path in paths.items():
        r = spark.read.options(**CSV_READ).csv(path) if fmt == "csv" else spark.read.parquet(path)
        parts.append(r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(new).getParent())
    if not system.rename(path(old), path(new)):
        raise RuntimeError(f"{new} is there already, or cannot be written")


def export_verified(tables: dict[str, DataFrame], out_dir: str) -> DataFrame:
    """Write the tables as CSV below ``out_dir`` and return the manifest (table_name, rows,
    digest), read from the written files and stored beside them.  A table whose files do not
    hold what it holds raises and is not published, nor is any other.  A table's own digest is
    observed while it is written, so that it is made once."""
    spark = next(iter(tables.values())).sparkSession
    staging = os.path.join(out_dir, f"_staging-{uuid.uuid4().hex}")
    seen = {name: Observation() for name in tables}
    paths = export_tables({name: df.observe(seen[name], *digest_columns(df)) for name, df in tables.items()}, staging)
    found = {}
    for name in tables:
        back = spark.read.options(**CSV_READ).csv(paths[name])
        want, got = seen[name].get, content_digest(back).first().asDict()
        if want != got:
            raise RuntimeError(f"{name}: {want['rows']} rows of digest {want['digest']} were written, {got['rows']} of {got['digest']} are read")
        found[name] = got
    manifest = spark.createDataFrame([(k, r["rows"], r["digest"]) for k, r in found.items()], "table_name string, rows long, digest string")
    manifest.coalesce(1).write.json(os.path.join(staging, "_manifest"))
    for name in [*tables, "_manifest"]:
        _rename(spark, os.path.join(staging, name), os.path.join(out_dir, name))
    return manifest
