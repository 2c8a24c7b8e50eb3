"""Readers for the driver's parquet tables and for exported collections."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table.  Projections and filters applied by
    callers are pushed into the scan by Catalyst (ReadSchema/PushedFilters)."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, properties: dict | None = None) -> DataFrame:
    """Relational read over a connection (the notebook's ``read_sql``).

    The URL and credentials are arguments, never constants.  For large tables
    pass a numeric ``partition_column`` with bounds so the read is split into
    ``num_partitions`` parallel range queries instead of one connection.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 1)))
    return reader.load()


# The wrappers of extended JSON and the type each one stands for.
WRAPPERS = {"$oid": "string", "$date": "timestamp", "$numberLong": "long", "$numberInt": "long",
            "$numberDouble": "double", "$numberDecimal": "double"}
_PLAIN = {"BIGINT": "long", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string"}


def _path(name: str, wrapper: str | None = None) -> str:
    quoted = lambda x: f'["{x}"]' if "'" in x else f"['{x}']"
    return "$" + quoted(name) + (quoted(wrapper) if wrapper else "")


def _get(name: str, kind: str, wrapper: str | None = None) -> Column:
    return F.try_variant_get("_doc", _path(name, wrapper), kind)


def _wrapped(name: str, wrapper: str) -> Column:
    return _get(name, "variant", wrapper).isNotNull()


def collection_fields(docs: DataFrame) -> dict[str, str]:
    """Field names (exact case) and types of parsed documents (``_doc`` variant, ``_line``): one
    pass for the names, one for the types.  Wrapped and plain values of a field agree on
    a type; integers and fractions on double; anything else on string."""
    names = sorted(r["k"] for r in docs.select(F.explode(F.json_object_keys("_line")).alias("k")).distinct().collect())
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.max(_wrapped(n, w)).alias(f"w{i}_{j}") for j, w in enumerate(WRAPPERS)]
        plain = F.when(~F.greatest(*[_wrapped(n, w) for w in WRAPPERS]), _get(n, "variant"))
        aggs.append(F.schema_of_variant_agg(plain).alias(f"p{i}"))
    found = docs.agg(*aggs).first()
    fields = {}
    for i, n in enumerate(names):
        kinds = {k for j, k in enumerate(WRAPPERS.values()) if found[f"w{i}_{j}"]}
        plain = found[f"p{i}"]
        if plain and plain != "VOID":
            kinds.add(next((k for t, k in _PLAIN.items() if plain.startswith(t)), plain.replace("OBJECT<", "STRUCT<") if plain[0] in "OA" else "string"))
        fields[n] = kinds.pop() if len(kinds) == 1 else "double" if kinds == {"long", "double"} else "string"
    return fields


def _field(name: str, kind: str) -> Column:
    """A field's value, out of its wrapper if it has one."""
    millis = F.coalesce(_get(name, "long", "$date"), F.try_variant_get("_doc", _path(name, "$date") + "['$numberLong']", "long"))
    date = F.coalesce(F.timestamp_millis(millis), _get(name, "string", "$date").try_cast("timestamp"))
    if kind == "timestamp":
        return date
    if kind == "string":
        return F.coalesce(*[_get(name, "string", w) for w in WRAPPERS if w != "$date"], date.cast("string"), _get(name, "string"))
    if kind in ("long", "double"):
        return F.coalesce(*[_get(name, kind, w) for w, k in WRAPPERS.items() if k in ("long", "double")], _get(name, kind))
    return _get(name, kind)


def read_collection(spark: SparkSession, path: str, schema=None, rescue: str | None = None) -> DataFrame:
    """Read a document collection exported as JSON lines, plain or extended.

    A line is parsed to a variant, whose paths are case-sensitive, so documents may
    carry both ``customerId`` and ``customerid`` without any change of the session; later
    case variants get a positional ``__dupN`` suffix, and ``operators.quality`` merges all
    variants left to right.  Values in the wrappers of extended JSON (``$oid``, ``$date``,
    ``$numberLong`` ...) are taken out of them by typed extraction.  ``schema`` skips the two
    passes that find fields and types.  A line that is no document gives nulls, and itself in the
    column ``rescue`` if one is named."""
    docs = spark.read.text(path).select(F.col("value").alias("_line"), F.try_parse_json("value").alias("_doc"))
    whole = F.json_object_keys("_line").isNotNull()
    docs = docs.withColumn("_doc", F.when(whole, F.col("_doc")))
    fields = {f.name: f.dataType.simpleString() for f in schema.fields} if schema is not None else collection_fields(docs)
    seen: dict[str, int] = {}
    columns = []
    for name, kind in fields.items():
        k = seen.get(name.lower(), 0)
        seen[name.lower()] = k + 1
        columns.append(_field(name, {"bigint": "long"}.get(kind, kind)).alias(name if k == 0 else f"{name}__dup{k}"))
    if rescue:
        columns.append(F.when(F.col("_doc").isNull(), F.col("_line")).alias(rescue))
    return docs.select(*columns)
