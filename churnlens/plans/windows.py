"""Window computations that stay parallel when one window partition is huge.

``Window.partitionBy(k)`` sends every row of a key to one task.  That is fine
for many small keys, but two reports window over keys that can be very large:
RANK over ``plan_tier`` (a handful of tiers, each holding millions of
customers) and LAG over ``customer_id`` (one account may own a third of all
subscriptions).  Both helpers below split such partitions by *range*:

1. ``repartitionByRange(P, key, order...)`` samples the composite sort key, so
   a hot key is spread over many consecutive range partitions and rows with an
   identical sort key always land in the same one.
2. The window is evaluated per (key, range partition) - bounded work per task.
3. A table with one row per range partition (at most P rows, so a proven size
   bound) carries what crosses a partition boundary: the last row of the
   previous partition for LAG, the running row count for RANK.  It is
   broadcast back.

The range-partitioned rows are referenced twice (window and boundary table).
Spark's range partitioner seeds its sample with the RDD id, so two
executions of the same range exchange may draw different bounds; the
partitioned rows are therefore written once with ``checkpoint()`` (to the
shared ``spark.checkpoint.dir``) and both branches read that copy.  This also
cuts the lineage, so a lost executor does not recompute the upstream joins.
Only the columns the window needs are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.plans.session import ensure_checkpoint_dir

_PID = "_range_pid"


def _range_split(df: DataFrame, p: int, *sort_cols) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(p, *sort_cols).withColumn(_PID, F.spark_partition_id())
    return ranged.checkpoint(eager=True)


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def lag_by_key(df: DataFrame, key: str, order: list[Column | str], lag_cols: dict[str, str],
               num_partitions: int | None = None) -> DataFrame:
    """``LAG(src) OVER (PARTITION BY key ORDER BY order)`` for every
    ``src -> out`` in ``lag_cols``, without putting a whole key in one task.

    ``order`` must make rows of a key unique (add a tie-break column), as a
    LAG over ties is undefined anyway.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    p = _partitions(df, num_partitions)
    ranged = _range_split(df, p, F.col(key), *order_cols)

    w = Window.partitionBy(key, _PID).orderBy(*order_cols)
    local = ranged.withColumn("_rn", F.row_number().over(w))
    for src, out in lag_cols.items():
        local = local.withColumn(out, F.lag(src).over(w))

    # Last row of every non-empty range partition (<= P rows).
    srcs = list(lag_cols)
    order_struct = F.struct(F.col(key), *order_cols)
    last = ranged.groupBy(_PID).agg(
        F.max_by(F.struct(F.col(key).alias("k"), *[F.col(s) for s in srcs]), order_struct).alias("_last"))
    # Previous non-empty partition's last row: a window over <= P rows.
    carry = last.select(_PID, F.lag("_last").over(Window.orderBy(_PID)).alias("_carry"))

    j = local.join(F.broadcast(carry), _PID, "left")
    crosses = (F.col("_rn") == 1) & F.col("_carry").isNotNull() & F.col("_carry.k").eqNullSafe(F.col(key))
    for src, out in lag_cols.items():
        j = j.withColumn(out, F.when(crosses, F.col("_carry")[src]).otherwise(F.col(out)))
    return j.drop(_PID, "_rn", "_carry")


def rank_desc(df: DataFrame, group: str, value: str, out: str,
              num_partitions: int | None = None, mean: str | None = None) -> DataFrame:
    """``RANK() OVER (PARTITION BY group ORDER BY value DESC)`` (NULLS LAST)
    computed over range partitions, so a group with millions of rows is
    ranked by many tasks.  ``mean`` names a column for the group's mean, taken
    from the same checkpointed rows.

    For few, large groups (tiers): the tables of boundaries (at most P +
    groups rows) and of means (a row a group) are broadcast."""
    p = _partitions(df, num_partitions)
    ranged = _range_split(df, p, F.col(group), F.col(value).desc_nulls_last())
    w = Window.partitionBy(group, _PID).orderBy(F.col(value).desc_nulls_last())
    local = ranged.withColumn("_local_rank", F.rank().over(w))

    # Rows of the same group in earlier range partitions (<= P + groups rows).
    counts = ranged.groupBy(group, _PID).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(_PID)
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col(group).alias("_g"), F.col(_PID).alias("_p"), "_offset")
    cond = F.col(group).eqNullSafe(F.col("_g")) & (F.col(_PID) == F.col("_p"))
    j = local.join(F.broadcast(b), cond, "left").drop("_g", "_p")
    if mean:
        m = ranged.groupBy(F.col(group).alias("_g")).agg(F.avg(value).alias(mean))
        j = j.join(F.broadcast(m), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return (j.withColumn(out, (F.col("_local_rank") + F.coalesce(F.col("_offset"), F.lit(0))).cast("int"))
            .drop(_PID, "_local_rank", "_offset"))


def running_sum_by_key(df: DataFrame, key: str, order: list[Column], value: str, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY key ORDER BY order ROWS UNBOUNDED PRECEDING)``,
    over range partitions, so a key with very many rows is summed by many tasks.
    The table of boundaries has a row a range partition: the sum of its last key so far,
    which the next partition adds if it begins with that key."""
    p = _partitions(df, num_partitions)
    ranged = _range_split(df, p, F.col(key), *order)
    rows = Window.partitionBy(key, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_sum", F.sum(value).over(rows))

    # sums of each partition's last key: range partitions are in the order of the keys
    last = ranged.groupBy(_PID).agg(F.max(F.struct(F.col(key).alias("k"))).alias("_last"))
    sums = (ranged.join(F.broadcast(last), _PID).where(F.col(key).eqNullSafe(F.col("_last.k")))
            .groupBy(_PID, key).agg(F.sum(value).alias("_s")))
    so_far = F.sum("_s").over(Window.partitionBy(key).orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0))
    carry = (sums.withColumn("_upto", so_far).select(_PID, F.struct(F.col(key).alias("k"), F.col("_upto").alias("s")).alias("_end"))
             .withColumn("_carry", F.lag("_end").over(Window.orderBy(_PID))).select(_PID, "_carry"))
    same = F.col("_carry").isNotNull() & F.col("_carry.k").eqNullSafe(F.col(key))
    total = F.coalesce(F.col("_sum"), F.lit(0)) + F.when(same, F.coalesce(F.col("_carry.s"), F.lit(0))).otherwise(F.lit(0))
    return local.join(F.broadcast(carry), _PID, "left").withColumn(out, total).drop(_PID, "_sum", "_carry")
