"""Joins on keys of which one may hold a third of all rows.

``hot_left_join`` finds the heavy keys of the left side first: counts per key, combined
before the shuffle, keep the keys with more than one in ``16 P`` of all rows (P shuffle
partitions), so there are fewer than 16 P of them and their table may be broadcast.  Only those
keys are salted: a left row goes to one of about ``16 P count / rows`` shares by a hash of the row,
and the few right rows of the key are repeated once a share.  Every other row keeps
salt 0 and is shuffled as in a plain join.  Left rows with a null key match nothing and
are spread likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT, _SHARES = "_hot_salt", "_hot_shares"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def hot_keys(df: DataFrame, key: str, shares: int | None = None) -> DataFrame:
    """Rows (key, shares) of the keys with more than one in ``shares`` of the rows, fewer
    than ``shares`` of them: how many shares of the rows each one fills."""
    shares = shares or 16 * shuffle_partitions(df)
    total = df.where(F.col(key).isNotNull()).count()
    chunk = max(1, total // shares)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > chunk).select(key, F.ceil(F.col("_n") / chunk).cast("int").alias(_SHARES))


def hot_left_join(left: DataFrame, rights: list[DataFrame], key: str, shares: int | None = None,
                  counted: DataFrame | None = None) -> DataFrame:
    """``left`` LEFT JOIN each of ``rights`` on ``key``, heavy keys of ``left`` split.  The
    joins share one placing of the left rows.  ``counted``: rows that hold ``left``'s and are cheaper
    to read, in which to look for the heavy keys."""
    shares = shares or 16 * shuffle_partitions(left)
    hot = F.broadcast(hot_keys(left if counted is None else counted, key, shares))
    place = F.xxhash64(*left.columns)
    salt = F.when(F.col(key).isNull(), F.pmod(place, F.lit(shares))).otherwise(F.coalesce(F.pmod(place, F.col(_SHARES)), F.lit(0)))
    out = left.join(hot, key, "left").withColumn(_SALT, salt.cast("int")).drop(_SHARES)
    for right in rights:
        each = (right.join(hot, key, "left")
                .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SHARES), F.lit(1)) - 1))).drop(_SHARES))
        out = out.join(each, [key, _SALT], "left")
    return out.drop(_SALT)


def is_small(df: DataFrame, most: int = 10_000) -> bool:
    """Whether ``df`` has at most ``most`` rows (counted no further)."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, marked for broadcast if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, most) else df
