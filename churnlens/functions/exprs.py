"""Column expressions shared by the operators.

All of them are built-in Spark expressions (whole-stage codegen friendly).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_text(x) -> Column:
    """Case- and blank-insensitive comparison form (assumption A2)."""
    return F.lower(F.trim(c(x)))


def sunday_week(ts) -> Column:
    """Week of year 0-53, weeks start on Sunday, days before the first
    Sunday are week 0 (the ``%U`` convention of the document store)."""
    t = c(ts)
    return F.floor((F.dayofyear(t) + F.lit(7) - F.dayofweek(t)) / F.lit(7)).cast("int")


def epoch_millis(ts) -> Column:
    """Milliseconds since the epoch of a TIMESTAMP_NTZ value (truncated, as a
    document-store date keeps milliseconds).  Independent of the session time
    zone, unlike ``unix_millis(cast(ts as timestamp))``."""
    return F.timestamp_diff("MILLISECOND", _epoch(), c(ts))


def seconds_between(start, end) -> Column:
    """(end - start) in seconds with millisecond resolution, as a double."""
    return (epoch_millis(end) - epoch_millis(start)).cast("double") / F.lit(1000.0)


def days_between(start, end) -> Column:
    """(end - start) in fractional days, millisecond resolution."""
    return (epoch_millis(end) - epoch_millis(start)).cast("double") / F.lit(86400000.0)


def parse_ts_strict(x) -> Column:
    """Text or timestamp -> TIMESTAMP_NTZ; bad text raises under ANSI mode
    (a document-store ``$toDate`` fails the pipeline on such text)."""
    return c(x).cast("timestamp_ntz")


def parse_ts_coerce(x) -> Column:
    """Text or timestamp -> TIMESTAMP_NTZ; bad or empty text -> NULL."""
    return c(x).try_cast("timestamp_ntz")


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero denominator (MySQL semantics)."""
    return F.try_divide(c(num), c(den))


def nan_to_null(x) -> Column:
    col = c(x)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def as_double(x) -> Column:
    """Numeric coercion with bad values -> NULL (``pd.to_numeric(errors='coerce')``)."""
    return nan_to_null(c(x).try_cast("double"))


def month_text(ts) -> Column:
    """First day of the month as 'yyyy-MM-01' text."""
    return F.date_format(c(ts), "yyyy-MM-01")


def day_text(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd")
