"""Exact quantiles with linear interpolation by digit selection, any number of columns and
probabilities at once.

pandas' ``quantile``/``median`` (and SQL ``quantile_cont``) interpolate between the
order statistics ``k0 = floor((n - 1) p)`` and ``k0 + 1``.  Each is selected like a
radix sort would, without sorting: a double has a 64-bit image that orders as
the double does (sign, exponent, mantissa), and five passes fix its digits from the
highest on, 12 bits and four times 13.  A pass counts, for the wanted prefixes only,
how many values have each next digit: one partially aggregated ``groupBy`` of at most
8,192 groups a prefix, whatever the data, so gaps, long tails, ties and a single hot
value change nothing, and no value is ever gathered or ordered.  The driver
receives those counts and picks the digits.  All columns and probabilities
share the five passes, and those read the images, which are written once.
"""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.exprs import as_double
from churnlens.plans.session import materialise

#: Bits below the digits of each pass.
SHIFTS = (52, 39, 26, 13, 0)
_INF = 2047 << 52


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def _guess(a: Column) -> Column:
    """About the exponent of ``a``: the logarithm may round across a power of two."""
    return F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022)).cast("int")


def _exponent(a: Column, guess: Column) -> Column:
    return F.when(a < _power(guess), F.greatest(guess - 1, F.lit(-1022))).when((guess < 1023) & (a >= _power(guess + 1)), guess + 1).otherwise(guess)


def _image(x: Column, a: Column, e: Column) -> Column:
    # below the smallest exponent the leading bit is 0, which is the image of those numbers
    bits = (e.cast("long") + 1022) * F.lit(1 << 52) + (a / _power(e) * F.lit(float(1 << 52))).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(_INF)).otherwise(bits)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -size - 1).otherwise(size))


def ordered_bits(x: Column) -> Column:
    """The long that orders as the double ``x`` does; both zeros give 0, NULL and NaN give NULL."""
    a = F.abs(x)
    return _image(x, a, _exponent(a, _guess(a)))


def ordered_columns(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``ordered_bits`` of the columns as ``u0``, ``u1``, ...: step by step, so that no step's
    expression is worked out again at each place where the next one names it."""
    n = range(len(columns))
    c = lambda name, i: F.col(f"{name}{i}")
    out = df.select(*[x.alias(f"x{i}") for i, x in enumerate(columns)])
    out = out.select("*", *[F.abs(c("x", i)).alias(f"a{i}") for i in n])
    out = out.select("*", *[_guess(c("a", i)).alias(f"g{i}") for i in n])
    out = out.select("*", *[_exponent(c("a", i), c("g", i)).alias(f"e{i}") for i in n])
    return out.select(*[_image(c("x", i), c("a", i), c("e", i)).alias(f"u{i}") for i in n])


def from_bits(u: int) -> float:
    """The double of an ordered image."""
    size = -u - 1 if u < 0 else u
    value = struct.unpack(">d", struct.pack(">q", size))[0]
    return -value if u < 0 else value


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    k = math.floor(h)
    return k, min(k + 1, n - 1), h - k


def multi_quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]]) -> dict[str, float | None]:
    """The quantile of each name's (column, probability); NULL and NaN are ignored, a
    column without values gives None.  The images are written once, from one pass over ``df``,
    and the five aggregations read those."""
    columns: dict[str, tuple[int, Column]] = {}
    for c, _ in wanted.values():
        columns.setdefault(str(c), (len(columns), as_double(c)))
    values = ordered_columns(df, [x for _, x in columns.values()])
    long = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"u{i}").alias("u")) for i, _ in columns.values()])))
    long = materialise(long, "images").where(F.col("u").isNotNull())
    # (column, rank) -> (digits so far, values before them)
    at: dict[tuple[int, int], tuple[int, int]] = {}
    sizes: dict[int, int] = {}
    for shift, before in zip(SHIFTS, (None, *SHIFTS[:-1]), strict=True):
        rows = long
        if before is not None:
            if not at:
                break
            by: dict[int, set[int]] = {}
            for (c, _), (digits, _) in at.items():
                by.setdefault(c, set()).add(digits)
            rows = rows.where(reduce(lambda a, b: a | b, [
                (F.col("c") == c) & F.shiftright("u", before).isin(sorted(d)) for c, d in by.items()]))
        counts = rows.groupBy("c", F.shiftright("u", shift).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        found: dict[tuple[int, int | None], list[tuple[int, int]]] = {}
        for r in counts:
            found.setdefault((r["c"], None if before is None else r["d"] >> (before - shift)), []).append((r["d"], r["n"]))
        if before is None:
            sizes = {c: sum(n for _, n in found[c, None]) for c, _ in found}
            for c, p in wanted.values():
                i = columns[str(c)][0]
                if i in sizes:
                    at |= {(i, k): (0, 0) for k in _ranks(sizes[i], p)[:2]}
        for group in found.values():
            group.sort()
        for (c, k), (digits, base) in at.items():
            for d, n in found[c, None if before is None else digits]:
                if k < base + n:
                    at[c, k] = (d, base)
                    break
                base += n
    out: dict[str, float | None] = {}
    for name, (c, p) in wanted.items():
        i = columns[str(c)][0]
        if i not in sizes:
            out[name] = None
            continue
        k0, k1, part = _ranks(sizes[i], p)
        lo, hi = from_bits(at[i, k0][0]), from_bits(at[i, k1][0])
        out[name] = lo if lo == hi else lo + (hi - lo) * part
    return out


def quantile_values(df: DataFrame, column, probs: dict[str, float]) -> dict[str, float | None]:
    """Quantiles of one column, one value per name in ``probs``."""
    return multi_quantiles(df, {name: (column, p) for name, p in probs.items()})


def quantile_scalars(df: DataFrame, column, probs: dict[str, float]) -> dict:
    """``{name: Column}`` literal columns for use in expressions (a literal
    bound also reaches the parquet scan as a pushed filter)."""
    return {k: F.lit(v).cast("double") for k, v in quantile_values(df, column, probs).items()}
