"""Two-sided tail of Student's t as a column expression.

With theta = atan(x / sqrt(df)) the density is proportional to cos(theta) ** (df - 1),
so the tail beyond |t| is the ratio of two integrals of that power, from |t| and
from 0.  Scaled by sqrt(df) the integrand is about exp(-u * u / 2) however large df
is, and log(cos) is taken as log1p(-2 * sin(theta / 2) ** 2), which loses no digits
for small angles.  Simpson's rule over ``STEPS`` steps gives both; nothing is
iterated to convergence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Simpson's rule (even) and the width beyond which the integrand is nil.
STEPS, WIDTH = 2000, 20.0


def _integral(lo: Column, dof: Column) -> Column:
    root = F.sqrt(dof)
    hi = F.least(F.lit(math.pi / 2) * root, lo + WIDTH)
    step = F.greatest(hi - lo, F.lit(0.0)) / STEPS

    def term(i: Column) -> Column:
        half = F.sin((lo + step * i) / root / 2)
        value = F.exp((dof - 1) * F.log1p(-2 * half * half))
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        # log1p(-1), a right angle, is null: the power is 0, or 1 for one degree of freedom
        return weight * F.coalesce(value, F.when(dof <= 1, 1.0).otherwise(0.0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda a, i: a + term(i)) * step / 3


def p_value(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|); null where ``t`` or ``dof`` is null or NaN or dof < 1."""
    t, dof = t.cast("double"), dof.cast("double")
    ok = t.isNotNull() & dof.isNotNull() & ~F.isnan(t) & ~F.isnan(dof) & (dof >= 1)
    lo = F.atan(F.abs(t) / F.sqrt(dof)) * F.sqrt(dof)
    return F.when(ok, F.least(_integral(lo, dof) / _integral(F.lit(0.0), dof), F.lit(1.0)))
