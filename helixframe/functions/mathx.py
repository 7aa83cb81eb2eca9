"""Scalar math missing from Spark SQL, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ln(n!) is exact from this table for n < 16 and from the Stirling series above.
_LOGFACT_TABLE = [math.lgamma(n + 1) for n in range(16)]


def log_factorial(n: Column) -> Column:
    """ln(n!) for integer n >= 0, to a few units in the last place: the absolute error grows with n ln n
    (about 1e-13 for n = 100, 4e-3 for n = 1e12, the spacing of doubles there)."""
    z = n.cast("double") + F.lit(1.0)
    stirling = ((z - F.lit(0.5)) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi))
                + F.lit(1.0) / (F.lit(12.0) * z)
                - F.lit(1.0) / (F.lit(360.0) * F.pow(z, 3))
                + F.lit(1.0) / (F.lit(1260.0) * F.pow(z, 5))
                - F.lit(1.0) / (F.lit(1680.0) * F.pow(z, 7)))
    table = F.array(*[F.lit(v) for v in _LOGFACT_TABLE])
    return F.when(n < 16, F.element_at(table, (n + 1).cast("int"))).otherwise(stirling)


def xlogx(x: Column) -> Column:
    """x * ln(x) with 0 ln 0 = 0."""
    xd = x.cast("double")
    return F.when(xd > 0, xd * F.log(xd)).otherwise(F.lit(0.0))
