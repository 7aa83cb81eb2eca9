"""Vector math on ``array<double>`` columns (higher-order SQL functions).

All functions take and return Columns so they stay inside the JVM; no
Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("array<double>")


def vsum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(x, y) -> Column:
    return vsum(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def sqnorm(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v * v)


def norm(x) -> Column:
    return F.sqrt(sqnorm(x))


def scale(x, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(x), lambda v: v * s)


def add(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def sub(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a - b)


def mix(x, y, lam: float) -> Column:
    """lam * x + (1 - lam) * y (no re-normalisation)."""
    return F.zip_with(_c(x), _c(y),
                      lambda a, b: F.lit(lam) * a + F.lit(1.0 - lam) * b)


def l2_normalize(x, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps): a zero vector stays zero."""
    n = F.greatest(norm(x), F.lit(eps))
    return F.transform(_c(x), lambda v: v / n)


def cosine(x, y, eps: float = 1e-8) -> Column:
    """x.y / (max(||x||, eps) * max(||y||, eps))."""
    return dot(x, y) / (F.greatest(norm(x), F.lit(eps)) * F.greatest(norm(y), F.lit(eps)))


def sqeuclidean(x, y) -> Column:
    return vsum(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def euclidean(x, y) -> Column:
    return F.sqrt(sqeuclidean(x, y))


def cityblock(x, y) -> Column:
    return vsum(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def chebyshev(x, y) -> Column:
    return F.array_max(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def minkowski(x, y, p: float) -> Column:
    d = vsum(F.zip_with(_c(x), _c(y), lambda a, b: F.pow(F.abs(a - b), F.lit(p))))
    return F.pow(d, F.lit(1.0 / p))


def cosine_distance(x, y) -> Column:
    den = norm(x) * norm(y)
    return F.when(den == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(x, y) / den)


def braycurtis(x, y) -> Column:
    num = vsum(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))
    den = vsum(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a + b)))
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num / den)


def canberra(x, y) -> Column:
    return vsum(F.zip_with(
        _c(x), _c(y),
        lambda a, b: F.when((F.abs(a) + F.abs(b)) == 0, F.lit(0.0))
        .otherwise(F.abs(a - b) / (F.abs(a) + F.abs(b)))))


def arccos_distance(x, y) -> Column:
    """Euclidean distance of the normalised vectors (the chord, as the reference metric of that name)."""
    return euclidean(l2_normalize(x), l2_normalize(y))


def seuclidean(x, y, var) -> Column:
    """Standardised Euclidean; ``var`` is an array column of variances."""
    d = F.zip_with(_c(x), _c(y), lambda a, b: a - b)
    return F.sqrt(vsum(F.zip_with(d, _c(var), lambda a, v: F.when(v == 0, F.lit(float("nan")))
                                  .otherwise(a * a / v))))


def angular_similarity(x, y, temp: float, eps: float = 1e-6) -> Column:
    """(pi/2 - acos(clamp(cos, -(1-eps), 1-eps))) / temp."""
    c = F.least(F.greatest(cosine(x, y), F.lit(-(1 - eps))), F.lit(1 - eps))
    return (F.lit(math.pi / 2) - F.acos(c)) / F.lit(temp)


def round_vec(x, digits: int = 6) -> Column:
    return F.transform(_c(x), lambda v: F.round(v, digits) + F.lit(0.0))


DISTANCES = {
    "euclidean": euclidean, "l2": euclidean,
    "sqeuclidean": sqeuclidean,
    "cityblock": cityblock, "l1": cityblock, "manhattan": cityblock,
    "chebyshev": chebyshev, "infinity": chebyshev,
    "cosine": cosine_distance,
    "braycurtis": braycurtis, "canberra": canberra,
    "arccos": arccos_distance,
}


def distance(name: str, x, y, **kw) -> Column:
    if name in ("minkowski", "p"):
        return minkowski(x, y, kw.get("p", 2.0))
    if name == "seuclidean":
        return seuclidean(x, y, kw["var"])
    return DISTANCES[name](x, y)
