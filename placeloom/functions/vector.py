"""Vector expressions over arrays of numbers; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products, in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector divided by its length; a zero vector is left as it is."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine clipped to [-1, 1]; a zero vector counts as length 1."""
    one = lambda n: F.when(n > 0, n).otherwise(1.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / one(norm(a)) / one(norm(b))))


def distance(*pairs: tuple[str | Column, str | Column]) -> Column:
    """Euclidean distance over pairs of coordinates."""
    total = None
    for a, b in pairs:
        d = _c(a) - _c(b)
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def spatio_semantic(d: Column, cos: Column, alpha: float, r_max: float | None = None) -> Column:
    """alpha * d (over r_max, if given) + (1 - alpha) * (1 - cosine)."""
    return alpha * (d / r_max if r_max else d) + (1 - alpha) * (1 - cos)


def proximity(d: Column, sigma: float) -> Column:
    """exp(-(d / sigma)^2)."""
    return F.exp(-F.pow(d / sigma, 2))


def floored(geodesic: Column, euclid: Column) -> Column:
    """A path length is never under the straight line; unreachable or unknown falls back on it."""
    return F.when(geodesic.isNotNull() & (geodesic < F.lit(float("inf"))), F.greatest(geodesic, euclid)).otherwise(euclid)


def separability(geodesic: Column, euclid: Column) -> Column:
    """Detour factor; 1 for points that coincide."""
    return F.when(euclid > 1e-6, geodesic / euclid).otherwise(1.0)
