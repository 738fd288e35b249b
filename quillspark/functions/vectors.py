"""Vector functions as column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12  # squared norms up to this count as zero


def _col(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_norm(a) -> Column:
    return _sum(F.transform(_col(a), lambda x: x * x))


def magnitude(a) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a, b) -> Column:
    """0 if either vector is zero; clamped to [-1, 1]."""
    na, nb = squared_norm(a), squared_norm(b)
    value = dot(a, b) / F.sqrt(na) / F.sqrt(nb)
    return F.when((na <= TINY) | (nb <= TINY), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)))


def cosine_normalized(a, b) -> Column:
    """Cosine of vectors that are of unit length already: their dot product, clamped to [-1, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def euclidean_score(a, b) -> Column:
    return 1 / (1 + euclidean(a, b))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def normalize(a) -> Column:
    """The unit vector; a zero vector raises."""
    size = magnitude(a)
    return F.when(squared_norm(a) <= TINY, F.raise_error(F.lit("a zero vector can't be normalized")).cast("array<double>")).otherwise(F.transform(_col(a), lambda x: x / size))


def is_normalized(a) -> Column:
    return F.abs(magnitude(a) - 1) <= 1e-4


def is_finite(a) -> Column:
    return ~F.exists(_col(a), lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))
