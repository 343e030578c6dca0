"""Columns over arrays of numbers; all arithmetic in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products; null if the lengths differ."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine, 0 if either vector is zero, null if the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def unit_score(cos: str | Column) -> Column:
    """A cosine on the scale 0 to 1 that graph stores report."""
    return (1 + _col(cos)) / 2


def blend(dense: str | Column, topology: str | Column, alpha: float = 0.7) -> Column:
    return alpha * _col(dense) + (1 - alpha) * _col(topology)


def softmax(scores: str | Column, temperature: float = 0.01) -> Column:
    """Softmax of an array, with the maximum taken off first so that nothing overflows."""
    s = _col(scores)
    e = F.transform(s, lambda x: F.exp((x - F.array_max(s)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))
