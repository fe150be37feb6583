"""Vector arithmetic on array columns, and scores from distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero. Norms that are at hand save computing them."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def similarity_score(cos: Column, rule: str = "half") -> Column:
    """(1 + cos) / 2, or the cosine itself under the rule raw."""
    return cos if rule == "raw" else (F.lit(1.0) + cos) / 2


def distance_score(d: Column) -> Column:
    """1 at distance 0, a half at 1, towards 0 beyond."""
    return F.lit(1.0) - F.lit(2 / math.pi) * F.atan(d)
