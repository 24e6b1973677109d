"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty vector, for different lengths and for a zero norm."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))
