"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(left: Column, right: Column) -> Column:
    lengths = norm(left) * norm(right)
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))


def has_dimension(vector: Column, dimension: int) -> Column:
    """True for a complete vector of the collection's dimension."""
    return vector.isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
