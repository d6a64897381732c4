"""Vector functions on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Raw dot product in double precision, summed in order; null for null or unequal lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def similarity(metric: str):
    if metric not in ("dot", "cosine"):
        raise ValueError("metric must be 'dot' or 'cosine'")
    return dot if metric == "dot" else cosine
