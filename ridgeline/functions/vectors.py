"""Vector arithmetic in built-in expressions: double precision, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """The larger the closer for cosine and dot, the smaller for l2. Null for different lengths and, with
    cosine, zero vectors."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    value = {"dot": dot, "l2": l2, "cosine": lambda a, b: F.try_divide(dot(a, b), norm(a) * norm(b))}[metric](a, b)
    return F.when(F.size(a) == F.size(b), value)
