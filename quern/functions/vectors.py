"""Vector distances as Catalyst expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(inner_product(a, b) / size)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """VECTOR_DISTANCE: smaller is nearer for every metric."""
    return {"l2": l2, "ip": lambda x, y: -inner_product(x, y), "cosine": lambda x, y: 1 - cosine(x, y)}[metric](a, b)


def similar(a: Column, b: Column, metric: str, threshold: float) -> Column:
    """VECTOR_SIMILAR: within a distance, or at least a similarity for ip and cosine."""
    return l2(a, b) <= threshold if metric == "l2" else {"ip": inner_product, "cosine": cosine}[metric](a, b) >= threshold


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)


def scale(a: Column, k: float) -> Column:
    return F.transform(_d(a), lambda x: x * k)


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, _d(a)).otherwise(F.transform(_d(a), lambda x: x / size))
