"""Dense-vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has length 0."""
    scale = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.coalesce(F.try_divide(dot(a, b), scale), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def running_mean(mean: Column, count: Column, vector: Column) -> Column:
    """Mean after one more vector joins ``count`` earlier ones."""
    return F.zip_with(_doubles(mean), _doubles(vector), lambda m, x: (m * count + x) / (count + 1))


def drift_band(drift: Column, high: float = 0.3, moderate: float = 0.15) -> Column:
    return F.when(drift > high, "high").when(drift > moderate, "moderate").otherwise("stable")


def silhouette_band(score: Column) -> Column:
    return (F.when(score >= 0.7, "strong").when(score >= 0.5, "reasonable")
            .when(score >= 0.25, "weak").otherwise("none"))
