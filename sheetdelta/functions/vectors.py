"""Vector expressions for thumbnails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax_normalize(thumb: Column) -> Column:
    """Vector scaled to 0..255; a flat vector becomes all zero."""
    values = thumb.cast("array<double>")
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, (v - low) * 255.0 / (high - low)).otherwise(0.0))


def visual_similarity(a: Column, b: Column) -> Column:
    """1 - mse / 255^2, floored at 0; vectors of different size, and empty ones, give 0."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    mse = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.greatest(F.size(a), F.lit(1))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - mse / (255.0 * 255.0)))


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two token sets; two empty sets are equal."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )
