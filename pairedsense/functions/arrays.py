"""Array functions for waveform windows and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_column


def json_list(text: Column | str, element: str = "double") -> Column:
    return F.from_json(as_column(text), f"array<{element}>")


def json_sum(text: Column | str) -> Column:
    return F.aggregate(json_list(text), F.lit(0.0), lambda acc, x: acc + x)


def peak_normalize(values: Column | str, epsilon: float = 1e-8) -> Column:
    """Divide by the largest magnitude when it exceeds epsilon."""
    values = as_column(values)
    peak = F.array_max(F.transform(values, lambda x: F.abs(x).cast("double")))
    return F.when(peak > epsilon, F.transform(values, lambda x: x.cast("double") / peak)).otherwise(
        F.transform(values, lambda x: x.cast("double"))
    )


def is_finite(values: Column | str) -> Column:
    inf = F.lit(float("inf"))
    return F.forall(as_column(values), lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < inf))


def nan_to_zero(values: Column | str) -> Column:
    inf = F.lit(float("inf"))

    def clean(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == inf) | x.isNull(), F.lit(0.0)).otherwise(x)

    return F.transform(as_column(values), clean)


def fit_length(values: Column | str, length: int) -> Column:
    """Centre crop, or zero pad with the odd element on the right."""
    values = F.transform(as_column(values), lambda x: x.cast("double"))
    size = F.size(values)
    cropped = F.slice(values, F.floor((size - length) / 2).cast("int") + 1, F.lit(length))
    left = F.greatest(F.floor((F.lit(length) - size) / 2).cast("int"), F.lit(0))
    right = F.greatest(F.lit(length) - size - left, F.lit(0))
    padded = F.concat(
        F.array_repeat(F.lit(0.0), left), values, F.array_repeat(F.lit(0.0), right)
    )
    return F.when(size >= length, cropped).otherwise(padded)


def chunk(values: Column | str, length: int, min_tail: int = 400) -> Column:
    """Split into pieces of ``length``; a tail below ``min_tail`` joins the piece before it."""
    values = as_column(values)
    size = F.size(values)
    full = F.floor(size / length).cast("int")
    tail = size - full * length
    pieces = F.greatest(full + F.when(tail >= min_tail, 1).otherwise(0), F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), pieces),
        lambda k: F.slice(
            values,
            (k - 1) * length + 1,
            F.when(k == pieces, F.greatest(size - (k - 1) * length, F.lit(0))).otherwise(F.lit(length)),
        ),
    )


def weighted_mean(vectors: Column | str, weights: Column | str) -> Column:
    """Mean of equally long vectors with one weight each."""
    vectors, weights = as_column(vectors), as_column(weights)
    pairs = F.arrays_zip(vectors.alias("v"), weights.alias("w"))
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    summed = F.aggregate(
        pairs,
        zero,
        lambda acc, p: F.zip_with(acc, p.getField("v"), lambda a, x: a + x.cast("double") * p.getField("w")),
    )
    return F.transform(summed, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
