"""Vector arithmetic on array columns, summed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0).cast("double"), lambda total, term: total + term)


def dot(left: Column, right: Column) -> Column:
    return _total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of the angle; 0 when either vector is zero."""
    size = norm(left) * norm(right)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(left, right) / size)


def squared_l2(left: Column, right: Column) -> Column:
    return _total(
        F.zip_with(left, right, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    )


def l2_normalize(vector: Column) -> Column:
    """Divide by the norm; a zero vector stays as it is."""
    size = norm(vector)
    return F.when(size == 0, F.transform(vector, lambda a: a.cast("double"))).otherwise(
        F.transform(vector, lambda a: a.cast("double") / size)
    )


def similarity(name: str, left: Column, right: Column) -> Column:
    """Raw score: larger is closer for ``cosine`` and ``dot_product``, smaller is closer for ``l2``."""
    if name == "cosine":
        return cosine(left, right)
    if name == "dot_product":
        return dot(left, right)
    if name == "l2":
        return squared_l2(left, right)
    raise ValueError(f"unknown similarity: {name}")


def scale_score(score: Column, name: str) -> Column:
    """Score on the unit interval."""
    if name == "cosine":
        return (score + 1) / 2
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score / 100))


def unscale_cosine(score: Column) -> Column:
    return score * 2 - 1


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
