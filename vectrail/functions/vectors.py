"""Column functions on vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """A vector in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product, summed from left to right in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str, policy: str = "floor") -> Column:
    """Unit vector; tiny norms count as 1e-12 (floor), leave the vector (passthrough) or fail (error)."""
    d = doubles(v)
    scaled = lambda least: bind(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(d, lambda x: x / n))
    if policy == "floor":
        return scaled(1e-12)
    if policy == "passthrough":
        return F.when(norm(v) <= 1.1920929e-07, d).otherwise(scaled(0.0))
    if policy == "error":
        return F.when(norm(v) <= 1e-12, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(scaled(0.0))
    raise ValueError(f"unknown policy {policy}")


def is_unit(v: Column | str, tolerance: float = 1e-5) -> Column:
    """Whether a vector is finite and of norm one."""
    d = doubles(v)
    odd = F.exists(d, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | x.isNull())
    return ~F.coalesce(odd, F.lit(True)) & (F.abs(norm(v) - 1.0) <= tolerance)


def weighted_concat(a: Column | str, b: Column | str, weight: float) -> Column:
    """Two encoders' vectors as one: each normalised, scaled by the root of its share, joined, normalised."""
    left = F.transform(l2_normalize(a), lambda x: x * F.sqrt(F.lit(weight)))
    right = F.transform(l2_normalize(b), lambda x: x * F.sqrt(F.lit(1.0 - weight)))
    return bind(F.concat(left, right), lambda v: l2_normalize(v))


def blend(score: Column, local: Column, alpha: float) -> Column:
    """Confidence: the score alone, or with a local score their weighted sum within [0, 1]."""
    both = F.least(F.greatest(alpha * score + (1 - alpha) * local, F.lit(0.0)), F.lit(1.0))
    return F.when(local.isNull(), score).otherwise(both)
