"""Vector arithmetic on columns; a vector is a tuple of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def vec(prefix: str, axes: str = "xyz") -> Vector:
    return tuple(F.col(f"{a}{prefix}") for a in axes)


def sub(p: Vector, q: Vector) -> Vector:
    return tuple(a - b for a, b in zip(p, q, strict=True))


def dot(p: Vector, q: Vector) -> Column:
    total = p[0] * q[0]
    for a, b in zip(p[1:], q[1:], strict=True):
        total = total + a * b
    return total


def cross(p: Vector, q: Vector) -> Vector:
    return (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])


def norm(p: Vector) -> Column:
    return F.sqrt(dot(p, p))


def distance(p: Vector, q: Vector) -> Column:
    return norm(sub(p, q))


def signed_area(p: Vector, q: Vector, r: Vector) -> Column:
    """Of a planar triangle; positive counter-clockwise."""
    return 0.5 * ((q[0] - p[0]) * (r[1] - p[1]) - (r[0] - p[0]) * (q[1] - p[1]))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
