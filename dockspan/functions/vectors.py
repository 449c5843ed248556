"""3-D vector arithmetic as column expressions.

A vector is a triple of columns, so everything stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Vector = tuple[Column, Column, Column]


def vec(prefix: str = "", names: tuple[str, str, str] = ("x", "y", "z")) -> Vector:
    """Columns ``{prefix}x, {prefix}y, {prefix}z`` as a vector."""
    return tuple(F.col(f"{prefix}{n}") for n in names)


def field_vec(struct: Column) -> Vector:
    """Fields x, y, z of a struct column as a vector."""
    return struct["x"], struct["y"], struct["z"]


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vector, k) -> Vector:
    return tuple(p * k for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def magnitude(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return magnitude(subtract(a, b))


def normalize(a: Vector) -> Vector:
    """Unit vector; NULL components for the zero vector."""
    return tuple(F.try_divide(p, magnitude(a)) for p in a)


def angle(a: Vector, b: Vector) -> Column:
    """Angle of two vectors in radians; NULL if one of them is zero.

    Rounding can put the cosine just outside its range, where ``acos`` is NaN.
    """
    cosine = F.try_divide(dot(a, b), magnitude(a) * magnitude(b))
    return F.nanvl(F.acos(cosine), F.when(cosine > 0, 0.0).otherwise(math.pi))


def angle_at(a: Vector, corner: Vector, b: Vector) -> Column:
    """Angle a-corner-b in radians."""
    return angle(subtract(a, corner), subtract(b, corner))


def _signed_atan2(y: Column, x: Column) -> Column:
    """``atan2`` that tells the two zeros apart, which the built-in one does not.

    A flat torsion is then 180 or -180 degrees by the sign of its zero sine.
    """
    backward = (x < 0.0) | (x.cast("string") == "-0.0")
    half_turn = F.when(y.cast("string") == "-0.0", -math.pi).otherwise(math.pi)
    return F.when((y == 0.0) & backward, half_turn).otherwise(F.atan2(y, x))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector, signed: bool = True) -> Column:
    """Torsion angle of four points in radians.

    ``signed=False`` is enough where 0, 180 and -180 degrees mean the same.
    """
    first, second, third = subtract(b, a), subtract(c, b), subtract(d, c)
    turn = cross(second, third)
    sine = dot(scale(first, magnitude(second)), turn)
    cosine = dot(cross(first, second), turn)
    return _signed_atan2(sine, cosine) if signed else F.atan2(sine, cosine)


def project(point: Vector, plane: tuple[Column, Column, Column, Column]) -> Vector:
    """Foot of the perpendicular on the plane ``ax + by + cz = d``."""
    normal, offset = plane[:3], plane[3]
    step = F.try_divide(offset - dot(normal, point), dot(normal, normal))
    return tuple(p + n * step for p, n in zip(point, normal))


def degrees(radians: Column) -> Column:
    return radians * 180.0 / math.pi


def snap(value: Column, step: float) -> Column:
    """Nearest multiple of ``step``."""
    return F.bround(value / step) * step
