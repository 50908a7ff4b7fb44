"""Column expressions over coordinates: distances, angles, bends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: list, b: list) -> Column:
    out = _col(a[0]) * _col(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + _col(x) * _col(y)
    return out


def minus(a: list, b: list) -> list[Column]:
    return [_col(x) - _col(y) for x, y in zip(a, b, strict=True)]


def norm(a: list) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: list, b: list) -> Column:
    return norm(minus(a, b))


def _degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def acute_angle(a: list, b: list) -> Column:
    """Angle between two axes whatever their signs, 0 to 90 degrees; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, _degrees(F.abs(dot(a, b) / size)))


def full_angle(a: list, b: list) -> Column:
    """Angle between two vectors, 0 to 180 degrees; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, _degrees(dot(a, b) / size))


def xyz(row: Column) -> list[Column]:
    return [row["x"], row["y"], row["z"]]


def once(value: Column, use) -> Column:
    """``use(value)``, where the value is made once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mid_vector_angle(points: Column | str) -> Column:
    """180 degrees less the angle between the first and the second half of an ordered array of ``x, y, z``; null under 4 points.

    The halves meet at the middle point, so a straight run gives 180.
    """
    p = _col(points)
    n = F.size(p)
    half = F.floor(n / 2).cast("int")
    first, middle, last = xyz(F.element_at(p, 1)), xyz(F.get(p, half)), xyz(F.element_at(p, -1))
    return F.when(n >= 4, F.lit(180.0) - full_angle(minus(middle, first), minus(last, middle)))


def triangle_angle(points: Column | str, least: float = 1e-8) -> Column:
    """180 degrees less the angle at the point farthest from the end-to-end axis; null under 3 points or without an axis.

    Of equally far points the first counts, so a run that is exactly straight has a corner at its end and no angle.
    """
    p = _col(points)
    first, last = xyz(F.element_at(p, 1)), xyz(F.element_at(p, -1))
    axis = minus(last, first)

    def away(q: Column, size: Column) -> Column:
        d = minus(xyz(q), first)
        along = dot(d, axis) / size
        return F.sqrt(F.greatest(F.lit(0.0), dot(d, d) - along * along))

    far = once(norm(axis), lambda size: F.transform(p, lambda q: away(q, size)))
    corner = once(far, lambda f: F.element_at(p, F.array_position(f, F.array_max(f)).cast("int")))
    angle = once(corner, lambda c: full_angle(minus(first, xyz(c)), minus(last, xyz(c))))
    return F.when((F.size(p) >= 3) & (norm(axis) > least), F.lit(180.0) - angle)
