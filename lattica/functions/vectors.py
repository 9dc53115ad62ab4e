"""Column expressions over points and vectors, given as tuples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def point(prefix: str = "", suffix: str = "", axes: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in axes)


def lit(*values: float) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a: Vec, b: Vec) -> Column:
    """Signed area of the 2D parallelogram of two vectors."""
    return a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance_sq(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(distance_sq(a, b))


def unit(a: Vec) -> Vec:
    """Null components for the zero vector."""
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x < float(lo), float(lo)).when(x > float(hi), float(hi)).otherwise(x)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return cross(sub(b, a), sub(c, a))


def area_cross(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(triangle_normal(a, b, c)) * 0.5


def area_heron(a: Vec, b: Vec, c: Vec) -> Column:
    """Heron's formula; a radicand that rounding makes negative counts as 0."""
    x, y, z = distance(a, b), distance(b, c), distance(c, a)
    s = (x + y + z) / 2
    return F.sqrt(F.greatest(s * (s - x) * (s - y) * (s - z), F.lit(0.0)))


def azimuth(n: Vec) -> Column:
    return F.atan2(n[1], n[0])


def elevation(n: Vec) -> Column:
    return F.asin(clip(n[2], -1, 1))


def angle_to(n: Vec, axis: tuple[float, float, float]) -> Column:
    """Degrees between a vector of any length and a unit axis; null for the zero vector."""
    return F.degrees(F.acos(clip(F.try_divide(dot(n, lit(*axis)), norm(n)), -1, 1)))


def is_vertical(nz: Column, limit: float) -> Column:
    """Whether a plane with this unit normal is a wall."""
    return F.abs(nz) < limit


def apply_matrix(matrix, p: Vec) -> Vec:
    """A literal matrix (rows) times a point."""
    return tuple(dot(tuple(F.lit(float(v)) for v in row), p) for row in matrix)


def _product(a, b):
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def _axis_rotations(degrees):
    (sx, cx), (sy, cy), (sz, cz) = [(math.sin(math.radians(d)), math.cos(math.radians(d))) for d in degrees]
    return (
        [[1, 0, 0], [0, cx, -sx], [0, sx, cx]],
        [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]],
        [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]],
    )


def euler_zyx(degrees) -> list[list[float]]:
    """Rz Ry Rx of angles about x, y, z in degrees."""
    x, y, z = _axis_rotations(degrees)
    return _product(_product(z, y), x)


def euler_xyz(degrees) -> list[list[float]]:
    """Rx Ry Rz of angles about x, y, z in degrees."""
    x, y, z = _axis_rotations(degrees)
    return _product(_product(x, y), z)


def rotation_z(radians: float) -> list[list[float]]:
    s, c = math.sin(radians), math.cos(radians)
    return [[c, -s, 0], [s, c, 0], [0, 0, 1]]


def axis_angle(axis, radians: float) -> list[list[float]]:
    """Rodrigues' rotation; the axis need not have length 1, a zero axis gives the identity."""
    n = math.sqrt(sum(v * v for v in axis))
    if n == 0:
        return [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    x, y, z = (v / n for v in axis)
    s, c = math.sin(radians), math.cos(radians)
    t = 1 - c
    return [
        [t * x * x + c, t * x * y - s * z, t * x * z + s * y],
        [t * x * y + s * z, t * y * y + c, t * y * z - s * x],
        [t * x * z - s * y, t * y * z + s * x, t * z * z + c],
    ]


def align_to_z(normal) -> list[list[float]]:
    """Rotation that turns ``normal`` to +z; parallel normals keep or flip by half a turn about x."""
    x, y, z = normal
    n = math.sqrt(x * x + y * y + z * z)
    if n == 0:
        raise ValueError("a zero normal has no direction")
    if math.hypot(x, y) <= 1e-12 * n:
        return [[1, 0, 0], [0, 1, 0], [0, 0, 1]] if z > 0 else [[1, 0, 0], [0, -1, 0], [0, 0, -1]]
    return axis_angle((y, -x, 0), math.acos(max(-1.0, min(1.0, z / n))))


def in_ball(p: Vec, centre, radius: float) -> Column:
    """Closed disc or ball, by the number of coordinates."""
    return distance_sq(p, lit(*centre)) <= F.lit(float(radius) ** 2)


def right_of(p: Vec, start, end) -> Column:
    """Strictly right of the directed line."""
    (x0, y0), (x1, y1) = start, end
    return (F.lit(float(x1 - x0)) * (p[1] - float(y0)) - F.lit(float(y1 - y0)) * (p[0] - float(x0))) < 0


def in_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Closed 2D triangle; null if it is degenerate.

    Seen from the first corner the point is s times one side plus t times the other.
    """
    side, other, at = sub(b, a), sub(c, a), sub(p, a)
    area = cross2(side, other)
    s, t = F.try_divide(cross2(at, other), area), F.try_divide(cross2(side, at), area)
    return (s >= 0) & (t >= 0) & (s + t <= 1)


def circumcircle(a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column]:
    """Centre x, y and radius of three 2D points; nulls if they are collinear.

    Seen from the first corner the centre is on the perpendicular bisectors of both sides.
    """
    side, other = sub(b, a), sub(c, a)
    twice = 2 * cross2(side, other)
    m, n = dot(side, side), dot(other, other)
    x = F.try_divide(m * other[1] - n * side[1], twice)
    y = F.try_divide(n * side[0] - m * other[0], twice)
    return a[0] + x, a[1] + y, F.sqrt(x * x + y * y)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def distinct_color(n: Column) -> Vec:
    """Bytes r, g, b of a whole number modulo 2^24."""
    m = F.pmod(F.abs(n), F.lit(1 << 24))
    return F.shiftright(m, 16).bitwiseAND(255), F.shiftright(m, 8).bitwiseAND(255), m.bitwiseAND(255)


def same_point(p: Vec, q: Vec, tolerance: float = 0.0) -> Column:
    """Whether no coordinate differs by more than ``tolerance``; nulls are the same as nulls only."""
    out = F.lit(True)
    for a, b in zip(p, q):
        out = out & F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    return out


def sorted_corners(p: Vec, q: Vec) -> tuple[Vec, Vec]:
    """The least and the largest corner of the box that has ``p`` and ``q`` as opposite ones."""
    return tuple(F.least(a, b) for a, b in zip(p, q)), tuple(F.greatest(a, b) for a, b in zip(p, q))
