"""Vector arithmetic on columns. A vector is a dict of three columns, so expressions stay flat and in generated code."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector shorter than this has no direction.
SHORT = 1e-6


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, o: Vec) -> Vec:  # type: ignore[override]
        return Vec(*(a + b for a, b in zip(self, o)))

    def __sub__(self, o: Vec) -> Vec:
        return Vec(*(a - b for a, b in zip(self, o)))

    def __mul__(self, k: Column | float) -> Vec:  # type: ignore[override]
        return Vec(*(a * k for a in self))

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def named(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in zip("xyz", self)]

    def struct(self) -> Column:
        return F.struct(*self.named(""))


def vec(prefix: str = "", of: str = "") -> Vec:
    """The vector of columns `<prefix>x, <prefix>y, <prefix>z`, or of the struct column `of`."""
    return Vec(*(F.col(f"{of}.{n}" if of else f"{prefix}{n}") for n in "xyz"))


def const(x: float, y: float, z: float) -> Vec:
    return Vec(*(F.lit(float(v)) for v in (x, y, z)))


def choose(cases: list[tuple[Column, Vec]], otherwise: Vec) -> Vec:
    """The vector of the first condition that holds."""

    def one(i: int) -> Column:
        out = F.when(cases[0][0], cases[0][1][i])
        for c, v in cases[1:]:
            out = out.when(c, v[i])
        return out.otherwise(otherwise[i])

    return Vec(*(one(i) for i in range(3)))


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(as_col(low), F.least(as_col(high), v))


def unit(v: Vec) -> Vec:
    """The direction of `v`; null if it's too short to have one."""
    n = v.length()
    return Vec(*(F.when(n >= SHORT, c / n) for c in v))


def on_plane(v: Vec, normal: Vec) -> Vec:
    """`v` without its part along the unit vector `normal`."""
    return v - normal * v.dot(normal)


def signed_angle(a: Vec, b: Vec, axis: Vec) -> Column:
    """The angle from `a` to `b` around `axis`, seen in the plane across it; 0 if one of them lies along the axis."""
    p, q = unit(on_plane(a, axis)), unit(on_plane(b, axis))
    return F.coalesce(F.atan2(axis.dot(p.cross(q)), p.dot(q)), F.lit(0.0))


def rotate(v: Vec, axis: Vec, angle: Column) -> Vec:
    """`v` turned around the unit vector `axis` (Rodrigues)."""
    c, s = F.cos(angle), F.sin(angle)
    return v * c + axis.cross(v) * s + axis * (axis.dot(v) * (1 - c))


def across(axis: Vec) -> Vec:
    """A unit vector perpendicular to `axis`: from Y, or from X where the axis is close to Y."""
    helper = choose([(F.abs(axis.y) < 0.9, const(0, 1, 0))], const(1, 0, 0))
    return unit(axis.cross(helper))


def wrap_angle(a: Column) -> Column:
    """The angle between -pi and pi."""
    return F.atan2(F.sin(a), F.cos(a))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return a + (b - a) * t


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    """The point of the segment nearest to `p`; `a` if the segment has no length."""
    d = b - a
    n = d.dot(d)
    t = F.when(n < 1e-20, F.lit(0.0)).otherwise(clamp((p - a).dot(d) / F.when(n >= 1e-20, n), 0.0, 1.0))
    return a + d * t


def closest_on_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """The point of the triangle nearest to `p`, by the Voronoi region that `p` is in (corners, then edges, then face)."""
    ab, ac = b - a, c - a
    d1, d2 = ab.dot(p - a), ac.dot(p - a)
    d3, d4 = ab.dot(p - b), ac.dot(p - b)
    d5, d6 = ab.dot(p - c), ac.dot(p - c)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    over = lambda n, d: n / F.when(d != 0, d)
    edges = [
        ((d1 <= 0) & (d2 <= 0), a),
        ((d3 >= 0) & (d4 <= d3), b),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), a + ab * over(d1, d1 - d3)),
        ((d6 >= 0) & (d5 <= d6), c),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), a + ac * over(d2, d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), b + (c - b) * over(d4 - d3, d4 - d3 + d5 - d6)),
    ]
    total = va + vb + vc
    return choose(edges, a + ab * over(vb, total) + ac * over(vc, total))


def quaternion_matrix(q: tuple[Column, Column, Column, Column]) -> list[Column]:
    """The 3 x 3 rotation matrix of the unit quaternion (x, y, z, w), row by row."""
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def euler_matrix(x: Column, y: Column, z: Column) -> list[Column]:
    """The rotation matrix of Euler angles in the order XYZ, row by row."""
    a, b, c, d, e, f = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return [c * e, -(c * f), d, a * f + b * e * d, a * e - b * f * d, -(b * c), b * f - a * e * d, b * e + a * f * d, a * c]


def matrix_euler(m: list[Column]) -> tuple[Column, Column, Column]:
    """Euler angles (XYZ) of a rotation matrix; at a gimbal lock (sine of the middle angle over 0.99999) z is 0."""
    free = F.abs(m[2]) < 0.99999
    return (
        F.when(free, F.atan2(-m[5], m[8])).otherwise(F.atan2(m[7], m[4])),
        F.asin(clamp(m[2], -1.0, 1.0)),
        F.when(free, F.atan2(-m[1], m[0])).otherwise(F.lit(0.0)),
    )


def orbit_offset(azimuth: Column, elevation: Column, distance: Column | float) -> Vec:
    """Where a camera stands from its target; the elevation is held between -80 and 70 degrees."""
    e = clamp(elevation, -math.radians(80), math.radians(70))
    return Vec(F.sin(azimuth) * F.cos(e), F.sin(e), F.cos(azimuth) * F.cos(e)) * distance
