"""Spherical geometry and the pinhole camera, as column expressions.

Vectors are triples of columns, or struct columns of x, y, z; rotations are their rows right,
up and forward, or a struct column of those. Angles are degrees unless a name says otherwise. A point that cannot be projected is null.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points less far in front of the camera than this have no image.
NEAR = 0.05
#: From this height of the axis on, another reference than north gives the right side.
POLAR = 0.99
#: Beyond this dot product, points on a great circle are taken from the chord.
NEARLY_EQUAL = 0.9995
#: Obliquity of the ecliptic at J2000; the unit vectors of Saturn's pole (degrees).
OBLIQUITY = 23.439291111
SATURN_POLE = (40.589, 83.537)


class Vector(NamedTuple):
    """Three columns. Kept apart, as a column made of a struct's fields would hold the whole
    struct once for each field."""

    x: Column
    y: Column
    z: Column

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


class Rotation(NamedTuple):
    right: Vector
    up: Vector
    forward: Vector

    def struct(self) -> Column:
        return F.struct(*[v.struct().alias(name) for name, v in zip(self._fields, self, strict=True)])


def vector(v: Vector | Column) -> Vector:
    """Of a struct column with x, y and z."""
    return v if isinstance(v, Vector) else Vector(v["x"], v["y"], v["z"])


def rotation_of(rot: Rotation | Column) -> Rotation:
    return rot if isinstance(rot, Rotation) else Rotation(*[vector(rot[name]) for name in Rotation._fields])


def dot(a: Vector | Column, b: Vector | Column) -> Column:
    a, b = vector(a), vector(b)
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Vector | Column, b: Vector | Column) -> Vector:
    a, b = vector(a), vector(b)
    return Vector(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def combine(p: Column, a: Vector | Column, q: Column, b: Vector | Column) -> Vector:
    return Vector(*[p * x + q * y for x, y in zip(vector(a), vector(b), strict=True)])


def normalized(a: Vector | Column) -> Vector:
    """A zero vector stays zero."""
    n = F.sqrt(dot(a, a))
    return Vector(*[F.when(n > 0, x / n).otherwise(0.0) for x in vector(a)])


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def unit(ra: Column, dec: Column) -> Vector:
    a, d = F.radians(ra), F.radians(dec)
    return Vector(F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))


def ra_dec(u: Vector | Column) -> tuple[Column, Column]:
    """ra in 0..360, dec."""
    u = vector(u)
    ra = F.degrees(F.atan2(u.y, u.x))
    return F.when(ra < 0, ra + 360).otherwise(ra), F.degrees(F.asin(clamp(u.z, -1.0, 1.0)))


def separation(a: Vector | Column, b: Vector | Column) -> Column:
    return F.degrees(F.acos(clamp(dot(a, b), -1.0, 1.0)))


def slerp(a: Vector | Column, b: Vector | Column, t: Column) -> Vector:
    """Between unit vectors; if they are more than 90 degrees apart, toward b's antipode."""
    d = dot(a, b)
    side = F.when(d < 0, -1.0).otherwise(1.0)
    d = F.abs(d)
    angle = F.acos(clamp(d, -1.0, 1.0))
    chord = F.sqrt((1.0 - t) * (1.0 - t) + t * t + 2.0 * t * (1.0 - t) * d)  # length of the straight mean
    p = F.when(d > NEARLY_EQUAL, (1.0 - t) / chord).otherwise(F.sin((1.0 - t) * angle) / F.sin(angle))
    q = F.when(d > NEARLY_EQUAL, t / chord).otherwise(F.sin(t * angle) / F.sin(angle))
    return combine(p, a, q * side, b)


def half_diagonal_deg(focal: float, w: int, h: int) -> float:
    return math.degrees(math.atan(math.hypot(w, h) / (2 * focal)))


def level(f: Vector, away: tuple[Vector, Vector] | None = None) -> tuple[Vector, Vector]:
    """Right and up of a camera without roll that looks along f. Near the poles the y axis
    takes north's place. away: both as they are elsewhere, if known."""
    polar = F.abs(f.z) > POLAR
    side, n = F.sqrt(f.x * f.x + f.y * f.y), F.sqrt(f.x * f.x + f.z * f.z)
    zero = F.lit(0.0)
    right, up = away or (Vector(f.y / side, -f.x / side, zero), Vector(-f.x * f.z / side, -f.y * f.z / side, side))
    pick = lambda p, q: Vector(*[F.when(polar, x).otherwise(y) for x, y in zip(p, q, strict=True)])
    return pick(Vector(-f.z / n, zero, f.x / n), right), pick(Vector(-f.x * f.y / n, n, -f.y * f.z / n), up)


def tangent(ra: Column, dec: Column) -> tuple[Vector, Vector]:
    """East and north."""
    a, d = F.radians(ra), F.radians(dec)
    return Vector(-F.sin(a), F.cos(a), F.lit(0.0)), Vector(-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d))


def rotation(ra: Column, dec: Column, roll: Column) -> Rotation:
    """Of a camera pose. To be put in a column of the frames before they meet stars."""
    f = unit(ra, dec)
    east, north = tangent(ra, dec)
    right, up = level(f, (Vector(-east.x, -east.y, F.lit(0.0)), north))
    c, s = F.cos(F.radians(roll)), F.sin(F.radians(roll))
    return Rotation(combine(c, right, s, up), combine(-s, right, c, up), f)


def roll_of(right: Vector, f: Vector) -> Column:
    level_right, level_up = level(f)
    return F.degrees(F.atan2(dot(right, level_up), dot(right, level_right)))


def pose(rot: Rotation | Column) -> tuple[Column, Column, Column]:
    """ra, dec, roll of a rotation."""
    rot = rotation_of(rot)
    return *ra_dec(rot.forward), roll_of(rot.right, rot.forward)


def to_camera(rot: Rotation | Column, u: Vector | Column) -> Vector:
    return Vector(*[dot(row, u) for row in rotation_of(rot)])


def project(cam: Vector | Column, focal: Column, k1: Column, w: Column, h: Column) -> tuple[Column, Column, Column]:
    """Whether a camera vector has an image, and its pixel. It has none behind the camera, or
    beyond the radius where a negative k1 would fold the image back."""
    cam = vector(cam)
    u, v = F.try_divide(cam.x, cam.z), F.try_divide(cam.y, cam.z)
    r2 = u * u + v * v
    seen = (cam.z > NEAR) & ~((k1 < 0) & (r2 >= -1.0 / (3.0 * F.when(k1 < 0, k1).otherwise(-1.0))))
    stretch = 1.0 + k1 * r2
    return seen, w / 2.0 + focal * u * stretch, h / 2.0 - focal * v * stretch


def unproject(rot: Rotation | Column, focal: Column, k1: Column, w: Column, h: Column, x: Column, y: Column) -> Vector:
    """World direction of a pixel; the distortion is undone in three fixed-point steps, which
    change the scale only."""
    dx, dy = (x - w / 2.0) / focal, (h / 2.0 - y) / focal
    scale = F.lit(1.0)
    for _ in range(3):
        scale = 1.0 + k1 * (dx * dx + dy * dy) / (scale * scale)
    n = F.sqrt(dx * dx + dy * dy + scale * scale)
    return Vector(*[(dx * r + dy * up + scale * f) / n for r, up, f in zip(*rotation_of(rot), strict=True)])


def in_bounds(x: Column, y: Column, w: Column, h: Column, margin: float = 0.0) -> Column:
    return (x >= -margin) & (x < w + margin) & (y >= -margin) & (y < h + margin)


def visibility(cam: Vector | Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.when(vector(cam).z <= 0, "behind_camera").when(in_bounds(x, y, w, h), "visible").otherwise("out_of_frustum")


def moved(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, epoch: Column) -> Vector:
    """Unit vector at an epoch in years; proper motion in radians a year on the tangent plane."""
    t = epoch - 2000.0
    east, north = tangent(ra, dec)
    step = combine(t * pm_ra, east, t * pm_dec, north)
    return normalized(Vector(*[x + y for x, y in zip(unit(ra, dec), step, strict=True)]))


def wcs_roll(ra: Column, dec: Column, orientation: Column, parity: Column, top_down: Column) -> Column:
    """Camera roll of a plate solution's orientation. Images whose rows run upwards were seen
    mirrored, which turns the orientation round."""
    angle = F.radians(F.when(top_down, orientation).otherwise(-orientation - 180.0))
    sign = F.when(parity >= 0, 1.0).otherwise(-1.0)
    east, north = tangent(ra, dec)
    right = combine(sign * F.cos(angle), east, -sign * F.sin(angle), north)
    f = unit(ra, dec)
    level_right, level_up = level(f, (Vector(-east.x, -east.y, F.lit(0.0)), north))
    return wrap180(F.degrees(F.atan2(dot(right, level_up), dot(right, level_right))))


def wrap180(a: Column) -> Column:
    """Into [-180, 180)."""
    x = a % 360.0
    return F.when(x < -180, x + 360).when(x >= 180, x - 360).otherwise(x)


def shortest(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def fov(focal: Column, side: Column) -> Column:
    return F.degrees(2.0 * F.atan(side / (2.0 * focal)))


def focal_of(fov_deg: Column, side: Column) -> Column:
    return side / (2.0 * F.tan(F.radians(fov_deg) / 2.0))


def ecliptic_to_equatorial(v: Vector | Column) -> Vector:
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    v = vector(v)
    return Vector(v.x, v.y * c - v.z * s, v.y * s + v.z * c)


def phase_angle(r: Column, delta: Column, sun: Column) -> Column:
    return F.degrees(F.acos(clamp((r * r + delta * delta - sun * sun) / (2.0 * r * delta), -1.0, 1.0)))


def ring_tilt(u: Vector | Column) -> Column:
    """Saturn's rings seen along a geocentric direction."""
    pole = unit(F.lit(SATURN_POLE[0]), F.lit(SATURN_POLE[1]))
    return F.degrees(F.asin(clamp(-dot(pole, u) / F.sqrt(dot(u, u)), -1.0, 1.0)))


#: The almanac's magnitude polynomials in the phase angle, lowest power first.
MAGNITUDES = {
    "Mercury": (-0.42, 0.038, -0.000273, 0.000002),
    "Venus": (-4.40, 0.0009, 0.000239, -0.00000065),
    "Mars": (-1.52, 0.016),
    "Jupiter": (-9.40, 0.005),
    "Saturn": (-8.88,),
    "Uranus": (-7.19, 0.0028),
    "Neptune": (-6.87,),
}


def magnitude(planet: Column, r: Column, delta: Column, phase: Column, ring: Column) -> Column:
    b = F.abs(F.sin(F.radians(ring)))
    out = F.lit(None).cast("double")
    for name, terms in MAGNITUDES.items():
        value = F.lit(0.0)
        for c in reversed(terms):
            value = value * phase + c
        if name == "Saturn":
            value = value - 2.60 * b + 1.25 * b * b
        out = F.when(planet == name, value).otherwise(out)
    return 5.0 * F.log10(r * delta) + out
