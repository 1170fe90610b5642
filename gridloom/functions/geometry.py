"""Column functions of points, poses, cameras, lines and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def rigid(rotation: list, translation: list | None, p: Vec) -> Vec:
    """R p + t, R row by row (columns or numbers)."""
    r = [F.lit(float(x)) if isinstance(x, (int, float)) else x for x in rotation]
    out = [dot(tuple(r[3 * i : 3 * i + 3]), p) for i in range(3)]
    if translation is not None:
        out = [x + (F.lit(float(t)) if isinstance(t, (int, float)) else t) for x, t in zip(out, translation, strict=True)]
    return tuple(out)


def rotation_about_z(angle: float) -> list[float]:
    c, s = math.cos(angle), math.sin(angle)
    return [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]


def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def project(p: Vec, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Nearest pixel of a point before the camera."""
    return F.floor(p[0] / p[2] * fx + cx + 0.5).cast("long"), F.floor(p[1] / p[2] * fy + cy + 0.5).cast("long")


def pose_difference(euler: Vec, translation: Vec) -> Column:
    """Motion cost: 9 times the squared angles, each from the nearest of 0 and +-pi, plus the squared way."""
    wrapped = [F.least(F.abs(e), F.abs(e - math.pi), F.abs(e + math.pi)) for e in euler]
    return 9 * dot(tuple(wrapped), tuple(wrapped)) + dot(translation, translation)


def angle_bin(a: Column, b: Column, bins: int = 18) -> Column:
    """Bin of the difference of two angles in degrees."""
    width = 360 // bins
    return F.pmod(F.floor(F.pmod(a - b + 360.0, F.lit(360.0)) / width + 0.5), F.lit(bins)).cast("long")


def line_through(a: Vec, b: Vec) -> tuple[Vec, Column]:
    """Unit normal and offset of the 2-D line through two points: n . p + d = 0."""
    nx, ny = b[1] - a[1], a[0] - b[0]
    length = F.sqrt(nx * nx + ny * ny)
    n = (nx / length, ny / length)
    return n, -dot(n, a)


def line_intersection(n1: Vec, d1: Column, n2: Vec, d2: Column) -> Vec:
    """Null for parallel lines."""
    det = n1[0] * n2[1] - n1[1] * n2[0]
    safe = F.when(F.abs(det) > 1e-9, det)
    return (n1[1] * d2 - n2[1] * d1) / safe, (n2[0] * d1 - n1[0] * d2) / safe


def side(a: Vec, b: Vec, p: Vec) -> Column:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def segments_cross(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return (side(a, b, c) * side(a, b, d) <= 0) & (side(c, d, a) * side(c, d, b) <= 0)


def nearest_on_segment(a: Vec, b: Vec, p: Vec) -> Vec:
    ab = (b[0] - a[0], b[1] - a[1])
    t = dot((p[0] - a[0], p[1] - a[1]), ab) / F.greatest(dot(ab, ab), F.lit(1e-12))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return a[0] + t * ab[0], a[1] + t * ab[1]


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return F.abs(side(a, b, c)) / 2


def polygon_area(xs: str, ys: str) -> Column:
    """Shoelace formula over two array columns, the corners in order."""
    turned = lambda c: f"concat(slice({c}, 2, greatest(size({c}) - 1, 0)), slice({c}, 1, 1))"
    total = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v)"
    return F.expr(f"abs({total(xs, turned(ys))} - {total(turned(xs), ys)}) / 2")


def in_convex_polygon(corners: list[tuple[float, float]], p: Vec) -> Column:
    """1 within, 0 on an edge, -1 outside a counter-clockwise polygon."""
    sides = [(F.lit(b[0]) - a[0]) * (p[1] - a[1]) - (F.lit(b[1]) - a[1]) * (p[0] - a[0]) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    low = F.least(*sides)
    return F.when(low > 1e-9, 1).when(low >= -1e-9, 0).otherwise(-1)


def in_box(p: Vec, low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    out = F.lit(True)
    for x, a, b in zip(p, low, high, strict=True):
        out = out & x.between(a, b)
    return out


def boxes_meet(low1: Vec, high1: Vec, low2: Vec, high2: Vec) -> Column:
    out = F.lit(True)
    for a, b, c, d in zip(low1, high1, low2, high2, strict=True):
        out = out & (a <= d) & (c <= b)
    return out


def ray_meets_box(origin: Vec, direction: Vec, low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """Slab test for a ray from origin; directions of zero are nudged."""
    near, far = [], []
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        d = F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)
        t1, t2 = (a - o) / d, (b - o) / d
        near.append(F.least(t1, t2))
        far.append(F.greatest(t1, t2))
    return (F.greatest(*near) <= F.least(*far)) & (F.least(*far) >= 0)


def plane_side(n: Vec, d: Column | float, p: Vec, eps: float = 1e-6) -> Column:
    """1 before, -1 behind, 0 on a plane."""
    x = dot(n, p) + d
    return F.when(x > eps, 1).when(x < -eps, -1).otherwise(0)


def is_inlier(p: Vec, normal: Vec, plane: Vec, offset: Column | float, reach: float, agree: float = 0.7) -> Column:
    """On a plane within reach / 1.8, with an agreeing normal."""
    return (F.abs(dot(p, plane) + offset) <= reach / 1.8) & (F.abs(dot(normal, plane)) >= agree)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def bilerp(v00: Column, v10: Column, v01: Column, v11: Column, tx: Column, ty: Column) -> Column:
    return lerp(lerp(v00, v10, tx), lerp(v01, v11, tx), ty)


def zero_crossing(p0: Column, p1: Column, s0: Column, s1: Column) -> Column:
    """Where the value is zero between two places of opposite sign; else null."""
    return F.when((s0 < 0) != (s1 < 0), p0 + (p1 - p0) * s0 / (s0 - s1))


def good_view(view: Vec, normal: Vec, least: float = 0.4) -> Column:
    return F.abs(dot(view, normal)) / (norm(view) * norm(normal)) >= least


def huber(error: Column, at: float = 0.008) -> Column:
    return F.when(error < at, F.lit(1.0)).otherwise(F.lit(at) / error)
