"""Polygons as arrays of points, boxes, hashes and ratios, as column expressions; the few that need loops take Arrow batches."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def xs(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: F.get(p, F.lit(0)))


def ys(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: F.get(p, F.lit(1)))


def box(polygon: Column) -> Column:
    x, y = xs(polygon), ys(polygon)
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 when the union is."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - width * height
    return F.when(union != 0, width * height / union).otherwise(zero)


def in_range(polygon: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """Every point has two coordinates within bounds."""
    return F.forall(polygon, lambda p: F.coalesce((F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & (v >= low) & (v <= high)), F.lit(False)))


def to_pixels(polygon: Column, width: Column, height: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(F.get(p, F.lit(0)) * width / 1000.0, F.get(p, F.lit(1)) * height / 1000.0))


def lower_edge_scaled(polygon: Column, factor: Column) -> Column:
    """A quadrilateral (upper left and right, lower right and left), its sides multiplied from the top and kept within 0 to 1000."""
    def moved(top: int, bottom: int) -> Column:
        a, b = polygon[top], polygon[bottom]
        return F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1000.0), a[k] + (b[k] - a[k]) * factor)) for k in (0, 1)])

    return F.array(polygon[0], polygon[1], moved(1, 2), moved(0, 3))


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle from its upper left and lower right corner."""
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def shoelace(polygon: Column) -> Column:
    """Twice the signed area."""
    n = F.size(polygon)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _cross(F.get(polygon, i), F.get(polygon, (i + 1) % n)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _cross(p: Column, q: Column) -> Column:
    return p[0] * q[1] - q[0] * p[1]


def quad_valid(polygon: Column, least_area: float = 25.0) -> Column:
    """Four different finite corners of a convex shape that is large enough."""
    def turn(i: Column) -> Column:
        a, b, c = (F.get(polygon, (i + k) % 4) for k in range(3))
        return F.signum((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))

    turns = F.transform(F.sequence(F.lit(0), F.lit(3)), turn)
    finite = F.forall(polygon, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = (F.size(polygon) == 4) & (F.size(F.array_distinct(polygon)) == 4) & finite
    return F.when(whole, (F.abs(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x)) == 4) & (F.abs(shoelace(polygon)) / 2 >= least_area)).otherwise(F.lit(False))


def _clip(subject: list, clip: list) -> list:
    """The part of a convex polygon inside another, edge by edge."""
    sign = 1 if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(clip, clip[1:] + clip[:1], strict=True)) >= 0 else -1
    out = subject
    for a, b in zip(clip, clip[1:] + clip[:1], strict=True):
        def side(p: list, a: list = a, b: list = b) -> float:
            return sign * ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))

        kept = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append([p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)])
        out = kept
        if not out:
            break
    return out


def _area(points: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def convex_overlap(a: list | None, b: list | None) -> float:
    """The common area of two convex polygons as a part of the smaller one, or of 1 if that is less."""
    return _area(_clip(a, b)) / max(1.0, min(_area(a), _area(b))) if a and b else 0.0


@F.arrow_udf(T.DoubleType())
def overlap_of(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([convex_overlap(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def quad_ordered(polygon: pa.Array) -> pa.Array:
    """Corners by angle around their centre, from the one with the least x + y."""
    out = []
    for points in polygon.to_pylist():
        if points:
            cx, cy = (sum(p[k] for p in points) / len(points) for k in (0, 1))
            points = sorted(points, key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
            first = min(range(len(points)), key=lambda i: sum(points[i]))
            points = points[first:] + points[:first]
        out.append(points)
    return pa.array(out, pa.list_(pa.list_(pa.float64())))


def difference_hash(values: Column) -> Column:
    """64 bits of 9 x 8 gray values in rows: is each pixel darker than the next one to its right?"""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.get(values, i + F.floor(i / 8).cast("int") + 1) > F.get(values, i + F.floor(i / 8).cast("int"))).cast("string"))
    return F.conv(F.replace(F.replace(F.array_join(bits, ""), F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0")), 2, 16)


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits."""
    def half(c: Column, at: int) -> Column:
        return F.conv(F.substring(F.lpad(c, 16, "0"), at, 8), 16, 10).cast("bigint")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def fill_floor(role: Column) -> Column:
    """How much of its region a text must fill, by role."""
    return F.when(role == "heading", 0.86).when(role.isin("body", "caption", "byline", "metadata"), 0.93).otherwise(0.90)


def font_ratio(text: Column, polygon: Column, role: Column, aspect: float = 1.4) -> Column:
    """The size of type at which a text fits its box in width and height."""
    b, lines = box(polygon), F.split(text, "\n")
    longest = F.array_max(F.transform(lines, F.length))
    wide = (b["x2"] - b["x1"]) / F.greatest(F.lit(1.0), longest * 0.58) / 1000
    high = (b["y2"] - b["y1"]) * aspect / F.greatest(F.lit(1.0), F.size(lines) * 1.04) / 1000
    return F.bround(F.greatest(F.lit(0.0005), F.least(F.lit(0.05), F.least(wide, high) * F.when(role == "heading", 1.08).otherwise(1.0))), 5)
