"""Plane geometry as Column expressions: boxes, segments, distances, clipping.  No Python runs per row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def normal_yaw(yaw: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(yaw + F.pi(), F.lit(2 * math.pi)) - F.pi()


def snapped(v: Column, step: float) -> Column:
    """The nearest multiple of step, halves to even."""
    return F.rint(v / step) * step


def angle_between(u: Point, v: Point) -> Column:
    """Degrees between two vectors; 0 if one has no length."""
    size = hypot(*u) * hypot(*v)
    cosine = (u[0] * v[0] + u[1] * v[1]) / size
    return F.when(size == 0, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def signed_yaw_difference(a: Column, b: Column) -> Column:
    """a - b in degrees, in [-180, 180]; both ends stay as they are."""
    d = F.degrees(a - b)
    return F.when(F.abs(d) <= 180, d).otherwise(F.pmod(d + 180.0, F.lit(360.0)) - 180.0)


def yaw_difference(a: Column, b: Column) -> Column:
    """Degrees between two directions without sign, 0 to 90."""
    d = F.abs(signed_yaw_difference(a, b))
    return F.least(d, 180.0 - d)


CORNERS = tuple(f"c{k}{c}" for k in range(4) for c in "xy")
#: the columns that Box.of() reads
BOXED = ("x", "y", "width", "depth", "yaw", "cos", "sin", *CORNERS)


def boxed(df: DataFrame) -> DataFrame:
    """A table of boxes with what is computed once for each box and not for each pair: cosine and sine of yaw, and corners.

    Corners: back left, back right, front right, front left.
    """
    df = df.withColumns({"cos": F.cos("yaw"), "sin": F.sin("yaw")})
    signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    x = lambda u, v: F.col("x") + F.col("width") / 2 * u * F.col("cos") - F.col("depth") / 2 * v * F.col("sin")
    y = lambda u, v: F.col("y") + F.col("width") / 2 * u * F.col("sin") + F.col("depth") / 2 * v * F.col("cos")
    return df.withColumns({f"c{k}{c}": f(u, v) for k, (u, v) in enumerate(signs) for c, f in (("x", x), ("y", y))})


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed here: filters and projections above don't repeat the expressions below."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def keyed(df: DataFrame) -> DataFrame:
    """A side of a join on the room: both are sorted by it, and neither is sent to the driver.

    Spark chooses a broadcast by estimated or compressed bytes, and rows that are alike in all rooms compress to almost nothing.
    """
    return df.hint("merge")


@dataclass(frozen=True)
class Box:
    """An oriented rectangle; forward is +y before it is turned."""

    x: Column
    y: Column
    width: Column
    depth: Column
    yaw: Column
    cos: Column
    sin: Column
    corners: list[Point]

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in columns of a table that boxed() has been applied to."""
        return cls(*(F.col(f"{prefix}{c}") for c in BOXED[:7]), [(F.col(f"{prefix}c{k}x"), F.col(f"{prefix}c{k}y")) for k in range(4)])

    @property
    def forward(self) -> Point:
        return -self.sin, self.cos

    @property
    def right(self) -> Point:
        fx, fy = self.forward
        return fy, -fx

    def world(self, lx: Column, ly: Column) -> Point:
        c, s = self.cos, self.sin
        return self.x + lx * c - ly * s, self.y + lx * s + ly * c

    def local(self, p: Point) -> Point:
        c, s = self.cos, self.sin
        dx, dy = p[0] - self.x, p[1] - self.y
        return dx * c + dy * s, dy * c - dx * s

    @property
    def back(self) -> tuple[Point, Point]:
        """The edge farthest behind, for forward = +y the first."""
        return self.corners[0], self.corners[1]

    def distance(self, p: Point) -> Column:
        lx, ly = self.local(p)
        zero = F.lit(0.0)
        return hypot(F.greatest(F.abs(lx) - self.width / 2, zero), F.greatest(F.abs(ly) - self.depth / 2, zero))

    def clip(self, a: Point, b: Point) -> tuple[Column, Column]:
        """The part of the segment inside the closed box, as the first and last share of its way; empty if first > last."""
        (ax, ay), (bx, by) = self.local(a), self.local(b)
        return clip_local(ax, ay, bx, by, self.width / 2, self.depth / 2)

    def meets_segment(self, a: Point, b: Point) -> Column:
        first, last = self.clip(a, b)
        return first <= last + 1e-12

    def distance_to_segment(self, a: Point, b: Point) -> Column:
        """0 where they meet; else a corner or an end is nearest."""
        apart = F.least(self.distance(a), self.distance(b), *(point_segment(c, a, b) for c in self.corners))
        return F.when(self.meets_segment(a, b), 0.0).otherwise(apart)


def clip_local(ax: Column, ay: Column, bx: Column, by: Column, hw: Column, hd: Column) -> tuple[Column, Column]:
    first, last = F.lit(0.0), F.lit(1.0)
    for p, d, h in ((ax, bx - ax, hw), (ay, by - ay, hd)):
        flat = F.abs(d) < 1e-12
        outside = F.abs(p) > h + 1e-12
        lo, hi = (-h - p) / d, (h - p) / d
        first = F.greatest(first, F.when(flat, F.when(outside, 2.0).otherwise(0.0)).otherwise(F.least(lo, hi)))
        last = F.least(last, F.when(flat, F.when(outside, -1.0).otherwise(1.0)).otherwise(F.greatest(lo, hi)))
    return first, last


def point_segment(p: Point, a: Point, b: Point) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))).otherwise(0.0)
    return hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def cross(o: Point, a: Point, b: Point) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def segment_segment(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Distance of two segments, 0 where they cross."""
    crossing = (cross(a, b, c) * cross(a, b, d) < 0) & (cross(c, d, a) * cross(c, d, b) < 0)
    return F.when(crossing, 0.0).otherwise(F.least(point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b)))


def box_box(a: Box, b: Box) -> Column:
    """Distance of two boxes, 0 where they meet: a corner of one is nearest, or there is no axis that separates them."""
    apart = F.least(*(b.distance(c) for c in a.corners), *(a.distance(c) for c in b.corners))
    return F.when(boxes_meet(a, b), 0.0).otherwise(apart)


def boxes_meet(a: Box, b: Box) -> Column:
    """Separating axes: those of both boxes."""
    meet = F.lit(True)
    for one, two in ((a, b), (b, a)):
        cx, cy = one.local((two.x, two.y))
        c, s = F.abs(two.cos * one.cos + two.sin * one.sin), F.abs(two.sin * one.cos - two.cos * one.sin)
        meet = meet & (F.abs(cx) <= one.width / 2 + two.width / 2 * c + two.depth / 2 * s) & (F.abs(cy) <= one.depth / 2 + two.width / 2 * s + two.depth / 2 * c)
    return meet


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, an array of structs x, y (first equals last)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def ring_centroid(ring: Column) -> Point:
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(((p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"])).alias("x"), ((p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"])).alias("y")))
    area = ring_area(ring) * 6
    return F.aggregate(edges, F.lit(0.0), lambda s, v: s + v["x"]) / area, F.aggregate(edges, F.lit(0.0), lambda s, v: s + v["y"]) / area


def in_ring(ring: Column, x: Column, y: Column, closed: bool = True) -> Column:
    """Whether a point is inside a ring by ray casting; on the outline: inside only if closed."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    on = F.exists(edges, lambda e: point_segment((x, y), (e["ax"], e["ay"]), (e["bx"], e["by"])) < 1e-9)
    crossings = F.size(F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))
    inside = crossings % 2 == 1
    return F.when(on, closed).otherwise(inside)
