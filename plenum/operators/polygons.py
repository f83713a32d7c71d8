"""Polygons that SQL has no form for: faces of wall drawings, disks and corridors clipped by boxes.

Rows are rooms (or pairs), in Arrow batches; nothing is grouped in Python but what one room holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions.geometry import keyed

P = tuple[float, float]


def area(ring: list[P]) -> float:
    """Signed area of an open ring."""
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def centroid(ring: list[P]) -> P:
    a, x, y = area(ring) * 6, 0.0, 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        c = x1 * y2 - x2 * y1
        x, y = x + (x1 + x2) * c, y + (y1 + y2) * c
    return x / a, y / a


def clip(subject: list[P], clipper: list[P]) -> list[P]:
    """Sutherland-Hodgman; the clipper is convex and counterclockwise, the subject any ring (then its area is right)."""
    out = subject
    for (ax, ay), (bx, by) in zip(clipper, clipper[1:] + clipper[:1], strict=True):
        ring, out = out, []
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring]
        for k, (x, y) in enumerate(ring):
            px, py, s, t = *ring[k - 1], side[k - 1], side[k]
            if (s < 0) != (t < 0):
                u = s / (s - t)
                out.append((px + u * (x - px), py + u * (y - py)))
            if t >= 0:
                out.append((x, y))
        if not out:
            return []
    return out


def box_ring(x: float, y: float, width: float, depth: float, yaw: float) -> list[P]:
    c, s, w, d = math.cos(yaw), math.sin(yaw), width / 2, depth / 2
    return [(x + u * c - v * s, y + u * s + v * c) for u, v in ((-w, -d), (w, -d), (w, d), (-w, d))]


def disk_ring(x: float, y: float, radius: float, quarter: int) -> list[P]:
    """A polygon with so many sides a quarter, counterclockwise."""
    n = 4 * quarter
    return [(x + radius * math.cos(2 * math.pi * k / n), y + radius * math.sin(2 * math.pi * k / n)) for k in range(n)]


def convex_in_boxes(x: np.ndarray, y: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Areas that convex polygons share with boxes, row by row.

    x, y: corners, counterclockwise, the last repeated where a polygon has fewer; box: rows of x, y, width, depth, yaw.
    An area is a sum over the parts of each outline inside the other.
    """
    cos, sin = np.cos(box[4]), np.sin(box[4])
    dx, dy = x - box[0][:, None], y - box[1][:, None]
    px, py = dx * cos[:, None] + dy * sin[:, None], dy * cos[:, None] - dx * sin[:, None]
    qx, qy = np.roll(px, -1, axis=1), np.roll(py, -1, axis=1)
    half = box[2] / 2, box[3] / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        # sides of the polygon inside the box
        low, high = np.zeros(px.shape), np.ones(px.shape)
        for p, d, h in ((px, qx - px, half[0][:, None]), (py, qy - py, half[1][:, None])):
            flat, u, v = np.abs(d) < 1e-12, (-h - p) / d, (h - p) / d
            out = np.abs(p) > h + 1e-12
            low = np.maximum(low, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(u, v)))
            high = np.minimum(high, np.where(flat, np.where(out, -1.0, 1.0), np.maximum(u, v)))
        ux, uy, vx, vy = px + low * (qx - px), py + low * (qy - py), px + high * (qx - px), py + high * (qy - py)
        total = np.where(low < high, ux * vy - uy * vx, 0.0).sum(axis=1)
        # sides of the box inside the polygon
        corners = [(-half[0], -half[1]), (half[0], -half[1]), half, (-half[0], half[1])]
        ex, ey = qx - px, qy - py
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            at = ex * (ay[:, None] - py) - ey * (ax[:, None] - px)
            step = ex * (by - ay)[:, None] - ey * (bx - ax)[:, None]
            t = -at / step
            flat = np.abs(step) < 1e-15
            low = np.maximum(0.0, np.where(flat, np.where(at < -1e-12, 2.0, 0.0), np.where(step > 0, t, 0.0)).max(axis=1))
            high = np.minimum(1.0, np.where(~flat & (step < 0), t, 1.0).min(axis=1))
            ux, uy, vx, vy = ax + low * (bx - ax), ay + low * (by - ay), ax + high * (bx - ax), ay + high * (by - ay)
            total += np.where(low < high, ux * vy - uy * vx, 0.0)
    return np.maximum(total / 2, 0.0)


def is_convex(ring: list[P]) -> bool:
    return all((bx - ax) * (cy - by) - (by - ay) * (cx - bx) >= -1e-12 for (ax, ay), (bx, by), (cx, cy) in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True))


def corridors_of(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners of all points within a distance of each segment, the round ends as polygons."""
    length = np.hypot(bx - ax, by - ay)
    c, s = ((bx - ax) / length)[:, None], ((by - ay) / length)[:, None]
    k = np.arange(2 * quarter + 1) * math.pi / (2 * quarter) - math.pi / 2
    # the round end ahead, turned; the other one is opposite
    dx, dy = radius * (c * np.cos(k) - s * np.sin(k)), radius * (s * np.cos(k) + c * np.sin(k))
    x, y = (np.concatenate([b[:, None] + d, a[:, None] - d], axis=1) for a, b, d in ((ax, bx, dx), (ay, by, dy)))
    return x, y


def _columns(batch: pa.RecordBatch, names) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), np.float64) for c in names])


def ring_of(points: list[dict]) -> list[P]:
    """An open counterclockwise ring from a closed array of structs."""
    ring = [(p["x"], p["y"]) for p in points]
    if len(ring) > 1 and ring[0] == ring[-1]:
        ring.pop()
    return ring if area(ring) >= 0 else ring[::-1]


def disk_shares(rooms: DataFrame, furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """room, id, ord, disk (area of the middle disk inside the room) and area (of it under the piece); a null piece for rooms without."""
    reach = config.center_radius + F.sqrt(F.col("width") * F.col("width") + F.col("depth") * F.col("depth")) / 2
    near = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))) <= reach
    pieces = furniture.select(F.col("room").alias("r"), "id", "ord", "x", "y", "width", "depth", "yaw")
    rows = rooms.join(keyed(pieces), (F.col("room") == F.col("r")) & near, "left").select("room", "ring", "cx", "cy", "id", "ord", "x", "y", "width", "depth", "yaw")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disks: dict = {}
        for big in batches:
            for batch in (big.slice(at, 4000) for at in range(0, big.num_rows, 4000)):
                own = []
                for points, cx, cy in zip(*(batch.column(c).to_pylist() for c in ("ring", "cx", "cy")), strict=True):
                    ring = ring_of(points)
                    key = (cx, cy, *ring)
                    if key not in disks:
                        if len(disks) > 1000:
                            disks.clear()
                        inside = clip(ring, disk_ring(cx, cy, config.center_radius, config.arc_segments))
                        disks[key] = inside, area(inside), is_convex(inside)
                    own.append(disks[key])
                boxes = _columns(batch, ("x", "y", "width", "depth", "yaw"))
                areas = np.zeros(batch.num_rows)
                held = ~np.isnan(boxes).any(axis=0)
                even = np.array([k for k, (inside, _, convex) in enumerate(own) if inside and convex and held[k]], np.int64)
                if len(even):
                    most = max(len(own[k][0]) for k in even)
                    corners = np.array([own[k][0] + own[k][0][-1:] * (most - len(own[k][0])) for k in even])
                    areas[even] = convex_in_boxes(corners[:, :, 0], corners[:, :, 1], boxes[:, even])
                for k, (inside, _, convex) in enumerate(own):
                    if inside and not convex and held[k]:
                        areas[k] = abs(area(clip(inside, box_ring(*boxes[:, k].tolist()))))
                yield pa.RecordBatch.from_arrays([batch.column("room"), batch.column("id"), batch.column("ord"), pa.array([whole for _, whole, _ in own], pa.float64()), pa.array(areas)], names=["room", "id", "ord", "disk", "area"])

    return rows.mapInArrow(shares, "room long, id string, ord int, disk double, area double")


def _box_segments(box: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Distances of boxes (rows of x, y, width, depth, yaw) to segments, as Box.distance_to_segment() has them."""
    cos, sin, hw, hd = np.cos(box[4]), np.sin(box[4]), box[2] / 2, box[3] / 2
    (px, py), (qx, qy) = (((x - box[0]) * cos + (y - box[1]) * sin, (y - box[1]) * cos - (x - box[0]) * sin) for x, y in ((ax, ay), (bx, by)))
    low, high = np.zeros(len(px)), np.ones(len(px))
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, d, h in ((px, qx - px, hw), (py, qy - py, hd)):
            flat, u, v = np.abs(d) < 1e-12, (-h - p) / d, (h - p) / d
            out = np.abs(p) > h + 1e-12
            low = np.maximum(low, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(u, v)))
            high = np.minimum(high, np.where(flat, np.where(out, -1.0, 1.0), np.maximum(u, v)))
        apart = np.minimum(*(np.hypot(np.maximum(np.abs(x) - hw, 0.0), np.maximum(np.abs(y) - hd, 0.0)) for x, y in ((px, py), (qx, qy))))
        for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
            apart = np.minimum(apart, _point_segments(u * hw, v * hd, px, py, qx, qy))
    return np.where(low <= high + 1e-12, 0.0, apart)


def _point_segments(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Distances of points to segments."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    return np.hypot(x - ax - t * dx, y - ay - t * dy)


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of at most so much size together, one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield slice(at, to)
        at = to


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every one of so many places each: whose it is, and its number among them."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: pairs of pieces, and pairs with a third piece, that path_blocking() lays out at once
PAIRS_AT_ONCE, TRIPLES_AT_ONCE = 50000, 100000


def path_blocking(furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """room, s_ord, t_ord and path_blocking_score: the most that another hard piece covers of the corridor between two centres.

    Pairs whose corridor another hard piece comes near to, both ways; a corridor is the same from either end.  A room's
    pieces are one row, and its pairs and what is near them are laid out in parts of bounded size.
    """
    from .relations import soft

    numbers = ("x", "y", "width", "depth", "yaw")
    pieces = furniture.where("room IS NOT NULL AND ord IS NOT NULL")
    rows = pieces.groupBy("room").agg(F.collect_list(F.struct("ord", *numbers, F.coalesce(~soft(F.col("label")), F.lit(False)).alias("hard"))).alias("p"))
    radius = config.corridor_radius

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room, lists = np.asarray(batch.column(0)), batch.column(1)
            ord_, *box, hard = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            box, hard = np.stack(box).astype(np.float64), hard.astype(bool)
            sizes = np.diff(np.asarray(lists.offsets))
            mine = np.repeat(np.arange(len(sizes)), sizes)
            last = np.cumsum(sizes)[mine]
            stones = np.flatnonzero(hard)
            n_stones = np.bincount(mine[stones], minlength=len(sizes))
            first_stone = np.cumsum(n_stones) - n_stones
            reach = radius + np.hypot(box[2], box[3]) / 2 + 1e-9
            partners = np.where(n_stones[mine] > 0, last - np.arange(len(mine)) - 1, 0)
            for some in _parts(partners, PAIRS_AT_ONCE):
                of, k = _spread(partners[some])
                s = of + some.start
                t = s + 1 + k
                apart = (ord_[s] != ord_[t]) & ((box[0, s] != box[0, t]) | (box[1, s] != box[1, t]))
                s, t = s[apart], t[apart]
                for part in _parts(n_stones[mine[s]], TRIPLES_AT_ONCE):
                    of, k = _spread(n_stones[mine[s[part]]])
                    of += part.start
                    o = stones[first_stone[mine[s[of]]] + k]
                    near = (ord_[o] != ord_[s[of]]) & (ord_[o] != ord_[t[of]])
                    of, o = of[near], o[near]
                    ends = box[0, s[of]], box[1, s[of]], box[0, t[of]], box[1, t[of]]
                    near = _point_segments(box[0, o], box[1, o], *ends) <= reach[o]
                    of, o, ends = of[near], o[near], [e[near] for e in ends]
                    near = _box_segments(box[:, o], *ends) < radius
                    of, o, ends = of[near], o[near], [e[near] for e in ends]
                    if not len(of):
                        continue
                    areas = np.concatenate([convex_in_boxes(*corridors_of(*(e[at : at + 500] for e in ends), radius, config.arc_segments), box[:, o[at : at + 500]]) for at in range(0, len(of), 500)])
                    pair, start = np.unique(of, return_index=True)
                    most = np.maximum.reduceat(areas, start)
                    a, b, where = ord_[s[pair]].astype(np.int32), ord_[t[pair]].astype(np.int32), room[mine[s[pair]]]
                    both = (np.concatenate(c) for c in ((where, where), (a, b), (b, a), (most, most)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], names=["room", "s_ord", "t_ord", "path_blocking_score"])

    return rows.mapInArrow(covered, "room long, s_ord int, t_ord int, path_blocking_score double")


def dense_relations(pairs: DataFrame, walls: DataFrame, furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Seven features of every ordered pair, as a long table."""
    from .relations import line_of_sight, occluders, overlaps

    lines = pairs.select("room", "s_ord", "t_ord", F.col("s_x").alias("ax"), F.col("s_y").alias("ay"), F.col("t_x").alias("bx"), F.col("t_y").alias("by"))
    keys = ["room", "s_ord", "t_ord"]
    seen = line_of_sight(lines, occluders(walls, furniture, config), keys, config)
    shared = overlaps(furniture).select(*keys, "overlap_m2")
    rows = pairs.join(keyed(seen), keys).join(keyed(path_blocking(furniture, config)), keys, "left").join(keyed(shared), keys, "left")
    return rows.select(*keys, "s_id", "t_id", "distance_m", F.col("angle_diff_deg").alias("relative_angle_deg"), F.coalesce("overlap_m2", F.lit(0.0)).alias("footprint_overlap_m2"), "facing_score", F.coalesce("path_blocking_score", F.lit(0.0)).alias("path_blocking_score"), F.lit(0.0).alias("same_cluster_score"), F.col("visible").cast("double").alias("line_of_sight"))


def _nodes(segments: list[tuple[P, P]]) -> dict[P, set[P]]:
    """The graph of the segments, cut wherever they meet."""
    key = lambda x, y: (round(x, 9) + 0.0, round(y, 9) + 0.0)
    graph: dict[P, set[P]] = {}
    for i, ((ax, ay), (bx, by)) in enumerate(segments):
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        cuts = {0.0, 1.0}
        for j, ((cx, cy), (ex, ey)) in enumerate(segments):
            if i == j:
                continue
            sx, sy = ex - cx, ey - cy
            turn = dx * sy - dy * sx
            if abs(turn) > 1e-12:
                t, u = ((cx - ax) * sy - (cy - ay) * sx) / turn, ((cx - ax) * dy - (cy - ay) * dx) / turn
                if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                    cuts.add(min(1.0, max(0.0, t)))
            elif abs((cx - ax) * dy - (cy - ay) * dx) < 1e-12:
                cuts |= {t for x, y in ((cx, cy), (ex, ey)) if 0 < (t := ((x - ax) * dx + (y - ay) * dy) / square) < 1}
        points = [key(ax + t * dx, ay + t * dy) for t in sorted(cuts)]
        for p, q in zip(points, points[1:], strict=False):
            if p != q:
                graph.setdefault(p, set()).add(q)
                graph.setdefault(q, set()).add(p)
    return graph


def largest_face(segments: list[tuple[P, P]]) -> list[P] | None:
    """The face of the drawing with the largest area, counterclockwise; None if nothing is closed."""
    graph = _nodes(segments)
    loose = [p for p, near in graph.items() if len(near) < 2]
    while loose:  # ends that lead nowhere
        p = loose.pop()
        for q in graph.pop(p, ()):
            graph[q].discard(p)
            if len(graph[q]) < 2:
                loose.append(q)
    turn = {p: sorted(near, key=lambda q, p=p: math.atan2(q[1] - p[1], q[0] - p[0])) for p, near in graph.items()}
    seen: set[tuple[P, P]] = set()
    best: list[P] | None = None
    for p in turn:
        for q in turn[p]:
            ring, a, b = [], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                around = turn[b]
                a, b = b, around[around.index(a) - 1]  # the next one clockwise from where we came
            if len(ring) > 2 and area(ring) > 1e-12 and (best is None or area(ring) > area(best) + 1e-12):
                best = ring
    return best


def hull(points: list[P]) -> list[P]:
    points = sorted(set(points))
    half: list[list[P]] = []
    for order in (points, points[::-1]):
        out: list[P] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        half.append(out[:-1])
    return half[0] + half[1]


def room_polygons(walls: DataFrame, entities: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """room, ring (closed), area, cx, cy of every room: the walls' largest face, else their hull, else what is around all boxes."""
    from .relations import bounds

    step = config.grid_snap
    collected = walls.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", "ax", "ay", "bx", "by"))).alias("w"))
    rows = bounds(entities, 0.0).join(keyed(collected), "room", "full")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snap = lambda v: round(v / step) * step  # noqa: E731  halves to even
        for batch in batches:
            rings, areas, xs, ys = [], [], [], []
            for r in batch.to_pylist():
                segments = [((snap(w["ax"]), snap(w["ay"])), (snap(w["bx"]), snap(w["by"]))) for w in r["w"] or ()]
                segments = [s for s in segments if s[0] != s[1]]
                ring = largest_face(segments) if segments else None
                if ring is None and len(segments) > 1:
                    ring = hull([p for s in segments for p in s])
                    ring = ring if len(ring) > 2 and area(ring) > 0 else None
                if ring is None:
                    x0, x1, y0, y1 = (r[c] for c in ("min_x", "max_x", "min_y", "max_y"))
                    if x0 is None or x1 <= x0 or y1 <= y0:
                        x0, x1, y0, y1 = -1.0, 1.0, -1.0, 1.0
                    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
                cx, cy = centroid(ring)
                rings.append([{"x": x, "y": y} for x, y in [*ring, ring[0]]])
                areas.append(abs(area(ring)))
                xs.append(cx)
                ys.append(cy)
            yield pa.RecordBatch.from_arrays([batch.column("room"), pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.array(areas, pa.float64()), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["room", "ring", "area", "cx", "cy"])

    return rows.mapInArrow(traced, "room long, ring array<struct<x:double,y:double>>, area double, cx double, cy double")
