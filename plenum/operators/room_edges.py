"""Edges of many rooms at once, in numpy, for those who read a room as one row: nodes are places, not names.

They are those of relations.object_edges(), wall_edges() and fixture_edges(), and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..config import SceneConfig
from ..functions import vocab
from .polygons import _box_segments, _parts, _point_segments, _spread

#: pairs of pieces, or of pieces and walls, that are laid out at once
PAIRS_AT_ONCE = 50000

NUMBER = {name: k for k, name in enumerate(vocab.EDGE_FEATURES)}
TYPE = {name: k for k, name in enumerate(vocab.EDGE_TYPES)}


@dataclass
class Edges:
    """Places of sources and targets, types as places in the vocabulary, and the continuous features (0: none)."""

    src: np.ndarray
    dst: np.ndarray
    type: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple]) -> Edges:
        """parts: sources, targets, type (one or an array), and a column of numbers for each feature that there is."""
        sizes = [len(p[0]) for p in parts]
        src, dst = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        kinds = np.concatenate([np.broadcast_to(p[2], n) for p, n in zip(parts, sizes, strict=True)] or [np.zeros(0, np.int64)])
        numbers, at = np.zeros((len(src), len(NUMBER))), 0
        for (*_, features), n in zip(parts, sizes, strict=True):
            for name, value in features.items():
                numbers[at : at + n, NUMBER[name]] = value
            at += n
        return cls(src, dst, kinds, numbers)


def _turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """geometry.yaw_difference()"""
    d = np.degrees(a - b)
    d = np.abs(np.where(np.abs(d) <= 180, d, np.mod(d + 180.0, 360.0) - 180.0))
    return np.minimum(d, 180.0 - d)


def _of_pairs(counts: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places s and first[s], first[s] + 1, ...: counts[s] of them, in parts."""
    for some in _parts(counts, PAIRS_AT_ONCE):
        of, k = _spread(counts[some])
        s = of + some.start
        yield s, first[s] + k


def object_edges(box: np.ndarray, ord_: np.ndarray, counts: np.ndarray, first: np.ndarray, config: SceneConfig = SceneConfig()) -> list[tuple]:
    """box: rows of x, y, width, depth, yaw; of each piece counts and first: how many pieces its room has, and the first one's place."""
    cos, sin = np.cos(box[4]), np.sin(box[4])
    out = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for s, t in _of_pairs(counts, first):
            dx, dy = box[0, t] - box[0, s], box[1, t] - box[1, s]
            d = np.sqrt(dx * dx + dy * dy)
            kept = (ord_[s] != ord_[t]) & (d <= max(config.near, config.far * 1.5))
            s, t, dx, dy, d = s[kept], t[kept], dx[kept], dy[kept], d[kept]
            fx, fy = -sin[s], cos[s]
            forward, right = dx * fx + dy * fy, dx * fy - dy * fx
            size = np.sqrt(fx * fx + fy * fy) * d
            error = np.where(size == 0, 0.0, np.degrees(np.arccos(np.clip(forward / size, -1.0, 1.0))))
            turn = _turned(box[4, s], box[4, t])
            near = d <= config.near
            out.append((s[near], t[near], TYPE["near"], {"distance_m": d[near]}))
            faces = (d > 0) & (forward / d > 0) & (error <= config.facing_deg) & (d <= config.far * 1.5)
            out.append((s[faces], t[faces], TYPE["faces"], {"distance_m": d[faces], "angle_error_deg": error[faces]}))
            parallel = (turn <= config.parallel_deg) & (d <= config.far)
            out.append((s[parallel], t[parallel], TYPE["parallel_to"], {"angle_diff_deg": turn[parallel]}))
            way = np.where(np.abs(forward) >= np.abs(right), np.where(forward >= 0, TYPE["in_front_of"], TYPE["behind"]), np.where(right >= 0, TYPE["right_of"], TYPE["left_of"]))
            close = d <= config.far
            out.append((s[close], t[close], way[close], {"distance_m": d[close]}))
    return out


def wall_edges(box: np.ndarray, counts: np.ndarray, first: np.ndarray, ends: np.ndarray, config: SceneConfig = SceneConfig()) -> list[tuple]:
    """Of each piece counts and first: how many walls it may have an edge with, and the first one's place; ends: rows of ax, ay, bx, by."""
    reach = max(config.touching, config.against * 2, config.backing_clearance) + 1e-6
    out = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for s, w in _of_pairs(counts, first):
            near = _point_segments(box[0, s], box[1, s], *ends[:, w]) <= np.sqrt(box[2, s] * box[2, s] + box[3, s] * box[3, s]) / 2 + reach
            s, w = s[near], w[near]
            own, (ax, ay, bx, by) = box[:, s], ends[:, w]
            clear, turn = _box_segments(own, ax, ay, bx, by), _turned(own[4], np.arctan2(by - ay, bx - ax))
            both = {"clearance_m": clear, "yaw_diff_deg": turn}
            for name, holds in (("touching_wall", clear <= config.touching), ("against_wall", (clear > config.touching) & (clear <= config.against)), ("parallel_to_wall", (turn <= config.parallel_deg) & (clear <= config.against * 2))):
                out.append((s[holds], w[holds], TYPE[name], {k: v[holds] for k, v in both.items()}))
            cos, sin = np.cos(own[4]), np.sin(own[4])
            (px, py), (qx, qy) = ((own[0] + own[2] / 2 * u * cos + own[3] / 2 * sin, own[1] + own[2] / 2 * u * sin - own[3] / 2 * cos) for u in (-1, 1))
            back = _segments(px, py, qx, qy, ax, ay, bx, by)
            hits = sum(_point_segments(px + (qx - px) * k / 8, py + (qy - py) * k / 8, ax, ay, bx, by) <= config.backing_sample_distance for k in range(9))
            cover = np.where(own[2] <= 0, 0.0, hits / 9)
            holds = (back <= config.backing_clearance) & (cover >= config.backing_coverage)
            out.append((s[holds], w[holds], TYPE["has_backing"], {"clearance_m": back[holds], "coverage": cover[holds]}))
    return out


def _segments(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """geometry.segment_segment()"""
    cross = lambda ox, oy, px, py, qx, qy: (px - ox) * (qy - oy) - (py - oy) * (qx - ox)
    meet = (cross(ax, ay, bx, by, cx, cy) * cross(ax, ay, bx, by, dx, dy) < 0) & (cross(cx, cy, dx, dy, ax, ay) * cross(cx, cy, dx, dy, bx, by) < 0)
    apart = np.minimum(_point_segments(ax, ay, cx, cy, dx, dy), _point_segments(bx, by, cx, cy, dx, dy))
    apart = np.minimum(apart, np.minimum(_point_segments(cx, cy, ax, ay, bx, by), _point_segments(dx, dy, ax, ay, bx, by)))
    return np.where(meet, 0.0, apart)
