"""Pairwise relations of a room's entities: features, typed edges, line of sight.

All joins are equi-joins on the room with the geometric condition as residual, so that rooms are spread over the cluster
by their key and one exchange serves every join, window and aggregate that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import geometry as g
from ..functions import vocab
from ..functions.geometry import keyed

BOX = (*g.BOXED, "height", "label", "ord", "id")
#: every edge has these features, null where a type has none
FEATURES = ("distance_m", "angle_error_deg", "angle_diff_deg", "overlap_m2", "clearance_m", "yaw_diff_deg", "coverage", "length_m", "score")


def is_in(label: Column, names: tuple[str, ...]) -> Column:
    return F.lower(label).isin(*names)


def soft(label: Column) -> Column:
    return is_in(label, vocab.SOFT)


def side(df: DataFrame, prefix: str, columns: tuple[str, ...] = BOX) -> DataFrame:
    return df.select("room", *(F.col(c).alias(f"{prefix}{c}") for c in columns))


def pairs(furniture: DataFrame, within: float | None = None) -> DataFrame:
    """All ordered pairs of different pieces of a room, and their features.  within: only pairs whose centres are so near."""
    a, b = side(furniture, "s_"), side(furniture, "t_")
    condition = F.col("s_ord") != F.col("t_ord")
    distance = g.hypot(F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y"))
    if within is not None:
        condition = condition & (distance <= within)
    source, target = g.Box.of("s_"), g.Box.of("t_")
    joined = a.join(keyed(b), "room").where(condition)
    dx, dy = target.x - source.x, target.y - source.y
    fx, fy = source.forward
    rx, ry = source.right
    forward, right = dx * fx + dy * fy, dx * rx + dy * ry
    direction = F.when(F.abs(forward) >= F.abs(right), F.when(forward >= 0, "front").otherwise("back")).otherwise(F.when(right >= 0, "right").otherwise("left"))
    return joined.select(
        *joined.columns,
        distance.alias("distance_m"),
        g.yaw_difference(source.yaw, target.yaw).alias("angle_diff_deg"),
        F.when(distance == 0, 0.0).otherwise(F.greatest(F.lit(0.0), forward / distance)).alias("facing_score"),
        g.angle_between((fx, fy), (dx, dy)).alias("angle_error_deg"),
        direction.alias("direction"),
    )


def _edge(kind: str, condition: Column, **features: Column) -> Column:
    null = F.lit(None).cast("double")
    return F.when(condition, F.struct(F.lit(kind).alias("type"), *(features.get(f, null).alias(f) for f in FEATURES)))


def _edges(df: DataFrame, source: str, target: str, *kinds: Column) -> DataFrame:
    """One pass over the pairs, a row for each kind that holds."""
    rows = df.select("room", F.col(source).alias("src"), F.col(target).alias("dst"), F.explode(F.array_compact(F.array(*kinds))).alias("e"))
    return rows.select("room", "src", "dst", "e.*")


def object_edges(pair_rows: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    d, error, turn = (F.col(c) for c in ("distance_m", "angle_error_deg", "angle_diff_deg"))
    names = {"front": "in_front_of", "back": "behind", "left": "left_of", "right": "right_of"}
    return _edges(
        pair_rows, "s_id", "t_id",
        _edge("near", d <= config.near, distance_m=d),
        _edge("faces", (F.col("facing_score") > 0) & (error <= config.facing_deg) & (d <= config.far * 1.5), distance_m=d, angle_error_deg=error),
        _edge("parallel_to", (turn <= config.parallel_deg) & (d <= config.far), angle_diff_deg=turn),
        *(_edge(kind, (d <= config.far) & (F.col("direction") == way), distance_m=d) for way, kind in names.items()),
    )


def overlaps(furniture: DataFrame) -> DataFrame:
    """room, ids and ords of pairs whose boxes may meet, both ways, and the area they share.

    Boxes are sifted by distance in the join; areas of a batch are computed at once, by Green's theorem over the parts of
    each outline inside the other box.  Where outlines run along each other the part counts once, and only if both boxes
    are on the same side of it.
    """
    columns = ("x", "y", "width", "depth", "yaw", "ord", "id")
    a, b = side(furniture, "s_", columns), side(furniture, "t_", columns)
    reach = (g.hypot(F.col("s_width"), F.col("s_depth")) + g.hypot(F.col("t_width"), F.col("t_depth"))) / 2
    near = g.hypot(F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y")) < reach
    rows = a.join(keyed(b), "room").where((F.col("s_ord") < F.col("t_ord")) & near)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.array([np.asarray(batch.column(p + c)) for c in columns[:5]]) for p in ("s_", "t_"))
            area = box_overlaps(one, two)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("room", "s_ord", "t_ord", "s_id", "t_id")), pa.array(area)], names=["room", "s_ord", "t_ord", "s_id", "t_id", "overlap_m2"])

    half = rows.mapInArrow(shared, "room long, s_ord int, t_ord int, s_id string, t_id string, overlap_m2 double")
    ways = F.array(*(F.struct(*(F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in pair for c in ("ord", "id"))) for pair in ((("s", "s"), ("t", "t")), (("t", "s"), ("s", "t")))))
    return half.select("room", "overlap_m2", F.explode(ways).alias("w")).select("room", "w.*", "overlap_m2")


def box_overlaps(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Areas that pairs of boxes share; rows of each: x, y, width, depth, yaw."""
    total = np.zeros(one.shape[1])
    for mine, other, first in ((one, two, True), (two, one, False)):
        cos, sin = np.cos(mine[4]), np.sin(mine[4])
        corners = [(mine[0] + u * mine[2] / 2 * cos - v * mine[3] / 2 * sin, mine[1] + u * mine[2] / 2 * sin + v * mine[3] / 2 * cos) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        cos, sin = np.cos(other[4]), np.sin(other[4])
        local = [((x - other[0]) * cos + (y - other[1]) * sin, (y - other[1]) * cos - (x - other[0]) * sin) for x, y in corners]
        for k in range(4):
            (px, py), (qx, qy), (ax, ay), (bx, by) = local[k], local[k - 3], corners[k], corners[k - 3]
            low, high = np.zeros(len(px)), np.ones(len(px))
            for p, d, h in ((px, qx - px, other[2] / 2), (py, qy - py, other[3] / 2)):
                flat = np.abs(d) < 1e-12
                with np.errstate(divide="ignore", invalid="ignore"):
                    u, v = (-h - p) / d, (h - p) / d
                out = np.abs(p) > h + 1e-12
                low = np.maximum(low, np.where(flat, np.where(out, 2.0, 0.0), np.minimum(u, v)))
                high = np.minimum(high, np.where(flat, np.where(out, -1.0, 1.0), np.maximum(u, v)))
            dx, dy = qx - px, qy - py
            along_x = (np.abs(dx) < 1e-9) & (np.abs(np.abs(px) - other[2] / 2) < 1e-9)
            along_y = ~along_x & (np.abs(dy) < 1e-9) & (np.abs(np.abs(py) - other[3] / 2) < 1e-9)
            counts = (low < high) & (~(along_x | along_y) | (first & np.where(along_x, dy * px > 0, dx * py < 0)))
            # ends of the part, seen from the second box's centre
            ux, uy, vx, vy = ax + low * (bx - ax) - two[0], ay + low * (by - ay) - two[1], ax + high * (bx - ax) - two[0], ay + high * (by - ay) - two[1]
            total += np.where(counts, ux * vy - uy * vx, 0.0)
    return np.maximum(total / 2, 0.0)


def overlap_edges(rows: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    return _edges(rows, "s_id", "t_id", _edge("overlaps", F.col("overlap_m2") > config.overlap_area, overlap_m2=F.col("overlap_m2")))


def wall_pairs(furniture: DataFrame, walls: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Pieces that may have a wall edge with the walls near enough for one: clearance, yaw difference, back clearance and coverage.

    A wall is too far if a circle around the piece is.  Coverage is null where the back is too far for a backing.
    """
    rows = furniture.where(~soft(F.col("label")) | is_in(F.col("label"), vocab.SOFT_ON_WALLS))
    joined = rows.join(keyed(side(walls, "w_", ("id", "ax", "ay", "bx", "by", "ord"))), "room")
    box, a, b = g.Box.of(), (F.col("w_ax"), F.col("w_ay")), (F.col("w_bx"), F.col("w_by"))
    reach = max(config.touching, config.against * 2, config.backing_clearance) + 1e-6
    columns = joined.columns
    near = joined.where(g.point_segment((box.x, box.y), a, b) <= g.hypot(box.width, box.depth) / 2 + reach)
    near = near.withColumn("clearance_m", box.distance_to_segment(a, b)).withColumn("back_m", g.segment_segment(box.back[0], box.back[1], a, b))
    near = g.settled(near)
    back = box.back
    points = [(back[0][0] + (back[1][0] - back[0][0]) * s, back[0][1] + (back[1][1] - back[0][1]) * s) for s in (k / 8 for k in range(9))]
    hits = sum((F.when(g.point_segment(p, a, b) <= config.backing_sample_distance, 1.0).otherwise(0.0) for p in points), F.lit(0.0))
    return near.select(
        *columns,
        "clearance_m",
        g.yaw_difference(box.yaw, F.atan2(b[1] - a[1], b[0] - a[0])).alias("yaw_diff_deg"),
        "back_m",
        F.when(F.col("back_m") <= config.backing_clearance, F.when(box.width <= 0, 0.0).otherwise(hits / 9)).alias("coverage"),
    )


def wall_edges(rows: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    clear, turn = F.col("clearance_m"), F.col("yaw_diff_deg")
    both = {"clearance_m": clear, "yaw_diff_deg": turn}
    return _edges(
        rows, "id", "w_id",
        _edge("touching_wall", clear <= config.touching, **both),
        _edge("against_wall", (clear > config.touching) & (clear <= config.against), **both),
        _edge("parallel_to_wall", (turn <= config.parallel_deg) & (clear <= config.against * 2), **both),
        _edge("has_backing", (F.col("back_m") <= config.backing_clearance) & (F.col("coverage") >= config.backing_coverage), clearance_m=F.col("back_m"), coverage=F.col("coverage")),
    )


def plain_edges(df: DataFrame, source: Column, target: Column, kind: Column, **features: Column) -> DataFrame:
    null = F.lit(None).cast("double")
    return df.select("room", source.alias("src"), target.alias("dst"), kind.alias("type"), *(features.get(f, null).alias(f) for f in FEATURES))


def inside_edges(entities: DataFrame, rooms: DataFrame) -> DataFrame:
    """inside_room or outside_room of everything but walls; the outline counts as inside."""
    rows = entities.where("kind <> 'wall'").join(keyed(rooms.select("room", "ring")), "room")
    inside = g.in_ring(F.col("ring"), F.col("x"), F.col("y"))
    return plain_edges(rows, F.col("id"), F.lit("room_0"), F.when(inside, "inside_room").otherwise("outside_room"))


def fixture_edges(fixtures: DataFrame, walls: DataFrame) -> DataFrame:
    rows = fixtures.join(keyed(walls.select("room", F.col("id").alias("wall_id"))), ["room", "wall_id"])
    return plain_edges(rows, F.col("id"), F.col("wall_id"), F.concat("kind", F.lit("_in_wall")))


def bounds(entities: DataFrame, pad: float = SceneConfig.bounds_pad) -> DataFrame:
    """The rectangle around all boxes of a room, padded."""
    half_x = (F.col("width") * F.abs(F.cos("yaw")) + F.col("depth") * F.abs(F.sin("yaw"))) / 2
    half_y = (F.col("width") * F.abs(F.sin("yaw")) + F.col("depth") * F.abs(F.cos("yaw"))) / 2
    return entities.groupBy("room").agg(
        (F.min(F.col("x") - half_x) - pad).alias("min_x"), (F.max(F.col("x") + half_x) + pad).alias("max_x"),
        (F.min(F.col("y") - half_y) - pad).alias("min_y"), (F.max(F.col("y") + half_y) + pad).alias("max_y"),
    )


def wall_entities(walls: DataFrame) -> DataFrame:
    """Walls as boxes."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return walls.select(
        "room", "ord", "id", F.lit("wall").alias("kind"), F.lit("wall").alias("label"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"),
        (F.col("height") / 2).alias("z"), g.hypot(dx, dy).alias("width"), F.greatest(F.col("thickness"), F.lit(0.02)).alias("depth"), "height", F.atan2(dy, dx).alias("yaw"),
    )


def occluders(walls: DataFrame, furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """What hides at eye height: walls as segments, tall boxes that aren't soft."""
    null = F.lit(None).cast("double")
    tall = furniture.where((F.col("height") >= config.opaque_height) & ~soft(F.col("label")))
    lines = walls.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    columns = ("o_x", "o_y", "o_width", "o_depth", "o_yaw", "o_cos", "o_sin", "o_ax", "o_ay", "o_bx", "o_by")
    as_box = tall.select("room", F.col("id").alias("o_id"), *(F.col(c[2:]).alias(c) for c in columns[:7]), *(null.alias(c) for c in columns[7:]))
    as_line = lines.select("room", F.col("id").alias("o_id"), *(null.alias(c) for c in columns[:7]), *(F.col(c[2:]).alias(c) for c in columns[7:]))
    return as_box.unionByName(as_line)


def line_of_sight(lines: DataFrame, hiding: DataFrame, keys: list[str], config: SceneConfig = SceneConfig()) -> DataFrame:
    """keys and visible of segments (ax, ay) to (bx, by).

    Free if nothing is met, or if all that is met is one point within a millimetre of an end.
    """
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    rows = lines.join(keyed(hiding), "room", "left")
    box_first, box_last = g.Box.of("o_").clip(a, b)
    c, d = (F.col("o_ax"), F.col("o_ay")), (F.col("o_bx"), F.col("o_by"))
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    turn = rx * sy - ry * sx
    t, u = F.try_divide((c[0] - a[0]) * sy - (c[1] - a[1]) * sx, turn), F.try_divide((c[0] - a[0]) * ry - (c[1] - a[1]) * rx, turn)
    square = rx * rx + ry * ry
    along = F.abs((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) < 1e-12
    t0, t1 = F.try_divide((c[0] - a[0]) * rx + (c[1] - a[1]) * ry, square), F.try_divide((d[0] - a[0]) * rx + (d[1] - a[1]) * ry, square)
    flat = F.abs(turn) < 1e-12
    line_first = F.when(flat, F.when(along, F.greatest(F.lit(0.0), F.least(t0, t1))).otherwise(2.0)).otherwise(F.when((u >= -1e-12) & (u <= 1 + 1e-12), t).otherwise(2.0))
    line_last = F.when(flat, F.when(along, F.least(F.lit(1.0), F.greatest(t0, t1))).otherwise(-1.0)).otherwise(F.when((u >= -1e-12) & (u <= 1 + 1e-12), t).otherwise(-1.0))
    is_box = F.col("o_x").isNotNull()
    first, last = F.when(is_box, box_first).otherwise(line_first), F.when(is_box, box_last).otherwise(line_last)
    met = F.col("o_id").isNotNull() & (first <= last + 1e-12) & (last >= -1e-12) & (first <= 1 + 1e-12)
    length = F.sqrt(square)
    rows = rows.select(*keys, length.alias("length"), F.when(met, first).alias("first"), F.when(met, last).alias("last"))
    seen = rows.groupBy(*keys).agg(F.max("length").alias("length"), F.min("first").alias("first"), F.max("last").alias("last"))
    point = (F.col("last") - F.col("first")) * F.col("length") < 1e-9
    at_end = F.least(F.abs(F.col("first")), F.abs(1 - F.col("first"))) * F.col("length") <= 1e-3
    visible = (F.col("length") == 0) | F.col("first").isNull() | (point & at_end)
    return seen.select(*keys, visible.alias("visible"))
