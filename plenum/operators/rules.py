"""The nine layout rules.  Each gives checks: room, principle, target, status, score, evidence (texts), against (ids), rule_order.

A rule is a function of the scene's tables; RULES is the registry, in order, and may be extended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import geometry as g
from ..functions import vocab
from ..functions.geometry import keyed
from .relations import BOX, is_in, line_of_sight, occluders, plain_edges, side, soft

CHECK = ("room", "principle", "target", "status", "score", "evidence", "against", "target_ord")


@dataclass
class Tables:
    """What the rules read.  backings: has_backing edges; doors: fixtures of kind door with is_entry."""

    furniture: DataFrame
    fixtures: DataFrame
    walls: DataFrame
    rooms: DataFrame
    zones: DataFrame
    backings: DataFrame
    doors: DataFrame
    config: SceneConfig = SceneConfig()


def classify_doors(fixtures: DataFrame, walls: DataFrame, rooms: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Doors with their wall (null if unknown) and is_entry: not both sides of the door are in the room."""
    own = walls.select("room", F.col("id").alias("wall_id"), *(F.col(c).alias(f"w_{c}") for c in ("ax", "ay", "bx", "by")))
    rows = fixtures.where("kind = 'door'").join(keyed(own), ["room", "wall_id"], "left").join(keyed(rooms.select("room", "ring")), "room")
    dx, dy = F.col("w_bx") - F.col("w_ax"), F.col("w_by") - F.col("w_ay")
    n = F.when(g.hypot(dx, dy) == 0, 1.0).otherwise(g.hypot(dx, dy))
    tx, ty = F.coalesce(dx / n, F.cos("yaw")), F.coalesce(dy / n, F.sin("yaw"))
    rows = rows.withColumn("nx", ty).withColumn("ny", -tx)
    probe = lambda s: g.in_ring(F.col("ring"), F.col("x") + F.col("nx") * s * config.door_probe, F.col("y") + F.col("ny") * s * config.door_probe)
    return rows.withColumn("is_entry", ~(probe(1) & probe(-1))).drop("ring")


def _check(df: DataFrame, principle: str, target: Column, status: Column, score: Column, evidence: Column, target_ord: Column, against: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("room", F.lit(principle).alias("principle"), target.alias("target"), status.alias("status"), score.cast("double").alias("score"), evidence.alias("evidence"), (none if against is None else against).alias("against"), target_ord.alias("target_ord"))


def _anchors(t: Tables, kinds: tuple[str, ...], primary_only: bool) -> DataFrame:
    """Anchors of zones as boxes, each once: seating anchors only if they are sofas, couches or armchairs."""
    first = Window.partitionBy("room", "anchor_id").orderBy("zone_order", "zone")
    rows = t.zones.where(F.col("type").isin(*kinds)).select("room", "anchor_id", "type", "zone", "zone_order").join(keyed(t.furniture.withColumnRenamed("id", "anchor_id").select("room", "anchor_id", *(c for c in BOX if c != "id"))), ["room", "anchor_id"])
    if primary_only:
        rows = rows.where((F.col("type") != "seating_group") | is_in(F.col("label"), vocab.PRIMARY_SEATS))
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").withColumnRenamed("anchor_id", "id")


def _axis(t: Tables) -> tuple[g.Point, g.Point]:
    reach = t.config.ray
    return (F.col("d_x") + F.col("d_nx") * reach, F.col("d_y") + F.col("d_ny") * reach), (F.col("d_x") - F.col("d_nx") * reach, F.col("d_y") - F.col("d_ny") * reach)


def command_position(t: Tables) -> DataFrame:
    c = t.config
    candidates = _anchors(t, ("seating_group", "bed_group", "desk_group"), True)
    doors = side(t.doors.where("is_entry"), "d_", ("id", "x", "y", "nx", "ny", "w_ax", "ord"))
    d = g.hypot(F.col("d_x") - F.col("x"), F.col("d_y") - F.col("y"))
    nearest = Window.partitionBy("room", "id").orderBy("d", "d_ord")
    rows = candidates.join(keyed(doors), "room").withColumn("d", d).withColumn("n", F.row_number().over(nearest)).where("n = 1")
    lines = rows.select("room", "id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("d_x").alias("bx"), F.col("d_y").alias("by"))
    seen = line_of_sight(lines, occluders(t.walls, t.furniture, c), ["room", "id"], c)
    backed = t.backings.groupBy("room", F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("backs"))
    rows = rows.join(keyed(seen), ["room", "id"]).join(keyed(backed), ["room", "id"], "left")
    hidden, close = ~F.col("visible"), F.col("d") < c.command_door
    has_axis = F.col("d_w_ax").isNotNull()
    aligned = has_axis & g.Box.of().meets_segment(*_axis(t))
    bare = F.col("backs").isNull()
    off = lambda cond, v: F.when(cond, v).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - off(hidden, 0.4) - off(close, 0.2) - off(aligned, 0.3) - off(bare, 0.3)))
    status = F.when(hidden | aligned, "violated").when(close | bare, "weak").otherwise("good")
    door, me = F.col("d_id"), F.col("id")
    evidence = F.array_compact(F.array(
        F.format_string("entry door %s %s visible from %s", door, F.when(hidden, "is NOT").otherwise("is"), me),
        F.when(close, F.format_string("too close to entry: %.2fm < %.2fm", "d", F.lit(c.command_door))).otherwise(F.format_string("distance to entry door %.2fm is comfortable", "d")),
        F.when(aligned, F.format_string("directly aligned with door %s (door axis crosses footprint)", door)).when(has_axis, F.format_string("not directly aligned with door %s", door)),
        F.when(bare, "lacks wall backing").otherwise(F.format_string("has wall backing (%s)", F.array_join("backs", ", "))),
    ))
    return _check(rows, "command_position", me, status, score, evidence, F.col("ord"), F.array(door))


def solid_backing(t: Tables) -> DataFrame:
    targets = _anchors(t, ("bed_group", "seating_group"), True)
    backed = t.backings.groupBy("room", F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("backs"))
    me = g.Box.of("a_")
    cut = g.Box.of("f_").distance_to_segment(*me.back)
    cuts = side(targets, "a_").join(keyed(side(t.fixtures, "f_", ("id", *g.BOXED, "ord"))), "room").where(cut <= min(0.2, t.config.fixture_cut))
    cuts = cuts.groupBy("room", F.col("a_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("f_ord", "f_id"))).alias("c")).select("room", "id", F.transform("c", lambda x: x["f_id"]).alias("cuts"))
    rows = targets.join(keyed(backed), ["room", "id"], "left").join(keyed(cuts), ["room", "id"], "left")
    bare, is_cut = F.col("backs").isNull(), F.col("cuts").isNotNull()
    evidence = F.when(bare, F.format_string("%s has no wall backing", "id")).when(is_cut, F.format_string("back of %s is cut by %s", "id", F.array_join("cuts", ", "))).otherwise(F.format_string("%s has solid wall backing (%s)", "id", F.array_join("backs", ", ")))
    return _check(rows, "solid_backing", F.col("id"), F.when(bare, "violated").when(is_cut, "weak").otherwise("good"), F.when(bare, 0.0).when(is_cut, 0.4).otherwise(1.0), F.array(evidence), F.col("ord"))


def bed_aligned_with_door(t: Tables) -> DataFrame:
    beds = _anchors(t, ("bed_group",), False)
    doors = side(t.doors.where("w_ax IS NOT NULL"), "d_", ("id", "x", "y", "nx", "ny", "ord"))
    hits = beds.join(keyed(doors), "room").where(g.Box.of().meets_segment(*_axis(t))).groupBy("room", "id").agg(F.sort_array(F.collect_list(F.struct("d_ord", "d_id"))).alias("h"))
    rows = beds.join(keyed(hits.select("room", "id", F.array_join(F.transform("h", lambda x: x["d_id"]), ", ").alias("hits"))), ["room", "id"], "left")
    bad = F.col("hits").isNotNull()
    evidence = F.when(bad, F.format_string("bed %s is on the direct axis of door(s) %s", "id", "hits")).otherwise(F.format_string("bed %s is not on a direct door axis", "id"))
    return _check(rows, "bed_aligned_with_door", F.col("id"), F.when(bad, "violated").otherwise("good"), F.when(bad, 0.0).otherwise(1.0), F.array(evidence), F.col("ord"))


def mirror_faces_bed(t: Tables) -> DataFrame:
    mirrors, beds = side(t.furniture.where(is_in(F.col("label"), ("mirror",))), "m_"), side(t.furniture.where(is_in(F.col("label"), vocab.BEDS)), "b_")
    m = g.Box.of("m_")
    fx, fy = m.forward
    ray = ((m.x, m.y), (m.x + fx * t.config.ray, m.y + fy * t.config.ray))
    rows = mirrors.join(keyed(beds), "room").where(g.Box.of("b_").meets_segment(*ray)).groupBy("room", "m_id", "m_ord").agg(F.sort_array(F.collect_list(F.struct("b_ord", "b_id"))).alias("h"))
    evidence = F.format_string("mirror %s reflects toward bed(s) %s", "m_id", F.array_join(F.transform("h", lambda x: x["b_id"]), ", "))
    return _check(rows, "mirror_faces_bed", F.col("m_id"), F.lit("violated"), F.lit(0.0), F.array(evidence), F.col("m_ord"))


def clear_center(t: Tables) -> DataFrame:
    """Share of the middle disk that boxes cover; where boxes overlap, their areas count twice."""
    from .polygons import disk_shares

    areas = disk_shares(t.rooms, t.furniture.where(~soft(F.col("label"))), t.config)
    w = Window.partitionBy("room").orderBy(F.col("area").desc(), "ord")
    ranked = areas.withColumn("n", F.row_number().over(w))
    text = F.when((F.col("n") <= 5) & (F.col("area") > 0), F.struct("n", F.format_string("%s(%.2fm^2)", "id", "area").alias("t")))
    rows = ranked.groupBy("room").agg(F.max("disk").alias("disk"), F.sum("area").alias("blocked"), F.sort_array(F.collect_list(text)).alias("top")).where("disk > 0")
    rows = rows.withColumn("occ", F.coalesce(F.col("blocked"), F.lit(0.0)) / F.col("disk"))
    occ, most = F.col("occ"), t.config.center_occupancy
    status = F.when(occ >= most, "violated").when(occ > most * 0.5, "weak").otherwise("good")
    evidence = F.array_compact(F.array(F.format_string("central disk occupancy %.0f%%", occ * 100), F.when(F.size("top") > 0, F.concat(F.lit("central blockers: "), F.array_join(F.transform("top", lambda x: x["t"]), ", ")))))
    return _check(rows, "clear_center", F.lit("room_0"), status, F.greatest(F.lit(0.0), 1.0 - occ), evidence, F.lit(0))


def sharp_corner(t: Tables) -> DataFrame:
    c = t.config
    seats = side(_anchors(t, ("seating_group",), False), "s_")
    others = side(t.furniture.where(~soft(F.col("label"))), "o_")
    seat = g.Box.of("s_")
    corners = F.array(*(F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(g.Box.of("o_").corners)))
    rows = seats.join(keyed(others), "room").where("s_id <> o_id").withColumn("c", F.explode(corners))
    v = (F.col("c.x") - seat.x, F.col("c.y") - seat.y)
    rows = rows.withColumn("d", g.hypot(*v)).withColumn("a", g.angle_between(seat.forward, v)).where((F.col("d") <= c.corner_distance) & (F.col("a") <= c.corner_deg))
    first = Window.partitionBy("room", "s_id", "o_id").orderBy("c.k")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    text = F.struct("o_ord", F.format_string("%s corner %.2fm away at %.1fdeg from forward axis", "o_id", "d", "a").alias("t"))
    rows = rows.groupBy("room", "s_id", "s_ord").agg(F.sort_array(F.collect_list(text)).alias("e"))
    return _check(rows, "sharp_corner_points_at_seat", F.col("s_id"), F.lit("weak"), F.greatest(F.lit(0.0), 1.0 - 0.2 * F.size("e")), F.transform("e", lambda x: x["t"]), F.col("s_ord"))


def pairing_balance(t: Tables) -> DataFrame:
    c = t.config
    beds = t.zones.where("type = 'bed_group'").select("room", F.col("anchor_id").alias("id"), "members").join(keyed(t.furniture.select("room", *BOX)), ["room", "id"])
    stands = side(t.furniture.where(is_in(F.col("label"), vocab.NIGHTSTANDS)), "n_")
    me = g.Box.of()
    left, right = me.world(-me.width / 2, F.lit(0.0)), me.world(me.width / 2, F.lit(0.0))
    rows = beds.join(keyed(stands), "room", "left")
    d_left, d_right = (g.hypot(F.col("n_x") - x, F.col("n_y") - y) for x, y in (left, right))
    reach = c.nightstand + c.side_slack
    own = F.array_contains("members", F.col("n_id"))
    is_left = own & (d_left < d_right) & (d_left <= reach)
    is_right = own & ~is_left & (d_right <= reach) & (F.lit(c.pairing_falls_through) | (d_left >= d_right))
    last = lambda cond: F.max(F.when(cond, F.struct("n_ord", "n_id")))["n_id"]  # noqa: E731  the last one in order stays
    rows = rows.groupBy("room", "id", "ord").agg(last(is_left).alias("l"), last(is_right).alias("r"))
    sides = F.col("l").isNotNull().cast("int") + F.col("r").isNotNull().cast("int")
    name = lambda x: F.coalesce(F.col(x), F.lit("None"))
    evidence = F.when(sides == 2, F.format_string("nightstands flank bed: left=%s, right=%s", "l", "r")).when(sides == 1, F.format_string("only one side has a nightstand (left=%s, right=%s)", name("l"), name("r"))).otherwise("no nightstands on either side of bed")
    return _check(rows, "pairing_balance", F.col("id"), F.when(sides == 2, "good").when(sides == 1, "weak").otherwise("violated"), sides / 2, F.array(evidence), F.col("ord"))


def door_alignment(t: Tables) -> DataFrame:
    c = t.config
    doors = t.doors.where("w_ax IS NOT NULL").withColumn("wall_yaw", F.atan2(F.col("w_by") - F.col("w_ay"), F.col("w_bx") - F.col("w_ax")))
    columns = ("id", "x", "y", "ord", "wall_yaw")
    rows = side(doors, "a_", columns).join(keyed(side(doors, "b_", columns)), "room").where("a_ord < b_ord")
    turn = g.yaw_difference(F.col("a_wall_yaw"), F.col("b_wall_yaw"))
    normal = (F.sin("a_wall_yaw"), -F.cos("a_wall_yaw"))
    angle = g.angle_between((F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")), normal)
    rows = rows.withColumn("turn", turn).withColumn("angle", F.least(angle, 180.0 - angle)).where((F.col("turn") <= c.door_alignment_deg) & (F.col("angle") <= c.door_alignment_deg))
    hard = t.furniture.where(~soft(F.col("label")) & (F.col("height") >= c.door_blocker_height))
    meets = g.Box.of("o_").meets_segment((F.col("a_x"), F.col("a_y")), (F.col("b_x"), F.col("b_y")))
    hits = rows.join(keyed(side(hard, "o_")), "room").where(meets).groupBy("room", "a_id", "b_id").agg(F.sort_array(F.collect_list(F.struct("o_ord", "o_id"))).alias("h"))
    rows = rows.join(keyed(hits.select("room", "a_id", "b_id", F.array_join(F.transform("h", lambda x: x["o_id"]), ", ").alias("hits"))), ["room", "a_id", "b_id"], "left")
    partly = F.col("hits").isNotNull()
    evidence = F.array(F.format_string("doors %s and %s are aligned (wall yaw diff %.1fdeg, normal err %.1fdeg)", "a_id", "b_id", "turn", "angle"), F.when(partly, F.concat(F.lit("qi flow partially blocked by "), F.col("hits"))).otherwise("nothing intercepts the cross-door corridor"))
    return _check(rows, "door_alignment", F.col("a_id"), F.when(partly, "weak").otherwise("violated"), F.when(partly, 0.5).otherwise(0.0), evidence, F.col("a_ord"), F.array("b_id"))


def light_window_proximity(t: Tables) -> DataFrame:
    c = t.config
    rows = t.zones.where("type IN ('seating_group', 'bed_group')").select("room", "zone_id", F.col("anchor_id").alias("id")).join(keyed(t.furniture.select("room", *BOX)), ["room", "id"])
    rows = rows.join(keyed(side(t.fixtures.where("kind = 'window'"), "w_", ("id", "x", "y", "ord"))), "room").withColumn("d", g.hypot(F.col("w_x") - F.col("x"), F.col("w_y") - F.col("y")))
    nearest = Window.partitionBy("room", "zone_id").orderBy("d", "w_ord")
    rows = rows.withColumn("n", F.row_number().over(nearest)).where("n = 1")
    d = F.col("d")
    evidence = F.format_string("nearest window %s is %.2fm away (threshold %.1fm)", "w_id", "d", F.lit(c.light_distance))
    good, weak = d <= c.light_distance, d <= c.light_distance * 1.5
    return _check(rows, "light_window_proximity", F.col("id"), F.when(good, "good").when(weak, "weak").otherwise("violated"), F.when(good, 1.0).when(weak, 0.5).otherwise(0.0), F.array(evidence), F.col("ord"))


Rule = Callable[[Tables], DataFrame]
RULES: list[Rule] = [command_position, solid_backing, bed_aligned_with_door, mirror_faces_bed, clear_center, sharp_corner, pairing_balance, door_alignment, light_window_proximity]


def evaluate(t: Tables, rules: list[Rule] | None = None) -> DataFrame:
    """All checks, with the rule's place in rule_order."""
    out = None
    for k, rule in enumerate(rules or RULES):
        rows = rule(t).withColumn("rule_order", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def check_edges(checks: DataFrame) -> DataFrame:
    rows = plain_edges(checks, F.col("target"), F.lit("room_0"), F.concat(F.lit("principle_"), F.col("principle")), score=F.col("score"))
    return rows


def summary(entities: DataFrame, doors: DataFrame, zones: DataFrame, edges: DataFrame, checks: DataFrame, focal: DataFrame) -> DataFrame:
    """Twelve counters of each room."""
    one = lambda c: F.count_if(c).cast("int")
    kind = F.col("kind")
    counts = entities.groupBy("room").agg(one(kind == "furniture").alias("n_objects"), one(kind == "wall").alias("n_walls"), one(kind == "door").alias("n_doors"), one(kind == "window").alias("n_windows"), F.count("*").cast("int").alias("n_entities"))
    parts = [
        (zones.groupBy("room").agg(F.count("*").cast("int").alias("n_zones")), "n_zones"),
        (edges.groupBy("room").agg(F.count("*").cast("int").alias("n_edges")), "n_edges"),
        (doors.groupBy("room").agg(one(F.col("is_entry")).alias("entry_count"), one(~F.col("is_entry")).alias("passage_count")), "entry_count"),
        (checks.groupBy("room").agg(one(F.col("status") == "violated").alias("principle_violations"), one(F.col("status") == "weak").alias("principle_warnings")), "principle_violations"),
    ]
    for part, _ in parts:
        counts = counts.join(keyed(part), "room", "left")
    counts = counts.na.fill(0).join(keyed(focal), "room", "left")
    return counts.withColumn("n_nodes", (F.col("n_entities") + F.col("n_zones") + 1).cast("int")).drop("n_entities")
