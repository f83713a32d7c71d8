"""The registered queries of scene and transcript operators, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import geometry as g
from ..functions import vocab
from ..operators import encoding as en
from ..operators import polygons as pg
from ..operators import relations as rel
from ..operators import rules as ru
from ..operators import scoring as sc
from ..operators import text as tx
from ..operators import zones as zo
from ..operators.paths import STEPS, corridors, nearest_cells, walks
from ..sources import layout as ly
from . import sql as q
from .derived import Scene, drawn_walls, kept, room_ids, table, transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
C = SceneConfig()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + 0.0).alias(name or column)


# --- relations

PAIR = f"""pair AS (
  SELECT s.room, s.ord AS s_ord, t.ord AS t_ord, s.id AS s_id, t.id AS t_id, {q.hyp('t.x - s.x', 't.y - s.y')} AS d,
    (t.x - s.x) * -sin(s.yaw) + (t.y - s.y) * cos(s.yaw) AS fwd, (t.x - s.x) * cos(s.yaw) + (t.y - s.y) * sin(s.yaw) AS rgt,
    {q.turn('s.yaw', 't.yaw')} AS turn, {q.angle('-sin(s.yaw)', 'cos(s.yaw)', 't.x - s.x', 't.y - s.y')} AS err
  FROM ent s JOIN ent t ON s.room = t.room AND s.ord <> t.ord)"""
DIRECTION = "CASE WHEN abs(fwd) >= abs(rgt) THEN CASE WHEN fwd >= 0 THEN 'front' ELSE 'back' END ELSE CASE WHEN rgt >= 0 THEN 'right' ELSE 'left' END END"


@query("b5_scene_bounds", f"WITH {q.ENT} SELECT room, " + ", ".join(q.r(f"{f}({c} {s} ({a} * abs(cos(yaw)) + {b} * abs(sin(yaw))) / 2) {s} 0.5", n) for f, c, s, a, b, n in (("min", "x", "-", "width", "depth", "min_x"), ("max", "x", "+", "width", "depth", "max_x"), ("min", "y", "-", "depth", "width", "min_y"), ("max", "y", "+", "depth", "width", "max_y"))) + " FROM ent GROUP BY room")
def scene_bounds(spark, sf_dir):
    return rel.bounds(Scene(spark, sf_dir).furniture).select("room", *(r(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@query("d3_object_pairs", f"WITH {q.ENT}, {PAIR} SELECT room, s_id, t_id, {q.r('d', 'distance_m')}, {q.r('turn', 'angle_diff_deg')}, {q.r('CASE WHEN d = 0 THEN 0.0 ELSE greatest(0.0, fwd / d) END', 'facing_score')}, {q.r('err', 'angle_error_deg')}, {DIRECTION} AS direction FROM pair")
def object_pairs(spark, sf_dir):
    rows = rel.pairs(Scene(spark, sf_dir).furniture)
    return rows.select("room", "s_id", "t_id", r("distance_m"), r("angle_diff_deg"), r("facing_score"), r("angle_error_deg"), "direction")


# the parts of each outline inside the other box, in the frame of t
OVERLAP = f"""edge AS (
  SELECT s.room, s.id AS s_id, t.id AS t_id, k, own,
    CASE WHEN own THEN t.width ELSE s.width END / 2 AS hw, CASE WHEN own THEN t.depth ELSE s.depth END / 2 AS hd,
    CASE WHEN own THEN s.x ELSE t.x END AS mx, CASE WHEN own THEN s.y ELSE t.y END AS my, CASE WHEN own THEN s.yaw ELSE t.yaw END AS myaw,
    CASE WHEN own THEN s.width ELSE t.width END / 2 AS mw, CASE WHEN own THEN s.depth ELSE t.depth END / 2 AS md,
    CASE WHEN own THEN t.x ELSE s.x END AS ox, CASE WHEN own THEN t.y ELSE s.y END AS oy, CASE WHEN own THEN t.yaw ELSE s.yaw END AS oyaw,
    t.x AS tx, t.y AS ty, t.yaw AS tyaw
  FROM ent s JOIN ent t ON s.room = t.room AND s.ord <> t.ord AND {q.hyp('s.x - t.x', 's.y - t.y')} < ({q.hyp('s.width', 's.depth')} + {q.hyp('t.width', 't.depth')}) / 2
  CROSS JOIN (VALUES (0), (1), (2), (3)) AS e(k) CROSS JOIN (VALUES (true), (false)) AS o(own)),
ends AS (SELECT *,
    mx + CASE WHEN k IN (1, 2) THEN mw ELSE -mw END * cos(myaw) - CASE WHEN k IN (2, 3) THEN md ELSE -md END * sin(myaw) AS wx0, my + CASE WHEN k IN (1, 2) THEN mw ELSE -mw END * sin(myaw) + CASE WHEN k IN (2, 3) THEN md ELSE -md END * cos(myaw) AS wy0,
    mx + CASE WHEN k IN (0, 1) THEN mw ELSE -mw END * cos(myaw) - CASE WHEN k IN (1, 2) THEN md ELSE -md END * sin(myaw) AS wx1, my + CASE WHEN k IN (0, 1) THEN mw ELSE -mw END * sin(myaw) + CASE WHEN k IN (1, 2) THEN md ELSE -md END * cos(myaw) AS wy1
  FROM edge),
loc AS (SELECT *, (wx0 - ox) * cos(oyaw) + (wy0 - oy) * sin(oyaw) AS px, (wy0 - oy) * cos(oyaw) - (wx0 - ox) * sin(oyaw) AS py, (wx1 - ox) * cos(oyaw) + (wy1 - oy) * sin(oyaw) AS qx, (wy1 - oy) * cos(oyaw) - (wx1 - ox) * sin(oyaw) AS qy FROM ends),
cut AS (SELECT *, qx - px AS dx, qy - py AS dy,
    greatest(0.0, CASE WHEN abs(qx - px) < 1e-12 THEN CASE WHEN abs(px) > hw + 1e-12 THEN 2.0 ELSE 0.0 END ELSE least((-hw - px) / (qx - px), (hw - px) / (qx - px)) END, CASE WHEN abs(qy - py) < 1e-12 THEN CASE WHEN abs(py) > hd + 1e-12 THEN 2.0 ELSE 0.0 END ELSE least((-hd - py) / (qy - py), (hd - py) / (qy - py)) END) AS f,
    least(1.0, CASE WHEN abs(qx - px) < 1e-12 THEN CASE WHEN abs(px) > hw + 1e-12 THEN -1.0 ELSE 1.0 END ELSE greatest((-hw - px) / (qx - px), (hw - px) / (qx - px)) END, CASE WHEN abs(qy - py) < 1e-12 THEN CASE WHEN abs(py) > hd + 1e-12 THEN -1.0 ELSE 1.0 END ELSE greatest((-hd - py) / (qy - py), (hd - py) / (qy - py)) END) AS l
  FROM loc),
part AS (SELECT room, s_id, t_id, wx0 + f * (wx1 - wx0) - tx AS ux, wy0 + f * (wy1 - wy0) - ty AS uy, wx0 + l * (wx1 - wx0) - tx AS vx, wy0 + l * (wy1 - wy0) - ty AS vy
  FROM cut WHERE f < l AND CASE WHEN abs(dx) < 1e-9 AND abs(abs(px) - hw) < 1e-9 THEN own AND dy * px > 0 WHEN abs(dy) < 1e-9 AND abs(abs(py) - hd) < 1e-9 THEN own AND dx * py < 0 ELSE true END),
overlap AS (SELECT room, s_id, t_id, sum(ux * vy - uy * vx) / 2 AS area FROM part GROUP BY room, s_id, t_id)"""


@query("c10_overlap_area", f"WITH {q.ENT}, {OVERLAP} SELECT room, s_id, t_id, {q.r('area', 'overlap_m2')} FROM overlap WHERE area > 0.001")
def overlap_area(spark, sf_dir):
    return rel.overlaps(Scene(spark, sf_dir).furniture).where(F.col("overlap_m2") > 0.001).select("room", "s_id", "t_id", r("overlap_m2"))


OBJECT_EDGES = f"""
SELECT room, s_id AS src, t_id AS dst, 'near' AS type, {q.r('d', 'value')} FROM pair WHERE d <= 1.0
UNION ALL SELECT room, s_id, t_id, 'faces', {q.r('err', 'value')} FROM pair WHERE d > 0 AND fwd > 0 AND err <= 25 AND d <= 4.5
UNION ALL SELECT room, s_id, t_id, 'parallel_to', {q.r('turn', 'value')} FROM pair WHERE turn <= 15 AND d <= 3
UNION ALL SELECT room, s_id, t_id, CASE {DIRECTION} WHEN 'front' THEN 'in_front_of' WHEN 'back' THEN 'behind' WHEN 'left' THEN 'left_of' ELSE 'right_of' END, {q.r('d', 'value')} FROM pair WHERE d <= 3"""


def _object_edges(spark, sf_dir):
    return rel.object_edges(rel.pairs(Scene(spark, sf_dir).furniture))


@query("f1_object_edges", f"WITH {q.ENT}, {PAIR} {OBJECT_EDGES}")
def object_edges(spark, sf_dir):
    value = F.coalesce("angle_error_deg", "angle_diff_deg", "distance_m")
    return _object_edges(spark, sf_dir).select("room", "src", "dst", "type", r(value, "value"))


@query("f2_overlap_edges", f"WITH {q.ENT}, {OVERLAP} SELECT s_id AS src, t_id AS dst, 'overlaps' AS type, count(*) AS n, {q.r('sum(area)', 'area')} FROM overlap WHERE area > 0.001 GROUP BY s_id, t_id")
def overlap_edges(spark, sf_dir):
    rows = rel.overlap_edges(rel.overlaps(Scene(spark, sf_dir).furniture))
    return rows.groupBy("src", "dst", "type").agg(F.count("*").alias("n"), F.sum("overlap_m2").alias("area")).select("src", "dst", "type", "n", r("area"))


@query("f3_edge_counts", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT room, type, count(*) AS n FROM e GROUP BY room, type")
def edge_counts(spark, sf_dir):
    """The flagship: pairs of every room, typed edges in one pass, counts by room and type."""
    return _object_edges(spark, sf_dir).groupBy("room", "type").agg(F.count("*").alias("n"))


_B0, _B1 = q.corner("e", 0), q.corner("e", 1)
_AT = [(f"({_B0[0]} + ({_B1[0]} - {_B0[0]}) * {k} / 8.0)", f"({_B0[1]} + ({_B1[1]} - {_B0[1]}) * {k} / 8.0)") for k in range(9)]
WALL_PAIR = f"""wp AS (
  SELECT e.room, e.id, w.id AS w_id, {q.seg_box('e', 'w.ax', 'w.ay', 'w.bx', 'w.by_')} AS clear, {q.turn('e.yaw', 'atan2(w.by_ - w.ay, w.bx - w.ax)')} AS turn,
    {q.seg_seg(_B0, _B1, ('w.ax', 'w.ay'), ('w.bx', 'w.by_'))} AS back, ({' + '.join(f"CASE WHEN {q.point_seg(*p, 'w.ax', 'w.ay', 'w.bx', 'w.by_')} <= 0.20 THEN 1 ELSE 0 END" for p in _AT)}) / 9.0 AS cover
  FROM ent e JOIN wall w ON e.room = w.room WHERE e.label NOT IN {q.names(vocab.SOFT)} OR e.label IN {q.names(vocab.SOFT_ON_WALLS)})"""
WALL_EDGE = f"""we AS (
  SELECT room, id AS src, w_id AS dst, 'touching_wall' AS type, clear AS clearance, NULL::DOUBLE AS cover FROM wp WHERE clear <= 0.05
  UNION ALL SELECT room, id, w_id, 'against_wall', clear, NULL FROM wp WHERE clear > 0.05 AND clear <= 0.30
  UNION ALL SELECT room, id, w_id, 'parallel_to_wall', clear, NULL FROM wp WHERE turn <= 15 AND clear <= 0.60
  UNION ALL SELECT room, id, w_id, 'has_backing', back, cover FROM wp WHERE back <= 0.30 AND cover >= 0.80)"""


def _wall_edges(s: Scene) -> DataFrame:
    return rel.wall_edges(rel.wall_pairs(s.furniture, s.walls))


@query("d5_wall_edges", f"WITH {q.SCENE}, {WALL_PAIR}, {WALL_EDGE} SELECT room, src, dst, type, {q.r('clearance', 'clearance_m')}, {q.r('cover', 'coverage')} FROM we")
def wall_edges(spark, sf_dir):
    return _wall_edges(Scene(spark, sf_dir)).select("room", "src", "dst", "type", r("clearance_m"), r("coverage"))


@query("f4_inside_edges", f"WITH {q.SCENE}, o AS (SELECT room, id, x, y FROM ent UNION ALL SELECT room, id, x, y FROM fix) SELECT room, id AS src, 'room_0' AS dst, CASE WHEN x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 4 THEN 'inside_room' ELSE 'outside_room' END AS type FROM o")
def inside_edges(spark, sf_dir):
    s = Scene(spark, sf_dir)
    columns = ("room", "id", "kind", "x", "y")
    return rel.inside_edges(s.furniture.select(*columns).unionByName(s.fixtures.select(*columns)), s.rooms).select("room", "src", "dst", "type")


@query("d2_fixture_edges", f"WITH {q.SCENE} SELECT f.room, f.id AS src, w.id AS dst, f.kind || '_in_wall' AS type FROM fix f JOIN wall w ON f.room = w.room AND f.wall_id = w.id")
def fixture_edges(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return rel.fixture_edges(s.fixtures, s.walls).select("room", "src", "dst", "type")


# --- zones

SEAT = f"""seat AS (SELECT * FROM ent WHERE label IN {q.names(vocab.SEATS)}),
reach AS (SELECT room, ord, ord AS other FROM seat UNION SELECT r.room, r.ord, b.ord FROM reach r JOIN seat a ON a.room = r.room AND a.ord = r.other JOIN seat b ON b.room = r.room AND {q.hyp('a.x - b.x', 'a.y - b.y')} <= 1.5),
low AS (SELECT room, ord, min(other) AS low FROM reach GROUP BY room, ord),
num AS (SELECT s.*, dense_rank() OVER (PARTITION BY s.room ORDER BY low) - 1 AS zone FROM seat s JOIN low USING (room, ord)),
prim AS (SELECT *, row_number() OVER (PARTITION BY room, zone ORDER BY CASE WHEN label IN {q.names(vocab.PRIMARY_SEATS)} THEN 0 ELSE 1 END, width * depth DESC, ord) AS rn FROM num),
sz AS (SELECT room, zone, 'seating_group_' || zone AS zone_id, max(CASE WHEN rn = 1 THEN id END) AS anchor_id, max(CASE WHEN rn = 1 THEN ord END) AS anchor_ord, string_agg(id, ',' ORDER BY ord) AS members, avg(x) AS x, avg(y) AS y, count(*) AS size FROM prim GROUP BY room, zone)"""
_W = "WITH RECURSIVE "


def _members_text(df: DataFrame) -> DataFrame:
    return df.withColumn("members", F.array_join("members", ","))


@query("g4_seating_zones", f"{_W}{q.ENT}, {SEAT} SELECT room, zone_id, anchor_id, members, {q.r('x', 'x')}, {q.r('y', 'y')}, size FROM sz")
def seating_zones(spark, sf_dir):
    """Half a digit of a centre goes up as it does in floating point."""
    zones = _members_text(zo.seating_zones(zo.seats(Scene(spark, sf_dir).furniture)))
    x, y = ((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in "xy")
    return zones.select("room", "zone_id", "anchor_id", "members", x, y, F.col("size").cast("long").alias("size"))


@query("g1_components", f"{_W}{q.ENT}, {SEAT} SELECT room, ord, zone FROM num")
def seat_components(spark, sf_dir):
    rows = Scene(spark, sf_dir).furniture.where(rel.is_in(F.col("label"), vocab.SEATS))
    return zo.components(rows, C.seating_radius).select("room", F.col("ord").cast("long").alias("ord"), F.col("zone").cast("long").alias("zone"))


BED = f"""bed AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY ord) - 1 AS zone FROM ent WHERE label = 'bed'),
bs AS (SELECT b.room, b.ord AS a_ord, n.* EXCLUDE (room) FROM bed b JOIN ent n ON b.room = n.room AND n.label = 'nightstand' WHERE {q.box_box('b', 'n')} <= 0.6),
bl AS (SELECT b.room, b.ord AS a_ord, l.ord, l.id FROM bed b JOIN ent l ON b.room = l.room AND l.label IN {q.names(vocab.LAMPS)} WHERE {q.box_box('b', 'l')} <= 0.6
  UNION SELECT n.room, n.a_ord, l.ord, l.id FROM bs n JOIN ent l ON n.room = l.room AND l.label IN {q.names(vocab.LAMPS)} WHERE {q.box_box('n', 'l')} <= 0.4),
bz AS (SELECT b.room, b.zone, 'bed_group_' || b.zone AS zone_id, b.id AS anchor_id, b.ord AS anchor_ord, b.x, b.y,
  concat_ws(',', b.id, (SELECT string_agg(id, ',' ORDER BY ord) FROM bs WHERE bs.room = b.room AND bs.a_ord = b.ord), (SELECT string_agg(id, ',' ORDER BY ord) FROM bl WHERE bl.room = b.room AND bl.a_ord = b.ord)) AS members FROM bed b)"""


@query("d7_bed_zones", f"WITH {q.ENT}, {BED} SELECT room, zone_id, anchor_id, members FROM bz")
def bed_zones(spark, sf_dir):
    return _members_text(zo.bed_zones(Scene(spark, sf_dir).furniture)).select("room", "zone_id", "anchor_id", "members")


def _desk_part(name: str, labels) -> str:
    return f"{name} AS (SELECT d.room, d.ord AS a_ord, o.ord, o.id FROM desk d JOIN ent o ON d.room = o.room AND o.label IN {q.names(labels)} WHERE {q.box_box('d', 'o')} <= 0.8)"


_of_desk = lambda n: f"(SELECT string_agg(id, ',' ORDER BY ord) FROM {n} WHERE {n}.room = d.room AND {n}.a_ord = d.ord)"
DESK = f"""desk AS (SELECT * FROM ent WHERE label IN {q.names(vocab.DESKS)}), {_desk_part('dc', vocab.SEATS)}, {_desk_part('dp', vocab.COMPUTERS)}, {_desk_part('dl', vocab.LAMPS)},
dz AS (SELECT d.room, d.ord, d.id AS anchor_id, d.x, d.y, row_number() OVER (PARTITION BY d.room ORDER BY d.ord) - 1 AS zone, concat_ws(',', d.id, {_of_desk('dc')}, {_of_desk('dp')}, {_of_desk('dl')}) AS members
  FROM desk d WHERE EXISTS (SELECT 1 FROM dc WHERE dc.room = d.room AND dc.a_ord = d.ord) OR EXISTS (SELECT 1 FROM dp WHERE dp.room = d.room AND dp.a_ord = d.ord))"""


@query("d8_desk_zones", f"WITH {q.ENT}, {DESK} SELECT room, 'desk_group_' || zone AS zone_id, anchor_id, members FROM dz")
def desk_zones(spark, sf_dir):
    return _members_text(zo.desk_zones(Scene(spark, sf_dir).furniture)).select("room", "zone_id", "anchor_id", "members")


@query("f5_participates_in", f"{_W}{q.ENT}, {SEAT}, {BED}, {DESK}, z AS (SELECT room, zone_id, members FROM sz UNION ALL SELECT room, zone_id, members FROM bz UNION ALL SELECT room, 'desk_group_' || zone, members FROM dz) SELECT room, unnest(string_split(members, ',')) AS src, zone_id AS dst FROM z")
def participates_in(spark, sf_dir):
    return zo.member_edges(zo.all_zones(Scene(spark, sf_dir).furniture)).select("room", "src", "dst")


@query("d9_table_edges", f"{_W}{q.ENT}, {SEAT}, t AS (SELECT e.room, e.id, z.zone_id, z.anchor_id, {q.hyp('e.x - z.x', 'e.y - z.y')} AS d FROM ent e JOIN sz z ON e.room = z.room WHERE e.label IN {q.names(vocab.TABLES)}) SELECT room, id AS src, zone_id AS dst, 'serves' AS type, {q.r('d', 'distance_m')} FROM t WHERE d <= 2.1 UNION ALL SELECT room, id, anchor_id, 'table_for', {q.r('d', 'distance_m')} FROM t WHERE d <= 2.1")
def table_edges(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return zo.table_edges(s.furniture, zo.seating_zones(zo.seats(s.furniture))).select("room", "src", "dst", "type", r("distance_m"))


@query("g5_focal_points", f"{_W}{q.SCENE}, {SEAT}, c AS (SELECT room, id, CASE label WHEN 'tv' THEN 0 ELSE 1 END AS k, width * depth AS a, ord FROM ent WHERE label IN ('tv', 'fireplace') UNION ALL SELECT room, id, 2, width * height, ord FROM fix WHERE kind = 'window' UNION ALL SELECT room, anchor_id, 3, 0.0, 0 FROM sz WHERE zone = 0) SELECT room, id AS focal_id FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY k, a DESC, ord) AS n FROM c) WHERE n = 1")
def focal_points(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return zo.focal_points(s.furniture, s.fixtures, zo.seating_zones(zo.seats(s.furniture)).select(*zo.ZONE))


# --- rules

DOOR = f"""door AS (SELECT f.*, w.ax AS wax, w.ay AS way, w.bx AS wbx, w.by_ AS wby, (w.by_ - w.ay) / {q.hyp('w.bx - w.ax', 'w.by_ - w.ay')} AS nx, -(w.bx - w.ax) / {q.hyp('w.bx - w.ax', 'w.by_ - w.ay')} AS ny FROM fix f JOIN wall w ON f.room = w.room AND f.wall_id = w.id WHERE f.kind = 'door'),
entry AS (SELECT *, NOT (x + 0.2 * nx BETWEEN 0 AND 6 AND y + 0.2 * ny BETWEEN 0 AND 4 AND x - 0.2 * nx BETWEEN 0 AND 6 AND y - 0.2 * ny BETWEEN 0 AND 4) AS is_entry FROM door)"""


@query("c6_door_classes", f"WITH {q.SCENE}, {DOOR} SELECT room, id, is_entry FROM entry")
def door_classes(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return ru.classify_doors(s.fixtures, s.walls, s.rooms).select("room", "id", "is_entry")


def tables(s: Scene) -> ru.Tables:
    return ru.Tables(s.furniture, s.fixtures, s.walls, s.rooms, zo.all_zones(s.furniture), _wall_edges(s).where("type = 'has_backing'"), ru.classify_doors(s.fixtures, s.walls, s.rooms))


def rule_tables(spark, sf_dir) -> ru.Tables:
    """The tables that rules read, each written once."""
    t = tables(Scene(spark, sf_dir, keep=True))
    t.zones = kept(t.zones)
    t.backings = kept(t.backings.select("room", "src", "dst"))
    t.doors = kept(t.doors)
    return t


@query("f6_entry_path", f"{_W}{q.SCENE}, {SEAT}, {BED}, {DOOR} SELECT d.room, d.id AS src, z.anchor_id AS dst FROM entry d JOIN (SELECT room, anchor_id FROM sz UNION ALL SELECT room, anchor_id FROM bz) z ON d.room = z.room WHERE is_entry")
def entry_path(spark, sf_dir):
    t = tables(Scene(spark, sf_dir))
    return zo.entry_edges(t.zones, t.doors.where("is_entry")).select("room", "src", "dst")


_HIDE = f"""hide AS (SELECT room, id, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, NULL::DOUBLE AS bx, NULL::DOUBLE AS by_, x, y, width, depth, yaw FROM ent WHERE height >= 1.40 AND label NOT IN {q.names(vocab.SOFT)} UNION ALL SELECT room, id, ax, ay, bx, by_, NULL, NULL, NULL, NULL, NULL FROM wall)"""


def _seen(lines: str, keys: str) -> str:
    """visible by keys for a CTE of segments sax, say, sbx, sby.  The walls here only meet segments in single points."""
    first, last = q.clip("h", "s.sax", "s.say", "s.sbx", "s.sby")
    cross = "((s.sbx - s.sax) * (h.by_ - h.ay) - (s.sby - s.say) * (h.bx - h.ax))"
    t = f"(((h.ax - s.sax) * (h.by_ - h.ay) - (h.ay - s.say) * (h.bx - h.ax)) / {cross})"
    u = f"(((h.ax - s.sax) * (s.sby - s.say) - (h.ay - s.say) * (s.sbx - s.sax)) / {cross})"
    on_wall = f"(abs({cross}) >= 1e-12 AND {u} BETWEEN -1e-12 AND 1 + 1e-12 AND {t} BETWEEN -1e-12 AND 1 + 1e-12)"
    return f"""hit AS (SELECT {keys}, {q.hyp('s.sbx - s.sax', 's.sby - s.say')} AS len, CASE WHEN h.x IS NOT NULL THEN CASE WHEN {first} <= {last} + 1e-12 THEN {first} END WHEN {on_wall} THEN {t} END AS f, CASE WHEN h.x IS NOT NULL THEN CASE WHEN {first} <= {last} + 1e-12 THEN {last} END WHEN {on_wall} THEN {t} END AS l FROM {lines} s LEFT JOIN hide h ON s.room = h.room),
seen AS (SELECT {keys.replace('s.', '')}, max(len) = 0 OR min(f) IS NULL OR ((max(l) - min(f)) * max(len) < 1e-9 AND least(abs(min(f)), abs(1 - min(f))) * max(len) <= 1e-3) AS visible FROM hit GROUP BY {keys.replace('s.', '')})"""


@query("c5_line_of_sight", f"WITH {q.SCENE}, {_HIDE}, seg AS (SELECT f.room, f.id AS door, e.id, f.x AS sax, f.y AS say, e.x AS sbx, e.y AS sby FROM fix f JOIN ent e ON f.room = e.room WHERE f.kind = 'door'), {_seen('seg', 's.room, s.door, s.id')} SELECT room, door, id, visible FROM seen")
def sight(spark, sf_dir):
    """Which pieces every door sees."""
    s = Scene(spark, sf_dir)
    lines = s.fixtures.where("kind = 'door'").select("room", F.col("id").alias("door"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(s.furniture.select("room", "id", F.col("x").alias("bx"), F.col("y").alias("by")), "room")
    return rel.line_of_sight(lines, rel.occluders(s.walls, s.furniture), ["room", "door", "id"])


_PRIMARY = q.names(vocab.PRIMARY_SEATS)
ANCHORS = f"sa AS (SELECT p.* EXCLUDE (zone, rn) FROM prim p WHERE rn = 1 AND label IN {_PRIMARY}), ba AS (SELECT * EXCLUDE (zone) FROM bed), da AS (SELECT e.* FROM ent e JOIN dz ON e.room = dz.room AND e.id = dz.anchor_id)"
_AXIS = ("d.dx + 30 * d.nx", "d.dy + 30 * d.ny", "d.dx - 30 * d.nx", "d.dy - 30 * d.ny")
RULE_SQL = {
    "command_position": f"""{_HIDE}, cand AS (SELECT * FROM sa UNION SELECT * FROM ba UNION SELECT * FROM da),
      near AS (SELECT * FROM (SELECT c.*, d.id AS door, d.x AS dx, d.y AS dy, d.nx, d.ny, {q.hyp('c.x - d.x', 'c.y - d.y')} AS dist, row_number() OVER (PARTITION BY c.room, c.id ORDER BY {q.hyp('c.x - d.x', 'c.y - d.y')}, d.ord) AS n FROM cand c JOIN entry d ON c.room = d.room AND d.is_entry) WHERE n = 1),
      seg AS (SELECT room, id, x AS sax, y AS say, dx AS sbx, dy AS sby FROM near), {_seen('seg', 's.room, s.id')},
      f AS (SELECT d.room, d.id, NOT visible AS hidden, dist < 1.0 AS close, {q.meets('d', *_AXIS)} AS aligned, NOT EXISTS (SELECT 1 FROM we WHERE we.room = d.room AND we.src = d.id AND we.type = 'has_backing') AS bare FROM near d JOIN seen USING (room, id))
      SELECT room, id AS target, CASE WHEN hidden OR aligned THEN 'violated' WHEN close OR bare THEN 'weak' ELSE 'good' END AS status, greatest(0.0, 1.0 - CASE WHEN hidden THEN 0.4 ELSE 0 END - CASE WHEN close THEN 0.2 ELSE 0 END - CASE WHEN aligned THEN 0.3 ELSE 0 END - CASE WHEN bare THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM f""",
    "solid_backing": f"""cand AS (SELECT * FROM sa UNION SELECT * FROM ba), f AS (SELECT a.room, a.id, EXISTS (SELECT 1 FROM we WHERE we.room = a.room AND we.src = a.id AND we.type = 'has_backing') AS backed, coalesce((SELECT bool_or({q.seg_box('x', *q.corner('a', 0), *q.corner('a', 1))} <= 0.05) FROM fix x WHERE x.room = a.room), false) AS cut FROM cand a)
      SELECT room, id AS target, CASE WHEN NOT backed THEN 'violated' WHEN cut THEN 'weak' ELSE 'good' END AS status, CASE WHEN NOT backed THEN 0.0 WHEN cut THEN 0.4 ELSE 1.0 END::DOUBLE AS score FROM f""",
    "bed_aligned_with_door": f"""f AS (SELECT b.room, b.id, bool_or({q.meets('b', 'd.x + 30 * d.nx', 'd.y + 30 * d.ny', 'd.x - 30 * d.nx', 'd.y - 30 * d.ny')}) AS bad FROM ba b JOIN entry d ON b.room = d.room GROUP BY b.room, b.id)
      SELECT room, id AS target, CASE WHEN bad THEN 'violated' ELSE 'good' END AS status, CASE WHEN bad THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM f""",
    "mirror_faces_bed": f"""f AS (SELECT DISTINCT m.room, m.id FROM ent m JOIN ba b ON m.room = b.room AND m.label = 'mirror' WHERE {q.meets('b', 'm.x', 'm.y', 'm.x - 30 * sin(m.yaw)', 'm.y + 30 * cos(m.yaw)')})
      SELECT room, id AS target, 'violated' AS status, 0.0::DOUBLE AS score FROM f""",
    "sharp_corner_points_at_seat": f"""k AS (SELECT s.room, s.id, o.id AS other, c.k, CASE c.k {' '.join(f"WHEN {k} THEN {q.corner('o', k)[0]}" for k in range(4))} END - s.x AS vx, CASE c.k {' '.join(f"WHEN {k} THEN {q.corner('o', k)[1]}" for k in range(4))} END - s.y AS vy, s.yaw FROM prim s JOIN ent o ON s.room = o.room AND s.ord <> o.ord AND o.label NOT IN {q.names(vocab.SOFT)} CROSS JOIN (VALUES (0), (1), (2), (3)) AS c(k) WHERE s.rn = 1),
      f AS (SELECT room, id, count(DISTINCT other) AS n FROM k WHERE {q.hyp('vx', 'vy')} <= 1.0 AND {q.angle('-sin(yaw)', 'cos(yaw)', 'vx', 'vy')} <= 30 GROUP BY room, id)
      SELECT room, id AS target, 'weak' AS status, round(greatest(0.0, 1.0 - 0.2 * n)::DOUBLE, 6) AS score FROM f""",
    "pairing_balance": f"""n AS (SELECT b.room, b.id, n.ord, n.id AS stand, {q.hyp('n.x - (b.x - b.width / 2 * cos(b.yaw))', 'n.y - (b.y - b.width / 2 * sin(b.yaw))')} AS dl, {q.hyp('n.x - (b.x + b.width / 2 * cos(b.yaw))', 'n.y - (b.y + b.width / 2 * sin(b.yaw))')} AS dr FROM bed b JOIN bs n ON b.room = n.room AND n.a_ord = b.ord),
      p AS (SELECT room, id, bool_or(dl < dr AND dl <= 1.1) AS l, bool_or(NOT (dl < dr AND dl <= 1.1) AND dr <= 1.1) AS r FROM n GROUP BY room, id),
      f AS (SELECT b.room, b.id, CASE WHEN coalesce(l, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(r, false) THEN 1 ELSE 0 END AS sides FROM bed b LEFT JOIN p ON b.room = p.room AND b.id = p.id)
      SELECT room, id AS target, CASE sides WHEN 2 THEN 'good' WHEN 1 THEN 'weak' ELSE 'violated' END AS status, (sides / 2.0)::DOUBLE AS score FROM f""",
    "door_alignment": f"""p AS (SELECT a.room, a.id, a.x, a.y, b.id AS other, b.x AS bx, b.y AS by_, atan2(a.wby - a.way, a.wbx - a.wax) AS wa, atan2(b.wby - b.way, b.wbx - b.wax) AS wb FROM entry a JOIN entry b ON a.room = b.room AND a.ord < b.ord),
      m AS (SELECT *, {q.angle('bx - x', 'by_ - y', 'sin(wa)', '-cos(wa)')} AS ang FROM p),
      f AS (SELECT m.*, EXISTS (SELECT 1 FROM ent o WHERE o.room = m.room AND o.label NOT IN {q.names(vocab.SOFT)} AND o.height >= 0.5 AND {q.meets('o', 'm.x', 'm.y', 'm.bx', 'm.by_')}) AS partly FROM m WHERE {q.turn('wa', 'wb')} <= 20 AND least(ang, 180 - ang) <= 20)
      SELECT room, id AS target, CASE WHEN partly THEN 'weak' ELSE 'violated' END AS status, CASE WHEN partly THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM f""",
    "light_window_proximity": f"""a AS (SELECT room, zone_id, anchor_id FROM sz UNION ALL SELECT room, zone_id, anchor_id FROM bz), f AS (SELECT a.room, a.anchor_id, a.zone_id, min({q.hyp('e.x - w.x', 'e.y - w.y')}) AS d FROM a JOIN ent e ON a.room = e.room AND a.anchor_id = e.id JOIN fix w ON w.room = a.room AND w.kind = 'window' GROUP BY a.room, a.anchor_id, a.zone_id)
      SELECT room, anchor_id AS target, CASE WHEN d <= 3 THEN 'good' WHEN d <= 4.5 THEN 'weak' ELSE 'violated' END AS status, CASE WHEN d <= 3 THEN 1.0 WHEN d <= 4.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM f""",
}
RULE_SQL["clear_center"] = f"""disk AS (SELECT k, cos(k * pi() / 32) AS ax, sin(k * pi() / 32) AS ay, cos((k + 1) * pi() / 32) AS bx, sin((k + 1) * pi() / 32) AS by_ FROM range(64) AS i(k)),
      hard AS (SELECT room, ord, x - 3.0 AS x, y - 2.0 AS y, width, depth, yaw FROM ent WHERE label NOT IN {q.names(vocab.SOFT)} AND {q.hyp('x - 3.0', 'y - 2.0')} <= 1.0 + {q.hyp('width', 'depth')} / 2),
      arc AS (SELECT room, {q.clip('b', 'd.ax', 'd.ay', 'd.bx', 'd.by_')[0]} AS f, {q.clip('b', 'd.ax', 'd.ay', 'd.bx', 'd.by_')[1]} AS l, ax, ay, bx, by_ FROM hard b CROSS JOIN disk d),
      side AS (SELECT room, ord, {', '.join(f"[{', '.join(q.corner('b', (k + e) % 4)[c] for k in range(4))}][j + 1] AS {n}" for e, c, n in ((0, 0, 'px'), (0, 1, 'py'), (1, 0, 'qx'), (1, 1, 'qy')))}, j FROM hard b CROSS JOIN range(4) AS i(j)),
      half AS (SELECT s.*, (d.bx - d.ax) * (s.py - d.ay) - (d.by_ - d.ay) * (s.px - d.ax) AS off_, (d.bx - d.ax) * (s.qy - s.py) - (d.by_ - d.ay) * (s.qx - s.px) AS step FROM side s CROSS JOIN disk d),
      cutside AS (SELECT room, ord, j, any_value(px) AS px, any_value(py) AS py, any_value(qx) AS qx, any_value(qy) AS qy, greatest(0.0, max(CASE WHEN step > 0 THEN -off_ / step WHEN step = 0 AND off_ < 0 THEN 2.0 ELSE 0.0 END)) AS f, least(1.0, min(CASE WHEN step < 0 THEN -off_ / step ELSE 1.0 END)) AS l FROM half GROUP BY room, ord, j),
      bit AS (SELECT room, ((ax + f * (bx - ax)) * (ay + l * (by_ - ay)) - (ay + f * (by_ - ay)) * (ax + l * (bx - ax))) / 2 AS a FROM arc WHERE f < l
        UNION ALL SELECT room, ((px + f * (qx - px)) * (py + l * (qy - py)) - (py + f * (qy - py)) * (px + l * (qx - px))) / 2 FROM cutside WHERE f < l),
      f AS (SELECT room.room, coalesce(sum(a), 0.0) / (32 * sin(pi() / 32)) AS occ FROM room LEFT JOIN bit USING (room) GROUP BY room.room)
      SELECT room, 'room_0' AS target, CASE WHEN occ >= 0.25 THEN 'violated' WHEN occ > 0.125 THEN 'weak' ELSE 'good' END AS status, {q.r('greatest(0.0, 1.0 - occ)', 'score')} FROM f"""
RULE_BASE = f"{_W}{q.SCENE}, {SEAT}, {BED}, {DESK}, {DOOR}, {WALL_PAIR}, {WALL_EDGE}, {ANCHORS}"


def _rule(k: int, rule: ru.Rule) -> None:
    name = vocab.PRINCIPLES[k]

    def run(spark, sf_dir):
        return rule(rule_tables(spark, sf_dir)).select("room", "target", "status", r("score"))

    query(f"i{k + 1}_{name}", f"{RULE_BASE}, {RULE_SQL[name]}" if name in RULE_SQL else None)(run)


for _k, _rule_function in enumerate(ru.RULES):
    _rule(_k, _rule_function)


# all rules, over one set of tables
CHECKS = " UNION ALL ".join(f"SELECT '{name}' AS principle, * FROM (WITH {text})" for name, text in RULE_SQL.items())


def checks(spark, sf_dir) -> DataFrame:
    """All checks, for what is made of them."""
    t = rule_tables(spark, sf_dir)
    # each rule is planned by itself, so that the driver holds one plan at a time
    columns = ("room", "principle", "target", "status", "score", "target_ord")
    return ru.evaluate(t, [lambda t, rule=rule: kept(rule(t).select(*columns)) for rule in ru.RULES])


def _head_types(s: Scene) -> DataFrame:
    """Nodes that a check may be about: pieces, doors and the room."""
    parts = ((s.furniture, "object"), (s.fixtures.where("kind = 'door'"), "door"), (s.rooms.withColumn("id", F.lit("room_0")), "room"))
    out = None
    for rows, name in parts:
        part = rows.select("room", "id", F.lit(name).alias("node_type"))
        out = part if out is None else out.unionByName(part)
    return out


@query("h13_all_checks", f"{RULE_BASE} SELECT principle, room, target, status, round(score, 6) + 0.0 AS score FROM ({CHECKS})")
def all_checks(spark, sf_dir):
    return checks(spark, sf_dir).select("principle", "room", "target", "status", r("score"))


@query("g26_check_counts", f"{RULE_BASE} SELECT principle, status, count(*) AS n FROM ({CHECKS}) GROUP BY principle, status")
def check_counts(spark, sf_dir):
    return checks(spark, sf_dir).groupBy("principle", "status").agg(F.count("*").alias("n"))


@query("g10_graph_scores", f"{RULE_BASE} SELECT room, round(avg(score), 6) AS graph_score FROM ({CHECKS}) GROUP BY room")
def graph_scores(spark, sf_dir):
    """Of scores of six digits, as the checks give them; half a digit goes up as it does in floating point."""
    rows = checks(spark, sf_dir).withColumn("score", r("score"))
    score = F.floor(F.col("graph_score") * 1e6 + 0.5) / 1e6
    return en.graph_scores(en.teacher_rows(rows, _head_types(Scene(spark, sf_dir)))).select("room", score.alias("graph_score"))


@query("d14_teacher_cells", f"{RULE_BASE} SELECT room, target, principle, status FROM (SELECT *, row_number() OVER (PARTITION BY room, target, principle ORDER BY status) AS n, count(*) OVER (PARTITION BY room, target, principle) AS m FROM ({CHECKS})) WHERE m = 1")
def teacher_cells(spark, sf_dir):
    """Cells that one check fills."""
    rows = en.teacher_rows(checks(spark, sf_dir), _head_types(Scene(spark, sf_dir)))
    single = rows.groupBy("room", "target", "principle_ix").agg(F.count("*").alias("n")).where("n = 1")
    cells = en.teacher_cells(rows, ["rule_order", "target_ord", "status"]).join(g.keyed(single), ["room", "target", "principle_ix"])
    name = lambda values, ix: F.get(F.array(*(F.lit(v) for v in values)), F.col(ix))
    return cells.select("room", "target", name(vocab.PRINCIPLES, "principle_ix").alias("principle"), name(vocab.STATUSES, "status_ix").alias("status"))


# --- functions that SQL has no form for, whole tables


# corners of the corridor around a segment from p to q, 33 at each round end, in a frame that begins at p and runs along x
CORRIDOR = f"""bend AS (SELECT k, CASE WHEN k < 33 THEN 1 ELSE 0 END AS far, 0.3 * cos(CASE WHEN k < 33 THEN (k - 16) * pi() / 32 ELSE (k - 33 + 16) * pi() / 32 END) AS x, 0.3 * sin(CASE WHEN k < 33 THEN (k - 16) * pi() / 32 ELSE (k - 33 + 16) * pi() / 32 END) AS y FROM range(66) AS i(k)),
rim AS (SELECT a.k, a.far AS afar, a.x AS ax, a.y AS ay, b.far AS bfar, b.x AS bx, b.y AS by_ FROM bend a JOIN bend b ON b.k = (a.k + 1) % 66),
lane AS (SELECT s.room, s.ord AS s_ord, t.ord AS t_ord, o.ord AS o_ord, {q.hyp('t.x - s.x', 't.y - s.y')} AS len, o.width, o.depth,
    ((o.x - s.x) * (t.x - s.x) + (o.y - s.y) * (t.y - s.y)) / {q.hyp('t.x - s.x', 't.y - s.y')} AS x, ((o.y - s.y) * (t.x - s.x) - (o.x - s.x) * (t.y - s.y)) / {q.hyp('t.x - s.x', 't.y - s.y')} AS y, o.yaw - atan2(t.y - s.y, t.x - s.x) AS yaw
  FROM ent s JOIN ent t ON s.room = t.room AND s.ord <> t.ord AND (s.x <> t.x OR s.y <> t.y) JOIN ent o ON o.room = s.room AND o.ord <> s.ord AND o.ord <> t.ord AND o.label NOT IN {q.names(vocab.SOFT)}
  WHERE {q.seg_box('o', 's.x', 's.y', 't.x', 't.y')} < 0.30),
edge_ AS (SELECT b.*, r.ax + r.afar * len AS ax, r.ay, r.bx + r.bfar * len AS bx, r.by_ FROM lane b CROSS JOIN rim r),
arc AS (SELECT room, s_ord, t_ord, o_ord, {q.clip('b', 'b.ax', 'b.ay', 'b.bx', 'b.by_')[0]} AS f, {q.clip('b', 'b.ax', 'b.ay', 'b.bx', 'b.by_')[1]} AS l, ax, ay, bx, by_ FROM edge_ b),
side AS (SELECT b.*, {', '.join(f"[{', '.join(q.corner('b', (k + e) % 4)[c] for k in range(4))}][j + 1] AS {n}" for e, c, n in ((0, 0, 'px'), (0, 1, 'py'), (1, 0, 'qx'), (1, 1, 'qy')))}, j FROM lane b CROSS JOIN range(4) AS i(j)),
half AS (SELECT s.*, (r.bx + r.bfar * len - r.ax - r.afar * len) * (s.py - r.ay) - (r.by_ - r.ay) * (s.px - r.ax - r.afar * len) AS off_, (r.bx + r.bfar * len - r.ax - r.afar * len) * (s.qy - s.py) - (r.by_ - r.ay) * (s.qx - s.px) AS step FROM side s CROSS JOIN rim r),
cutside AS (SELECT room, s_ord, t_ord, o_ord, j, any_value(px) AS px, any_value(py) AS py, any_value(qx) AS qx, any_value(qy) AS qy, greatest(0.0, max(CASE WHEN step > 0 THEN -off_ / step WHEN step = 0 AND off_ < 0 THEN 2.0 ELSE 0.0 END)) AS f, least(1.0, min(CASE WHEN step < 0 THEN -off_ / step ELSE 1.0 END)) AS l FROM half GROUP BY room, s_ord, t_ord, o_ord, j),
bit AS (SELECT room, s_ord, t_ord, o_ord, ((ax + f * (bx - ax)) * (ay + l * (by_ - ay)) - (ay + f * (by_ - ay)) * (ax + l * (bx - ax))) / 2 AS a FROM arc WHERE f < l
  UNION ALL SELECT room, s_ord, t_ord, o_ord, ((px + f * (qx - px)) * (py + l * (qy - py)) - (py + f * (qy - py)) * (px + l * (qx - px))) / 2 FROM cutside WHERE f < l),
cover AS (SELECT room, s_ord, t_ord, o_ord, sum(a) AS a FROM bit GROUP BY room, s_ord, t_ord, o_ord),
blocked AS (SELECT l.room, l.s_ord, l.t_ord, max(coalesce(c.a, 0.0)) AS score FROM lane l LEFT JOIN cover c USING (room, s_ord, t_ord, o_ord) GROUP BY l.room, l.s_ord, l.t_ord)"""


@query("d6_path_blocking", f"WITH {q.ENT}, {CORRIDOR} SELECT room, s_ord, t_ord, round(greatest(score, 0.0), 5) + 0.0 AS path_blocking_score FROM blocked")
def path_blocking(spark, sf_dir):
    s = Scene(spark, sf_dir)
    score = (F.round("path_blocking_score", 5) + 0.0).alias("path_blocking_score")
    return pg.path_blocking(s.furniture).select("room", F.col("s_ord").cast("long").alias("s_ord"), F.col("t_ord").cast("long").alias("t_ord"), score)


#: Walks on a grid of 12 x 8 cells, which SQL can search; the grid of production is 120 x 80.
COARSE = SceneConfig(grid_cell=0.5)
_u, _v = q.local("b", "cell.x", "cell.y")
GRID = f"""blk AS (SELECT * FROM ent WHERE label NOT IN {q.names(vocab.SOFT)} AND height >= 0.2),
cell AS (SELECT room, r, c, (c + 0.5) * 0.5 AS x, (r + 0.5) * 0.5 AS y FROM room CROSS JOIN range(8) AS i(r) CROSS JOIN range(12) AS j(c)),
shut AS (SELECT DISTINCT cell.room, r, c FROM cell JOIN blk b ON cell.room = b.room WHERE abs({_u}) <= b.width / 2 + 1e-12 AND abs({_v}) <= b.depth / 2 + 1e-12),
free AS MATERIALIZED (SELECT * FROM cell ANTI JOIN shut USING (room, r, c)),
hw AS MATERIALIZED (SELECT f.room, f.r, f.c, f.x, f.y, least(3, f.r + 1, f.c + 1, 8 - f.r, 12 - f.c, coalesce(min(greatest(abs(f.r - s.r), abs(f.c - s.c))), 3)) AS w FROM free f LEFT JOIN shut s ON f.room = s.room GROUP BY f.room, f.r, f.c, f.x, f.y)"""
TARGETS = f"""goal AS (SELECT z.room, z.zone_id AS id, e.x, e.y, false AS is_door FROM (SELECT room, zone_id, anchor_id FROM sz UNION ALL SELECT room, zone_id, anchor_id FROM bz UNION ALL SELECT room, 'desk_group_' || zone, anchor_id FROM dz) z JOIN ent e ON z.room = e.room AND z.anchor_id = e.id),
spot AS (SELECT room, id, x, y, true AS is_door FROM entry WHERE is_entry UNION ALL SELECT * FROM goal),
used AS (SELECT * FROM spot WHERE room IN (SELECT room FROM goal)),
near AS MATERIALIZED (SELECT room, id, is_door, r, c FROM (SELECT u.room, u.id, u.is_door, f.r, f.c, row_number() OVER (PARTITION BY u.room, u.id ORDER BY (f.r - least(7, trunc(u.y / 0.5))) ** 2 + (f.c - least(11, trunc(u.x / 0.5))) ** 2, f.r, f.c) AS n FROM used u JOIN free f ON u.room = f.room) WHERE n = 1)"""
STEP = "step AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {dr}, {dc}, {int(not (dr and dc))}, {int(bool(dr and dc))})" for k, (dr, dc, _) in enumerate(STEPS)) + ") AS s(k, dr, dc, da, db))"
# a straight and b diagonal steps from the door, each cell once; cells whose way got shorter are looked at again
WAYS = f"""{STEP},
way(room, door, r, c, a, b) USING KEY (room, door, r, c) AS (
  SELECT room, id, r, c, 0, 0 FROM near WHERE is_door
  UNION
  SELECT room, door, r, c, n.a, n.b FROM (
    SELECT w.room, w.door, f.r, f.c, min(struct_pack(d := w.a + s.da + (w.b + s.db) * sqrt(2), a := w.a + s.da, b := w.b + s.db)) AS n
    FROM way w CROSS JOIN step s JOIN free f ON f.room = w.room AND f.r = w.r + s.dr AND f.c = w.c + s.dc GROUP BY ALL) t
  LEFT JOIN recurring.way o USING (room, door, r, c) WHERE o.a IS NULL OR t.n.d < o.a + o.b * sqrt(2)),
reached AS MATERIALIZED (SELECT w.*, z.id AS zone_id FROM way w JOIN near z ON w.room = z.room AND w.r = z.r AND w.c = z.c AND NOT z.is_door)"""
TRACKS = f"""back AS MATERIALIZED (SELECT w.room, w.door, w.r, w.c, arg_min(struct_pack(r := p.r, c := p.c), s.k) AS p FROM way w CROSS JOIN step s JOIN way p ON p.room = w.room AND p.door = w.door AND p.r = w.r + s.dr AND p.c = w.c + s.dc AND p.a + s.da = w.a AND p.b + s.db = w.b GROUP BY w.room, w.door, w.r, w.c),
track AS (SELECT room, door, zone_id, r, c, a + b AS n FROM reached UNION ALL SELECT t.room, t.door, t.zone_id, b.p.r, b.p.c, t.n - 1 FROM track t JOIN back b ON b.room = t.room AND b.door = t.door AND b.r = t.r AND b.c = t.c),
tight AS (SELECT t.*, h.x, h.y FROM track t JOIN hw h ON t.room = h.room AND t.r = h.r AND t.c = h.c WHERE h.w * 0.5 < 0.60),
block AS (SELECT t.room, t.door, t.zone_id, b.id, arg_min({q.point_box('b', 't.x', 't.y')}, t.n) AS d FROM tight t JOIN blk b ON t.room = b.room WHERE {q.point_box('b', 't.x', 't.y')} <= 0.8 GROUP BY t.room, t.door, t.zone_id, b.id)"""
_WALK_BASE = f"{_W}{q.SCENE}, {SEAT}, {BED}, {DESK}, {DOOR}, {GRID}, {TARGETS}"
_TRAFFIC = f"SELECT room, door AS src, zone_id AS dst, 'traffic_path' AS type, {q.r('(a + b * sqrt(2)) * 0.5', 'length_m')}, a + b + 1 AS cells, NULL::VARCHAR AS from_door, NULL::DOUBLE AS distance_m FROM reached"
_BLOCKED = f"SELECT room, id AS src, zone_id AS dst, 'blocks_path' AS type, NULL::DOUBLE AS length_m, NULL AS cells, door AS from_door, {q.r('d', 'distance_m')} FROM block"


def _walks(spark, sf_dir, config: SceneConfig) -> DataFrame:
    s = Scene(spark, sf_dir, keep=True)
    t = tables(s)
    return walks(s.rooms, s.furniture, t.doors.where("is_entry"), t.zones, config).select("room", "src", "dst", "type", r("length_m"), "cells", "from_door", r("distance_m"))


@query("c9_walkable_cells", f"WITH {q.SCENE}, {GRID} SELECT room, count(*) AS cells, sum(r)::BIGINT AS rows_, sum(c)::BIGINT AS cols, sum(r * c)::BIGINT AS both_ FROM free GROUP BY room")
def walkable_cells(spark, sf_dir):
    s = Scene(spark, sf_dir)
    cells = corridors(s.rooms, s.furniture, COARSE)
    return cells.groupBy("room").agg(F.count("*").alias("cells"), F.sum("row").alias("rows_"), F.sum("col").alias("cols"), F.sum(F.col("row") * F.col("col")).alias("both_"))


@query("k1_nearest_cells", f"{_WALK_BASE} SELECT room, id, r AS row, c AS col FROM near")
def nearest_walkable(spark, sf_dir):
    """The walkable cells nearest to entry doors and zones."""
    s = Scene(spark, sf_dir)
    t = tables(s)
    return nearest_cells(s.rooms, s.furniture, t.doors.where("is_entry"), t.zones, COARSE).select("room", "id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("k2_shortest_paths", f"{_WALK_BASE}, {WAYS} SELECT room, src, dst, length_m, cells FROM ({_TRAFFIC})")
def shortest_paths(spark, sf_dir):
    return _walks(spark, sf_dir, COARSE).where("type = 'traffic_path'").select("room", "src", "dst", "length_m", "cells")


@query("k3_half_widths", f"WITH {q.SCENE}, {GRID} SELECT room, r AS row, w * 0.5::DOUBLE AS half_width_m, count(*) AS cells, sum(c)::BIGINT AS cols FROM hw GROUP BY room, r, w")
def corridor_half_widths(spark, sf_dir):
    s = Scene(spark, sf_dir)
    cells = corridors(s.rooms, s.furniture, COARSE)
    return cells.groupBy("room", F.col("row").cast("long").alias("row"), "half_width_m").agg(F.count("*").alias("cells"), F.sum("col").alias("cols"))


@query("d17_path_blockers", f"{_WALK_BASE}, {WAYS}, {TRACKS} SELECT room, src, dst, from_door, distance_m FROM ({_BLOCKED})")
def path_blockers(spark, sf_dir):
    return _walks(spark, sf_dir, COARSE).where("type = 'blocks_path'").select("room", "src", "dst", "from_door", "distance_m")


@query("k4_walks", f"{_WALK_BASE}, {WAYS}, {TRACKS} {_TRAFFIC} UNION ALL {_BLOCKED}")
def traffic(spark, sf_dir):
    return _walks(spark, sf_dir, COARSE)


@query("k4_walks_fine")
def traffic_fine(spark, sf_dir):
    """On the grid of production; tests hold it against a plain search."""
    return _walks(spark, sf_dir, C)


# rooms by number: closed; closed and split by a wall; two walls (their hull); one wall (what is around it)
_WD = "(4 + room % 7 * 0.5) AS w, (3 + room % 5 * 0.5) AS d"
_DRAWN = {
    "area": ("w * d", "w * 0.6 * d", "w * d / 2", "w * 0.12"),
    "cx": ("w / 2", "w * 0.7", "w * 2 / 3", "w / 2"),
    "cy": ("d / 2", "d / 2", "d / 3", "0.0"),
    "points": ("5", "5", "4", "5"),
}


@query("c1_room_polygons", f"WITH {q.ROOM}, m AS (SELECT room, {_WD} FROM room) SELECT room, " + ", ".join(f"round((CASE room % 4 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(xs))} END)::DOUBLE, 6) + 0.0 AS {n}" if n != "points" else f"(CASE room % 4 {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(xs))} END)::BIGINT AS points" for n, xs in _DRAWN.items()) + " FROM m")
def room_polygons(spark, sf_dir):
    walls = drawn_walls(room_ids(spark, sf_dir))
    return pg.room_polygons(walls, rel.wall_entities(walls)).select("room", r("area"), r("cx"), r("cy"), F.size("ring").cast("long").alias("points"))


# --- layout text

_LAYOUT_LINES = "SELECT l_orderkey AS room, l_partkey, l_suppkey, 'bbox_' || (l_partkey * 10 + l_linenumber) AS id, row_number() OVER (PARTITION BY l_orderkey, l_partkey * 10 + l_linenumber ORDER BY (l_partkey % 59 * 97) || 'e-3,' || (l_suppkey % 41 * 91) || 'e-3,,oops,0.5,1,-' || (l_partkey % 7) DESC) AS n FROM lineitem WHERE l_partkey % 11 <> 0 AND l_partkey % 13 <> 0"


@query("a1_layout_parse", f"SELECT room, id, 'furniture' AS kind, (l_partkey % 59 * 97) / 1000.0 AS x, (l_suppkey % 41 * 91) / 1000.0 AS y, (l_partkey % 7) / 10.0 AS depth FROM ({_LAYOUT_LINES}) WHERE n = 1")
def layout_parse(spark, sf_dir):
    """Layouts written as text and read back: comments, lines of other forms and short lines fall out, equal ids are one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("room"), "l_partkey", "l_suppkey", "l_linenumber")
    part = F.col("l_partkey")
    line = F.when(part % 11 == 0, F.concat(F.lit("# "), part)).when(part % 13 == 0, F.concat(F.lit("bbox_1=Bbox(bed,"), part, F.lit(")"))).otherwise(
        F.concat(F.lit("Bbox_"), part * 10 + F.col("l_linenumber"), F.lit(" = BBOX(chair, "), part % 59 * 97, F.lit("e-3,"), F.col("l_suppkey") % 41 * 91, F.lit("e-3,,oops,0.5,1,-"), part % 7, F.lit("e-1,2)"))
    )
    layouts = rows.select("room", line.alias("line")).groupBy("room").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("layout"))
    parsed = ly.parsed(ly.lines(layouts))
    return ly.unique_entities(ly.entities(parsed)).select("room", "id", "kind", "x", "y", "depth")


@query("a2_layout_skipped", "SELECT l_orderkey AS room, count(*) AS n FROM lineitem WHERE l_partkey % 11 <> 0 AND l_partkey % 13 = 0 GROUP BY l_orderkey")
def layout_skipped(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    line = F.when(part % 11 == 0, "# note").when(part % 13 == 0, "bbox_1=Bbox(bed,1)").otherwise("bbox_1=Bbox(bed,0,0,0,0,1,1,1)")
    layouts = rows.select(F.col("l_orderkey").cast("long").alias("room"), line.alias("line")).groupBy("room").agg(F.array_join(F.collect_list("line"), "\n").alias("layout"))
    return ly.skipped(ly.parsed(ly.lines(layouts))).groupBy("room").agg(F.count("*").alias("n"))


# --- encoding

EDGE_UNION = f"{OBJECT_EDGES} UNION ALL SELECT room, src, dst, type, clearance FROM we UNION ALL SELECT room, id, wall_id, kind || '_in_wall', NULL FROM fix"


def _graph(spark, sf_dir, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and the edges of objects, walls and fixtures."""
    s = Scene(spark, sf_dir, keep)
    edges = rel.object_edges(rel.pairs(s.furniture)).unionByName(_wall_edges(s)).unionByName(rel.fixture_edges(s.fixtures, s.walls))
    null = F.lit(None).cast("double")
    columns = ("room", "id", "kind", "label", "x", "y", "z", "yaw", "width", "depth", "height")
    fixed = s.fixtures.withColumn("label", F.col("kind")).withColumn("z", F.lit(0.0))
    nodes = s.furniture.select(*columns).unionByName(fixed.select(*columns)).unionByName(rel.wall_entities(s.walls).select(*columns))
    nodes = nodes.withColumn("type", en.node_type(F.col("kind"))).withColumns({c: null for c in ("centroid_x", "centroid_y", "area")})
    return nodes, edges


_LABEL_IX = "CASE label " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(vocab.LABELS)) + f" ELSE {len(vocab.LABELS)} END"


@query("b27_node_vectors", f"WITH {q.ENT} SELECT room, id, {_LABEL_IX} AS label_ix, {q.r('x', 'x')}, {q.r('sin(yaw)', 's')}, {q.r('cos(yaw)', 'c')}, {q.r('width + depth + height', 'size')} FROM ent")
def node_vectors(spark, sf_dir):
    v = en.node_vectors(_graph(spark, sf_dir)[0].where("type = 'object'"))
    at = lambda i: F.get("features", F.lit(i))
    return v.select("room", "id", "label_ix", r(at(0), "x"), r(at(3), "s"), r(at(4), "c"), r(at(5) + at(6) + at(7), "size"))


@query("d15_relation_buckets", f"WITH {q.SCENE}, {PAIR}, {WALL_PAIR}, {WALL_EDGE}, e AS ({EDGE_UNION}) SELECT CASE WHEN dst LIKE 'bbox%' THEN 'spatial' WHEN src LIKE 'bbox%' THEN 'to_wall' ELSE 'aperture_wall' END AS relation, type, count(*) AS n FROM e GROUP BY 1, 2")
def relation_buckets(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    types = nodes.select("room", "id", F.col("type").alias("node_type"))
    return en.edge_vectors(edges, types).groupBy("relation", "type").agg(F.count("*").alias("n"))


@query("h15_reverse_edges", f"WITH {q.SCENE} SELECT 'aperture_wall' AS relation, kind AS src_type, 'wall' AS dst_type, count(*) AS n FROM fix GROUP BY kind UNION ALL SELECT 'rev_aperture_wall', 'wall', kind, count(*) FROM fix GROUP BY kind")
def reverse_edges(spark, sf_dir):
    s = Scene(spark, sf_dir)
    nodes, _ = _graph(spark, sf_dir)
    types = nodes.select("room", "id", F.col("type").alias("node_type"))
    return en.edge_vectors(rel.fixture_edges(s.fixtures, s.walls), types, reverse=True).groupBy("relation", "src_type", "dst_type").agg(F.count("*").alias("n"))


@query("b28_edge_vectors", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT src, type, count(*) AS n, CASE type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(vocab.EDGE_TYPES)) + " END AS place FROM e GROUP BY src, type")
def edge_vectors(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    types = nodes.select("room", "id", F.col("type").alias("node_type"))
    v = en.edge_vectors(edges, types).where("relation = 'spatial'")
    place = F.array_position(F.slice("features", len(vocab.EDGE_FEATURES) + 1, len(vocab.EDGE_TYPES) + 1), F.lit(1.0)) - 1
    return v.groupBy("src", "type").agg(F.count("*").alias("n"), F.max(place).cast("int").alias("place"))


@query("h14_undirected_edges", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT DISTINCT room, least(src, dst) AS a, greatest(src, dst) AS b, type FROM e")
def undirected_edges(spark, sf_dir):
    return sc.undirected(_object_edges(spark, sf_dir), ["src"]).select("room", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type")


@query("g19_edge_scaling", f"WITH {q.ENT}, {PAIR} SELECT room, s_id AS src, t_id AS dst, round(CASE WHEN max(d) OVER w = min(d) OVER w THEN 0.5 ELSE (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) END, 6) + 0.0 AS scaled FROM pair WHERE d <= 1.0 WINDOW w AS (PARTITION BY room)")
def edge_scaling(spark, sf_dir):
    return sc.edge_scaling(_object_edges(spark, sf_dir).where("type = 'near'"), "distance_m").select("room", "src", "dst", r("scaled"))


# --- scores: events as predictions, their ids as teachers

PRED = f"""pred AS (SELECT event_id, user_id % 100 AS room, ({'[' + ', '.join(f"'{p}'" for p in vocab.PRINCIPLES) + ']'})[CAST(event_id % 9 AS INT) + 1] AS principle, 'n' || (user_id % 7) AS target,
  (event_id % 97) / 97.0 AS score, CASE WHEN event_id % 97 < 30 THEN 'violated' WHEN event_id % 97 < 60 THEN 'weak' ELSE 'good' END AS status, CASE event_id % 5 % 3 WHEN 0 THEN 'violated' WHEN 1 THEN 'weak' ELSE 'good' END AS actual FROM events)"""


def predictions(spark, sf_dir) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 97
    names = F.array(*(F.lit(p) for p in vocab.PRINCIPLES))
    status = F.when(n < 30, "violated").when(n < 60, "weak").otherwise("good")
    k = F.col("event_id") % 5 % 3
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 100).alias("room"), F.get(names, (F.col("event_id") % 9).cast("int")).alias("principle"), F.concat(F.lit("n"), F.col("user_id") % 7).alias("target"), (n / 97.0).cast("double").alias("score"), status.alias("status"), F.when(k == 0, "violated").when(k == 1, "weak").otherwise("good").alias("actual"))


_COUNTS = f"cnt AS (SELECT principle, s AS status, count(*) FILTER (WHERE status = s AND actual = s) AS tp, count(*) FILTER (WHERE status = s AND actual <> s) AS fp, count(*) FILTER (WHERE status <> s AND actual = s) AS fn FROM pred CROSS JOIN (VALUES ('violated'), ('weak'), ('good')) AS v(s) GROUP BY principle, s)"
_F1 = "f1 AS (SELECT principle, status, tp + fn AS support, 2 * p * r / greatest(p + r, 1e-9) AS f FROM (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS p, tp / greatest(tp + fn, 1)::DOUBLE AS r FROM cnt))"


@query("g11_status_counts", f"WITH {PRED}, {_COUNTS} SELECT principle, status, tp, fp, fn FROM cnt")
def status_counts(spark, sf_dir):
    return sc.status_counts(predictions(spark, sf_dir).withColumnRenamed("status", "predicted"))


@query("g12_f1_by_principle", f"WITH {PRED}, {_COUNTS}, {_F1} SELECT principle, {q.r('avg(f) FILTER (WHERE support > 0)', 'f1')}, sum(support)::BIGINT AS supervised FROM f1 GROUP BY principle")
def f1_by_principle(spark, sf_dir):
    return sc.f1_by_key(status_counts(spark, sf_dir)).select("principle", r("f1"), "supervised")


@query("g14_macro_f1", f"WITH {PRED}, {_COUNTS}, {_F1} SELECT {q.r('sum(f) / 9', 'macro_f1')}, sum(n)::BIGINT AS supervised_cells FROM (SELECT avg(f) FILTER (WHERE support > 0) AS f, sum(support) AS n FROM f1 GROUP BY principle)")
def macro_f1(spark, sf_dir):
    return sc.macro_f1(sc.f1_by_key(status_counts(spark, sf_dir)), len(vocab.PRINCIPLES)).select(r("macro_f1"), "supervised_cells")


@query("g13_score_mae", f"WITH {PRED} SELECT principle, {q.r('avg(abs(score - CASE actual WHEN ' + chr(39) + 'violated' + chr(39) + ' THEN 0.0 WHEN ' + chr(39) + 'weak' + chr(39) + ' THEN 0.5 ELSE 1.0 END))', 'mae')} FROM pred GROUP BY principle")
def score_mae(spark, sf_dir):
    actual = F.when(F.col("actual") == "violated", 0.0).when(F.col("actual") == "weak", 0.5).otherwise(1.0)
    return predictions(spark, sf_dir).groupBy("principle").agg(sc.mean_absolute(F.col("score"), actual).alias("mae")).select("principle", r("mae"))


_RANK = "CASE status WHEN 'violated' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END"
_WORST = f"worst AS (SELECT room, principle, target, status, score, m AS affected_count FROM (SELECT *, count(*) OVER (PARTITION BY room, principle) AS m, row_number() OVER (PARTITION BY room, principle ORDER BY {_RANK}, score, event_id) AS n FROM pred WHERE status <> 'good') WHERE n = 1)"


@query("g17_worst_by_principle", f"WITH {PRED}, {_WORST} SELECT room, principle, target, status, {q.r('score', 'score')}, affected_count FROM worst")
def worst_by_principle(spark, sf_dir):
    return sc.worst_by_principle(predictions(spark, sf_dir)).select("room", "principle", "target", "status", r("score"), "affected_count")


@query("g18_worst_by_node", f"WITH {PRED} SELECT room, target, CASE min({_RANK}) WHEN 0 THEN 'violated' WHEN 1 THEN 'weak' ELSE 'good' END AS worst FROM pred GROUP BY room, target")
def worst_by_node(spark, sf_dir):
    return sc.worst_by_node(predictions(spark, sf_dir))


@query("h8_recommendations", f"WITH {PRED} SELECT room, rank, 'Address the ''' || principle || ''' issue on ' || target || '.' AS recommendation FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY event_id)::INT AS rank FROM pred WHERE status <> 'good') WHERE rank <= 3")
def recommendations(spark, sf_dir):
    return sc.recommendations(predictions(spark, sf_dir))


_IMPACT = "CASE principle " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.IMPACTS.items()) + " ELSE 'medium' END"


@query("h9_ranked_violations", f"WITH {PRED} SELECT room, row_number() OVER (PARTITION BY room ORDER BY score, event_id)::INT AS rank, principle, target, status, {q.r('score', 'score')}, {_IMPACT} AS impact FROM pred WHERE status <> 'good'")
def ranked_violations(spark, sf_dir):
    return sc.ranked_violations(predictions(spark, sf_dir)).select("room", "rank", "principle", "target", "status", r("score"), "impact")


_BUCKET = "CASE WHEN s >= 0.85 AND s < 1.01 THEN 'Excellent' WHEN s >= 0.65 AND s < 1.01 THEN 'Good' WHEN s >= 0.45 AND s < 1.01 THEN 'Fair' WHEN s >= 0.25 AND s < 1.01 THEN 'Poor' WHEN s >= 0 AND s < 1.01 THEN 'Very Poor' ELSE 'Unknown' END"


@query("b31_score_labels", f"SELECT event_id, {_BUCKET} AS label FROM (SELECT event_id, value / 100.0 AS s FROM events)")
def score_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.score_label(F.col("value") / 100.0).alias("label"))


@query("j22_room_summaries", f"WITH {PRED} SELECT room, count(*) FILTER (WHERE status = 'violated') || ' violation(s) and ' || count(*) FILTER (WHERE status = 'weak') || ' warning(s) detected.' AS tail FROM pred GROUP BY room")
def room_summaries(spark, sf_dir):
    p = predictions(spark, sf_dir)
    scores = p.groupBy("room").agg(F.avg("score").alias("graph_score"))
    return sc.room_summary(p, scores).select("room", F.regexp_extract("summary", r"\d+ violation.*", 0).alias("tail"))


@query("g22_pooling", f"SELECT label, dim, {q.r('avg(v)', 'mean')}, {q.r('max(v)', 'max')} FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim")
def pooling(spark, sf_dir):
    return sc.pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("dim").cast("long").alias("dim"), r("mean"), r("max"))


@query("g23_attention", f"WITH {q.ENT}, {PAIR}, m AS (SELECT room, t_id, turn, d, max(d) OVER (PARTITION BY room, t_id) AS top FROM pair) SELECT room, t_id, {q.r('sum(exp(d - top) * turn) / sum(exp(d - top))', 'pooled')} FROM m GROUP BY room, t_id")
def attention(spark, sf_dir):
    rows = rel.pairs(Scene(spark, sf_dir).furniture).withColumn("key", F.struct("room", "t_id"))
    return sc.attention(rows, "room", "t_id", "distance_m", "angle_diff_deg").select("room", "t_id", r("out", "pooled"))


@query("b30_expected_scores", f"SELECT event_id, {q.r('(0.5 * exp(v2 - m) + exp(v3 - m)) / (exp(v1 - m) + exp(v2 - m) + exp(v3 - m))', 'score')}, CASE WHEN v1 = m THEN 0 WHEN v2 = m THEN 1 ELSE 2 END AS status_ix FROM (SELECT *, greatest(v1, v2, v3) AS m FROM (SELECT event_id, (event_id % 7)::DOUBLE AS v1, (event_id % 5)::DOUBLE AS v2, (event_id % 3)::DOUBLE AS v3 FROM events))")
def expected_scores(spark, sf_dir):
    logits = F.array(*((F.col("event_id") % k).cast("double") for k in (7, 5, 3)))
    return table(spark, sf_dir, "events").select("event_id", r(sc.expected_score(logits), "score"), sc.argmax(logits).alias("status_ix"))


# --- transcripts; the tables' texts are invented, so the phrases are theirs

VOCAB = tx.TextConfig(principles=(("of_the", ("of the", "and the")), ("with", ("with",)), ("that", ("that",))), actions=("from", "for", "this"), targets=("was", "by", "are"), topics=("with", "that", "near", "tion of"), avoid=("not ", "never"))
_SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(column: str) -> str:
    tags = f"regexp_replace(coalesce({column}, ''), '(?i)\\[(music|applause|laughter|noise)\\]', ' ', 'g')"
    return f"regexp_replace(regexp_replace(replace({tags}, '’', ''''), '{_SPACE}', ' ', 'g'), '^ | $', '', 'g')"


CLEAN = f"""norm AS (SELECT doc_id, source, (2018 + doc_id % 6)::INT AS year, {_norm("split_part(text, chr(10), 1)")} AS title, {_norm('text')} AS raw FROM documents),
parts AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(raw, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS all_s FROM norm),
clean AS (SELECT doc_id, year, source, title, raw, list_filter(all_s, lambda s, i: i = 1 OR lower(s) <> lower(all_s[i - 1])) AS sentences, array_to_string(list_filter(all_s, lambda s, i: i = 1 OR lower(s) <> lower(all_s[i - 1])), ' ') AS text FROM parts),
flags AS (SELECT *, regexp_extract_all(lower(text), '[a-zA-Z'']+') AS words FROM clean)"""
_RATIO = f"CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda w: w IN {q.names(vocab.COMMON_ENGLISH)})) / len(words)::DOUBLE END"


def _clean(spark, sf_dir) -> DataFrame:
    return tx.cleaned(transcripts(spark, sf_dir)).withColumn("seq", F.col("doc_id"))


@query("j8_clean_records", f"WITH {CLEAN} SELECT doc_id, title, md5(text) AS text_md5, len(sentences) AS n, len(words) < 20 AS too_short, len(words) > 800 AS too_long, {_RATIO} < 0.02 AND len(words) > 30 AS non_english FROM flags")
def clean_records(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id", "title", F.md5("transcript_clean").alias("text_md5"), F.size("sentences").cast("long").alias("n"), "quality_flags.*")


@query("g25_english_ratio", f"WITH {CLEAN} SELECT doc_id, {q.r(_RATIO, 'ratio')} FROM flags")
def english_ratio(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id", r(tx.english_ratio(F.col("transcript_clean")), "ratio"))


@query("j3_stable_ids", "SELECT doc_id, sha1(concat_ws('|', coalesce(source, ''), '', split_part(coalesce(text, ''), chr(10), 1), (doc_id + 2)::VARCHAR)) AS id FROM documents")
def stable_ids(spark, sf_dir):
    return transcripts(spark, sf_dir).select("doc_id", tx.stable_id(F.col("url"), F.lit(None).cast("string"), F.col("title"), F.col("row_index")).alias("id"))


@query("h3_first_of_equal", f"WITH {CLEAN} SELECT min(doc_id) AS doc_id FROM clean GROUP BY lower(title), lower(text)")
def first_of_equal(spark, sf_dir):
    return tx.first_of_equal(_clean(spark, sf_dir)).select("doc_id")


_PHRASES = [(p, k, j, phrase) for k, (p, phrases) in enumerate(VOCAB.principles) for j, phrase in enumerate(phrases)]
MATCH = f"""full_text AS (SELECT doc_id, year, lower(trim(title || '. ' || text)) AS t FROM clean),
piece AS ({' UNION ALL '.join(f"SELECT doc_id, year, t, '{p}' AS principle, {k} AS po, {j} AS pj, '{phrase}' AS phrase, string_split(t, '{phrase}') AS pieces FROM full_text WHERE contains(t, '{phrase}')" for p, k, j, phrase in _PHRASES)}),
place AS (SELECT * EXCLUDE (pieces, i), list_sum(list_transform(pieces[1:i], lambda s: length(s)))::BIGINT + (i - 1) * length(phrase) AS s FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM piece)),
win AS (SELECT *, s + length(phrase) AS e, substring(t, (greatest(s - 80, 0) + 1)::BIGINT, (least(s + length(phrase) + 80, length(t)) - greatest(s - 80, 0))::BIGINT) AS w FROM place),
found AS (SELECT *, regexp_extract_all(w, '[a-zA-Z_''-]+') AS ws FROM win),
hit AS (SELECT *, list_filter(ws, lambda x: x IN {q.names(VOCAB.actions)})[1] AS action, list_filter(ws, lambda x: x IN {q.names(VOCAB.targets)})[1] AS target, CASE WHEN contains(w, 'not ') OR contains(w, 'never') THEN 'avoid' ELSE 'promote' END AS polarity FROM found),
scored AS (SELECT *, round(0.75 + CASE WHEN action IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN target IS NOT NULL THEN 0.1 ELSE 0 END, 3)::DOUBLE AS confidence FROM hit)"""
_TOPICS = "list_filter([" + ", ".join(f"'{k}'" for k in sorted(VOCAB.topics)) + "], lambda k: contains(lower(title || ' ' || text), k))"
ON = f"topic AS (SELECT doc_id, year, {_TOPICS} AS kw FROM clean)"


@query("j9_phrase_matches", f"WITH {CLEAN}, {MATCH} SELECT doc_id, principle, s AS char_start, e AS char_end, action, target, polarity, confidence FROM scored")
def phrase_matches(spark, sf_dir):
    rows = tx.matches(_clean(spark, sf_dir), VOCAB)
    return rows.select("doc_id", "principle", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "action", "target", "polarity", "confidence")


@query("j15_topics", f"WITH {CLEAN}, {ON} SELECT doc_id, len(kw) > 0 AS is_on_topic, array_to_string(kw, ',') AS keywords FROM topic")
def topics(spark, sf_dir):
    return tx.topics(_clean(spark, sf_dir), VOCAB).select("doc_id", "is_on_topic", F.array_join("matched_keywords", ",").alias("keywords"))


@query("j16_rule_confidence", f"WITH {CLEAN}, {MATCH}, {ON} SELECT t.doc_id, coalesce(max(confidence), 0.0)::DOUBLE AS rule_confidence, count(s.doc_id) AS matches, max(len(kw)) > 0 AND count(s.doc_id) = 0 AS needs_llm FROM topic t LEFT JOIN scored s ON t.doc_id = s.doc_id GROUP BY t.doc_id")
def rule_confidence(spark, sf_dir):
    rows = tx.extracted(_clean(spark, sf_dir), VOCAB)
    return rows.select("doc_id", "rule_confidence", F.coalesce(F.size("principles"), F.lit(0)).cast("long").alias("matches"), "needs_llm").withColumn("matches", F.greatest("matches", F.lit(0).cast("long")))


@query("g7_topic_counts", f"WITH {CLEAN}, {MATCH}, {ON}, o AS (SELECT s.* FROM scored s JOIN topic t ON s.doc_id = t.doc_id WHERE len(kw) > 0) SELECT 'principle' AS kind, principle AS name, count(*) AS n FROM o GROUP BY principle UNION ALL SELECT 'action', action, count(*) FROM o WHERE action IS NOT NULL GROUP BY action UNION ALL SELECT 'target', target, count(*) FROM o WHERE target IS NOT NULL GROUP BY target")
def topic_counts(spark, sf_dir):
    return tx.topic_counts(_clean(spark, sf_dir), VOCAB)[1]


@query("g8_docs_by_year", f"WITH {CLEAN}, {ON} SELECT year, count(*) AS docs, count(*) FILTER (WHERE len(kw) > 0) AS on_topic FROM topic GROUP BY year")
def docs_by_year(spark, sf_dir):
    return tx.topic_counts(_clean(spark, sf_dir), VOCAB)[0]


@query("g9_principle_by_year", f"WITH {CLEAN}, {MATCH}, {ON} SELECT principle, " + ", ".join(f"count(*) FILTER (WHERE s.year = {y}) AS y{y}" for y in range(2018, 2024)) + " FROM scored s JOIN topic t ON s.doc_id = t.doc_id WHERE len(kw) > 0 GROUP BY principle")
def principle_by_year(spark, sf_dir):
    rows = tx.principle_by_year(_clean(spark, sf_dir), list(range(2018, 2024)), VOCAB)
    return rows.select("principle", *(F.col(f"`{y}`").alias(f"y{y}") for y in range(2018, 2024)))


@query("h6_examples", f"WITH {CLEAN}, {MATCH}, {ON}, o AS (SELECT s.principle, trim(substring(t.t, s.s + 1, s.e - s.s)) AS span, confidence, s.doc_id, s.pj, s.s FROM scored s JOIN full_text t ON s.doc_id = t.doc_id JOIN topic k ON k.doc_id = s.doc_id WHERE len(kw) > 0), one AS (SELECT *, row_number() OVER (PARTITION BY principle, span ORDER BY confidence DESC, doc_id, pj, s) AS n FROM o) SELECT principle, row_number() OVER (PARTITION BY principle ORDER BY confidence DESC, doc_id, pj, s)::INT AS rank, span, confidence FROM one WHERE n = 1")
def examples(spark, sf_dir):
    return tx.examples(_clean(spark, sf_dir), VOCAB)


@query("g15_principle_weights", f"WITH {PRED}, c AS (SELECT principle, ln(1 + count(*)) AS raw FROM pred WHERE principle <> 'clear_center' GROUP BY principle), v AS (SELECT unnest(" + "[" + ", ".join(f"'{p}'" for p in vocab.PRINCIPLES) + "]) AS principle) SELECT v.principle, round(greatest(0.1, coalesce(raw, 0) / sum(coalesce(raw, 0)) OVER () * 9), 6)::DOUBLE AS weight FROM v LEFT JOIN c USING (principle)")
def weights(spark, sf_dir):
    counts = predictions(spark, sf_dir).where("principle <> 'clear_center'").groupBy("principle").agg(F.count("*").alias("n"))
    return en.principle_weights(spark, counts).select("principle", r("weight"))


# --- scalar expressions


@query("b16_snap", "SELECT DISTINCT l_extendedprice AS v, round_even(l_extendedprice / 50, 0) * 50 AS snapped FROM lineitem")
def snap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("v"), g.snapped(F.col("l_extendedprice"), 50.0).alias("snapped")).distinct()


@query("b4_yaw", f"SELECT DISTINCT l_partkey AS k, {q.r('(a + pi()) - floor((a + pi()) / (2 * pi())) * 2 * pi() - pi()', 'yaw')} FROM (SELECT l_partkey, (l_partkey % 40 - 20) * 0.7::DOUBLE AS a FROM lineitem)")
def yaw(spark, sf_dir):
    a = (F.col("l_partkey") % 40 - 20).cast("double") * 0.7
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), r(g.normal_yaw(a), "yaw")).distinct()


@query("b12_corners", f"WITH {q.ENT} SELECT room, id, " + ", ".join(q.r(q.corner("ent", k)[j], f"{c}{k}") for k in range(4) for j, c in enumerate("xy")) + " FROM ent")
def corners(spark, sf_dir):
    points = g.Box.of().corners
    return Scene(spark, sf_dir).furniture.select("room", "id", *(r(points[k][j], f"{c}{k}") for k in range(4) for j, c in enumerate("xy")))


@query("d10_nearest_door", f"WITH {q.SCENE} SELECT room, id, door, {q.r('d', 'd')} FROM (SELECT e.room, e.id, f.id AS door, {q.hyp('e.x - f.x', 'e.y - f.y')} AS d, row_number() OVER (PARTITION BY e.room, e.id ORDER BY {q.hyp('e.x - f.x', 'e.y - f.y')}, f.ord) AS n FROM ent e JOIN fix f ON e.room = f.room AND f.kind = 'door') WHERE n = 1")
def nearest_door(spark, sf_dir):
    from ..operators.nearest import nearest

    s = Scene(spark, sf_dir)
    return nearest(s.furniture, s.fixtures.where("kind = 'door'"), "door").select("room", "id", "door", r("d"))


@query("h17_display_order", f"WITH {q.SCENE}, o AS (SELECT room, id, 3 AS k FROM ent UNION ALL SELECT room, id, CASE kind WHEN 'door' THEN 1 ELSE 2 END FROM fix UNION ALL SELECT room, id, 0 FROM wall) SELECT room, id, row_number() OVER (PARTITION BY room ORDER BY k, id)::INT AS place FROM o")
def display_order(spark, sf_dir):
    from pyspark.sql import Window

    s = Scene(spark, sf_dir)
    rows = s.furniture.select("room", "id", "kind").unionByName(s.fixtures.select("room", "id", "kind")).unionByName(s.walls.select("room", "id", F.lit("wall").alias("kind")))
    return rows.select("room", "id", F.row_number().over(Window.partitionBy("room").orderBy(en.index_of(F.col("kind"), vocab.KINDS), "id")).alias("place"))


# --- counters, summaries, the model

_ZONES = "z AS (SELECT room FROM sz UNION ALL SELECT room FROM bz UNION ALL SELECT room FROM dz)"


@query("a14_summaries", f"{RULE_BASE}, {_ZONES}, chk AS ({CHECKS}) SELECT r.room, (SELECT count(*) FROM ent e WHERE e.room = r.room) AS n_objects, 4::BIGINT AS n_walls, (SELECT count(*) FROM fix f WHERE f.room = r.room AND f.kind = 'door') AS n_doors, (SELECT count(*) FROM z WHERE z.room = r.room) AS n_zones, (SELECT count(*) FROM entry d WHERE d.room = r.room AND is_entry) AS entry_count, (SELECT count(*) FROM chk c WHERE c.room = r.room AND status = 'violated') AS principle_violations, (SELECT count(*) FROM chk c WHERE c.room = r.room AND status = 'weak') AS principle_warnings FROM room r")
def summaries(spark, sf_dir):
    s = rule_tables(spark, sf_dir)
    columns = ("room", "kind")
    entities = s.furniture.select(*columns).unionByName(s.fixtures.select(*columns)).unionByName(rel.wall_entities(s.walls).select(*columns))
    rows = ru.summary(entities, s.doors, s.zones, rel.fixture_edges(s.fixtures, s.walls), checks(spark, sf_dir), zo.focal_points(s.furniture, s.fixtures, s.zones))
    names = ("n_objects", "n_walls", "n_doors", "n_zones", "entry_count", "principle_violations", "principle_warnings")
    return rows.select("room", *(F.col(n).cast("long").alias(n) for n in names))


@query("f7_principle_edges", f"{RULE_BASE}, chk AS ({CHECKS}) SELECT room, target AS src, 'room_0' AS dst, 'principle_' || principle AS type, round(score, 6) + 0.0 AS score FROM chk")
def principle_edges(spark, sf_dir):
    return ru.check_edges(checks(spark, sf_dir)).select("room", "src", "dst", "type", r("score"))


@query("g20_view_bounds", f"WITH {q.ENT}, b AS (SELECT room, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ent GROUP BY room) SELECT room, {q.r('x0 - 0.06 * greatest(x1 - x0, y1 - y0, 1.0)', 'min_x')}, {q.r('x1 + 0.06 * greatest(x1 - x0, y1 - y0, 1.0)', 'max_x')}, {q.r('y0 - 0.06 * greatest(x1 - x0, y1 - y0, 1.0)', 'min_y')}, {q.r('y1 + 0.06 * greatest(x1 - x0, y1 - y0, 1.0)', 'max_y')} FROM b")
def view_bounds(spark, sf_dir):
    """What a view of the centres shows, with a margin of its larger side."""
    b = Scene(spark, sf_dir).furniture.groupBy("room").agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))))
    pad = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)) * 0.06
    return b.select("room", r(F.col("x0") - pad, "min_x"), r(F.col("x1") + pad, "max_x"), r(F.col("y0") - pad, "min_y"), r(F.col("y1") + pad, "max_y"))


@query("g21_edge_types", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT room, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM e GROUP BY room")
def edge_types(spark, sf_dir):
    return _object_edges(spark, sf_dir).groupBy("room").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


@query("g16_nodes_per_type", f"WITH {q.SCENE} SELECT 'object' AS node_type, count(*) AS n FROM ent UNION ALL SELECT 'wall', count(*) FROM wall UNION ALL SELECT kind, count(*) FROM fix GROUP BY kind")
def nodes_per_type(spark, sf_dir):
    return en.node_vectors(_graph(spark, sf_dir)[0]).groupBy("node_type").agg(F.count("*").alias("n"))


_EPOCH = "epoch AS (SELECT user_id % 10 AS run, event_id // 100 AS epoch, avg(value) AS m FROM events GROUP BY 1, 2)"


@query("h11_best_epochs", f"WITH {_EPOCH} SELECT run, epoch, {q.r('m', 'macro_f1')}, coalesce(m > max(m) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM epoch")
def best_epochs(spark, sf_dir):
    """Epoch means, and which of them beat all before."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run"), F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.avg("value").alias("macro_f1"))
    return sc.running_best(e).select("run", "epoch", r("macro_f1"), "is_best")


@query("e5_applicable_cells", f"WITH {q.SCENE} SELECT room, 'object' AS node_type, count(*) * 7 AS cells FROM ent GROUP BY room UNION ALL SELECT room, 'door', count(*) FROM fix WHERE kind = 'door' GROUP BY room")
def applicable_cells(spark, sf_dir):
    s = Scene(spark, sf_dir)
    types = s.furniture.select("room", F.lit("object").alias("node_type")).unionByName(s.fixtures.select("room", F.col("kind").alias("node_type")))
    size = F.lit(0)
    for kind, principles in vocab.APPLICABLE.items():
        size = F.when(F.col("node_type") == kind, len(principles)).otherwise(size)
    return types.groupBy("room", "node_type").agg(F.sum(size).alias("cells")).where("cells > 0")


@query("k7_predictions")
def model_predictions(spark, sf_dir):
    """The attention model with its initial weights, over every room."""
    from ..operators import model as md

    s = Scene(spark, sf_dir)
    return md.scene_predictions(s.furniture, s.walls, s.fixtures, md.init_weights())
