"""The derived scene and plane geometry as DuckDB SQL text, written apart from the Column library it is held against."""

from __future__ import annotations

from ..functions.vocab import DEFAULT_CATEGORIES
from .derived import WALL_HEIGHT, WALL_THICKNESS, WALLS


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LABELS = "[" + ", ".join(f"'{c}'" for c in DEFAULT_CATEGORIES) + "]"

ENT = f"""ent AS (
  SELECT room, ord, 'bbox_' || (ord - 1) AS id, label, x, y, width, depth, height, yaw FROM (
    SELECT l_orderkey AS room,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord,
      ({_LABELS})[CAST(l_partkey % 24 AS INT) + 1] AS label,
      0.157::DOUBLE + (l_partkey % 59)::DOUBLE * 0.0971::DOUBLE AS x, 0.131::DOUBLE + (l_suppkey % 41)::DOUBLE * 0.0913::DOUBLE AS y,
      0.31::DOUBLE + (CAST(floor(l_quantity) AS INT) % 9)::DOUBLE * 0.19::DOUBLE AS width, 0.29::DOUBLE + (l_partkey % 7)::DOUBLE * 0.17::DOUBLE AS depth,
      0.11::DOUBLE + (l_partkey % 19)::DOUBLE * 0.103::DOUBLE AS height, (l_linenumber % 8)::DOUBLE * 0.7853::DOUBLE + 0.01::DOUBLE AS yaw
    FROM lineitem))"""

ROOM = "room AS (SELECT DISTINCT l_orderkey AS room FROM lineitem)"
WALL = "wall AS (SELECT room, w.* FROM room CROSS JOIN (VALUES " + ", ".join(f"({k}, '{n}', {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE, {WALL_HEIGHT}::DOUBLE, {WALL_THICKNESS}::DOUBLE)" for k, (n, ax, ay, bx, by) in enumerate(WALLS)) + ") AS w(ord, id, ax, ay, bx, by_, height, thickness))"
FIX = """fix AS (
  SELECT room, 10 AS ord, 'door_0' AS id, 'door' AS kind, 'wall_0' AS wall_id, 0.5::DOUBLE + (room % 50)::DOUBLE * 0.1::DOUBLE AS x, 0.0::DOUBLE AS y, 0.85::DOUBLE AS width, 0.12::DOUBLE AS depth, 2.1::DOUBLE AS height, 0.0::DOUBLE AS yaw FROM room
  UNION ALL SELECT room, 11, 'door_1', 'door', 'wall_2', 0.7::DOUBLE + (room % 40)::DOUBLE * 0.11::DOUBLE, 4.0, 0.9, 0.12, 2.1, pi() FROM room WHERE room % 3 = 0
  UNION ALL SELECT room, 20, 'window_0', 'window', 'wall_2', 3.0, 4.0, 1.4, 0.12, 1.1, pi() FROM room)"""

SCENE = ",\n".join((ENT, ROOM, WALL, FIX))


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def hyp(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def turn(a: str, b: str) -> str:
    """Undirected yaw difference; the yaws here differ by less than a full turn."""
    d = f"degrees({a} - {b})"
    w = f"abs(CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} < -180 THEN {d} + 360 ELSE {d} END)"
    return f"least({w}, 180 - {w})"


def angle(ux: str, uy: str, vx: str, vy: str) -> str:
    n = f"({hyp(ux, uy)} * {hyp(vx, vy)})"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE degrees(acos(greatest(-1.0, least(1.0, (({ux}) * ({vx}) + ({uy}) * ({vy})) / {n})))) END"


def corner(p: str, k: int) -> tuple[str, str]:
    """Corner k of the box of alias p, back left first, counterclockwise."""
    u, v = ((-1, -1), (1, -1), (1, 1), (-1, 1))[k]
    w, d = f"({u} * {p}.width / 2)", f"({v} * {p}.depth / 2)"
    return f"({p}.x + {w} * cos({p}.yaw) - {d} * sin({p}.yaw))", f"({p}.y + {w} * sin({p}.yaw) + {d} * cos({p}.yaw))"


def local(p: str, x: str, y: str) -> tuple[str, str]:
    return f"((({x}) - {p}.x) * cos({p}.yaw) + (({y}) - {p}.y) * sin({p}.yaw))", f"((({y}) - {p}.y) * cos({p}.yaw) - (({x}) - {p}.x) * sin({p}.yaw))"


def point_box(p: str, x: str, y: str) -> str:
    lx, ly = local(p, x, y)
    return hyp(f"greatest(abs({lx}) - {p}.width / 2, 0.0)", f"greatest(abs({ly}) - {p}.depth / 2, 0.0)")


def point_seg(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    t = f"greatest(0.0, least(1.0, ((({x}) - ({ax})) * {dx} + (({y}) - ({ay})) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    return hyp(f"({x}) - ({ax}) - {t} * {dx}", f"({y}) - ({ay}) - {t} * {dy}")


def clip(p: str, ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    """First and last share of a segment inside the box of alias p, by columns of a subquery: see clipped()."""
    (px, py), (qx, qy) = local(p, ax, ay), local(p, bx, by)
    first, last = [], []
    for a, b, h in ((px, qx, f"{p}.width / 2"), (py, qy, f"{p}.depth / 2")):
        d = f"({b} - {a})"
        first.append(f"CASE WHEN abs({d}) < 1e-12 THEN CASE WHEN abs({a}) > {h} + 1e-12 THEN 2.0 ELSE 0.0 END ELSE least((-({h}) - {a}) / {d}, ({h} - {a}) / {d}) END")
        last.append(f"CASE WHEN abs({d}) < 1e-12 THEN CASE WHEN abs({a}) > {h} + 1e-12 THEN -1.0 ELSE 1.0 END ELSE greatest((-({h}) - {a}) / {d}, ({h} - {a}) / {d}) END")
    return f"greatest(0.0, {first[0]}, {first[1]})", f"least(1.0, {last[0]}, {last[1]})"


def meets(p: str, ax: str, ay: str, bx: str, by: str) -> str:
    first, last = clip(p, ax, ay, bx, by)
    return f"({first} <= {last} + 1e-12)"


def seg_box(p: str, ax: str, ay: str, bx: str, by: str) -> str:
    parts = [point_box(p, ax, ay), point_box(p, bx, by), *(point_seg(*corner(p, k), ax, ay, bx, by) for k in range(4))]
    return f"CASE WHEN {meets(p, ax, ay, bx, by)} THEN 0.0 ELSE least({', '.join(parts)}) END"


def seg_seg(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str]) -> str:
    side = lambda o, p, q: f"((({p[0]}) - ({o[0]})) * (({q[1]}) - ({o[1]})) - (({p[1]}) - ({o[1]})) * (({q[0]}) - ({o[0]})))"
    crossing = f"{side(a, b, c)} * {side(a, b, d)} < 0 AND {side(c, d, a)} * {side(c, d, b)} < 0"
    return f"CASE WHEN {crossing} THEN 0.0 ELSE least({point_seg(*a, *c, *d)}, {point_seg(*b, *c, *d)}, {point_seg(*c, *a, *b)}, {point_seg(*d, *a, *b)}) END"


def box_box(p: str, q: str) -> str:
    meet = []
    for one, two in ((p, q), (q, p)):
        lx, ly = local(one, f"{two}.x", f"{two}.y")
        c, s = f"abs(cos({two}.yaw - {one}.yaw))", f"abs(sin({two}.yaw - {one}.yaw))"
        meet += [f"abs({lx}) <= {one}.width / 2 + {two}.width / 2 * {c} + {two}.depth / 2 * {s}", f"abs({ly}) <= {one}.depth / 2 + {two}.width / 2 * {s} + {two}.depth / 2 * {c}"]
    parts = [*(point_box(q, *corner(p, k)) for k in range(4)), *(point_box(p, *corner(q, k)) for k in range(4))]
    return f"CASE WHEN {' AND '.join(meet)} THEN 0.0 ELSE least({', '.join(parts)}) END"
