"""Golden values of the sample room, brute force for geometry and paths, properties of rules."""

import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.config import SceneConfig
from plenum.functions import geometry as g
from plenum.operators import paths as pt
from plenum.operators import polygons as pg
from plenum.operators import relations as rel
from plenum.operators import rules as ru
from plenum.operators import zones as zo
from plenum.operators.paths import Grid, blockers, walks, walks_of
from plenum.sources import layout as ly

SAMPLE = """# a room of 4 x 3

wall_0=Wall(0,0,0,4,0,0,2.7,0.12)
wall_1=Wall(4,0,0,4,3,0,2.7,0.12)
wall_2=Wall(4,3,0,0,3,0,2.7,0.12)
wall_3=Wall(0,3,0,0,0,0,2.7,0.12)
door_0=Door(wall_0,0.9,0,1.05,0.85,2.1)
window_0=Window(2,2.8,3,1.45,1.4,1.1)
bbox_0=Bbox(desk,3.1,1.0,0.4,1.5708,1.2,0.65,0.8)
bbox_1=Bbox(chair,2.6,1.0,0.45,1.5708,0.55,0.55,0.9)
bbox_2=Bbox(bed,1.1,2.0,0.35,0,1.9,1.1,0.7)
"""


@pytest.fixture(scope="module")
def scene(spark):
    layouts = spark.createDataFrame([(1, SAMPLE)], "room long, layout string")
    parsed = ly.parsed(ly.lines(layouts)).cache()
    entities = ly.unique_entities(ly.entities(parsed)).cache()
    walls = ly.walls(parsed).cache()
    furniture, fixtures = entities.where("kind = 'furniture'").cache(), entities.where("kind IN ('door', 'window')").cache()
    rooms = pg.room_polygons(walls, entities).cache()
    zones = zo.all_zones(furniture).cache()
    backings = rel.wall_edges(rel.wall_pairs(furniture, walls)).where("type = 'has_backing'")
    doors = ru.classify_doors(fixtures, walls, rooms).cache()
    return ru.Tables(furniture, fixtures, walls, rooms, zones, backings, doors), parsed, entities


def test_parse(scene, spark):
    _, parsed, entities = scene
    assert entities.count() == 9 and ly.skipped(parsed).count() == 0
    box = rel.bounds(entities).first()
    assert [round(v, 6) for v in box[1:]] == [-0.56, 4.56, -0.56, 3.56]
    bad = "bbox_1=Bbox(bed,1)\nnonsense\nlamp_1=Lamp(1,2)\nwall_0=Wall(0,0,0,1,0,0,2,0.1)\nwall_0=Wall(0,0,0,2,0,0,2,0.1)\nbbox_3=Bbox(unknown,x,1,1,7,-1,-2,3)\ndoor_1=Door(9,1,1,1,1,2)"
    p = ly.parsed(ly.lines(spark.createDataFrame([(1, bad)], "room long, layout string")))
    assert [(r.line_number, r.reason) for r in ly.skipped(p).orderBy("line_number").collect()] == [(1, "unsupported constructor/arity: Bbox"), (2, "not a recognized layout entity"), (3, "unsupported constructor/arity: Lamp")]
    got = {r.id: r for r in ly.entities(p).collect()}
    assert got["wall_0"].width == 2 and got["bbox_3"].kind == "unknown" and got["bbox_3"].x == 0 and got["bbox_3"].width == 1
    assert got["door_1"].depth == 0.10 and got["door_1"].wall_id == "wall_9" and got["bbox_3"].yaw == pytest.approx(7 - 2 * math.pi)
    document = ly.scene_documents(p).first().scene
    assert document.schema_version == "room_scene_v1" and len(document.entities) == 3 and len(document.skipped_lines) == 3


def test_room(scene):
    t, _, _ = scene
    room = t.rooms.first()
    assert (room.area, room.cx, room.cy) == pytest.approx((12.0, 2.0, 1.5))
    assert [(r.id, r.is_entry) for r in t.doors.collect()] == [("door_0", True)]


def test_edges(scene):
    t, _, _ = scene
    got = {(r.src, r.dst, r.type): r for r in rel.object_edges(rel.pairs(t.furniture)).collect()}
    kinds = lambda a, b: {k for x, y, k in got if (x, y) == (a, b)}
    assert kinds("bbox_0", "bbox_1") == {"near", "faces", "parallel_to", "in_front_of"} and got["bbox_0", "bbox_1", "near"].distance_m == pytest.approx(0.5)
    assert kinds("bbox_1", "bbox_0") == {"near", "parallel_to", "behind"}
    assert kinds("bbox_0", "bbox_2") == {"in_front_of"} == kinds("bbox_1", "bbox_2")
    assert kinds("bbox_2", "bbox_0") == {"right_of"} == kinds("bbox_2", "bbox_1")
    areas = {(r.src, r.dst): r.overlap_m2 for r in rel.overlap_edges(rel.overlaps(t.furniture)).collect()}
    assert areas == {("bbox_0", "bbox_1"): pytest.approx(0.055, abs=1e-4), ("bbox_1", "bbox_0"): pytest.approx(0.055, abs=1e-4)}
    wall = {(r.src, r.dst, r.type): round(r.clearance_m, 3) for r in rel.wall_edges(rel.wall_pairs(t.furniture, t.walls)).collect()}
    assert wall == {("bbox_2", "wall_3", "against_wall"): 0.15, ("bbox_2", "wall_2", "parallel_to_wall"): 0.45, ("bbox_0", "wall_1", "parallel_to_wall"): 0.575}


def test_zones(scene):
    t, _, _ = scene
    assert {r.zone_id: r.members for r in t.zones.collect()} == {"seating_group_0": ["bbox_1"], "bed_group_0": ["bbox_2"], "desk_group_0": ["bbox_0", "bbox_1"]}
    assert [r.focal_id for r in zo.focal_points(t.furniture, t.fixtures, t.zones).collect()] == ["window_0"]
    assert {(r.src, r.dst) for r in zo.entry_edges(t.zones, t.doors.where("is_entry")).collect()} == {("door_0", "bbox_1"), ("door_0", "bbox_2")}


def test_checks(scene):
    t, _, _ = scene
    rows = ru.evaluate(t).cache()
    got = {(r.principle, r.target): (r.status, round(r.score, 4)) for r in rows.collect()}
    assert got == {
        ("command_position", "bbox_2"): ("violated", 0.4), ("command_position", "bbox_0"): ("weak", 0.7), ("solid_backing", "bbox_2"): ("violated", 0.0),
        ("bed_aligned_with_door", "bbox_2"): ("violated", 0.0), ("clear_center", "room_0"): ("violated", 0.5929), ("pairing_balance", "bbox_2"): ("violated", 0.0),
        ("light_window_proximity", "bbox_1"): ("good", 1.0), ("light_window_proximity", "bbox_2"): ("good", 1.0),
    }
    evidence = {r.principle: r.evidence for r in rows.where("target = 'bbox_2'").collect()}
    assert "lacks wall backing" in evidence["command_position"] and evidence["pairing_balance"] == ["no nightstands on either side of bed"]
    assert ru.check_edges(rows).where("type = 'principle_clear_center'").count() == 1


def test_walks(scene):
    t, _, _ = scene
    rows = walks(t.rooms, t.furniture, t.doors.where("is_entry"), t.zones).collect()
    lengths = {r.dst: r.length_m for r in rows if r.type == "traffic_path"}
    assert set(lengths) == {"seating_group_0", "bed_group_0", "desk_group_0"} and all(0.5 < v < 5 for v in lengths.values())
    assert {r.src for r in rows if r.type == "blocks_path"} <= {"bbox_0", "bbox_1", "bbox_2"}


def random_rooms(seed, n, boxes=4):
    r = random.Random(seed)
    ring = [{"x": x, "y": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]
    box = lambda i: {"id": f"b{i}", "x": r.uniform(0, 2), "y": r.uniform(0, 2), "width": r.uniform(0.1, 0.7), "depth": r.uniform(0.1, 0.7), "yaw": r.uniform(0, 3), "blocks": True}
    return [{"ring": ring, "boxes": [box(i) for i in range(boxes)], "doors": [{"id": "d0", "x": 0.1, "y": 0.1}, {"id": "d1", "x": r.uniform(0, 2), "y": 0.0}], "zones": [{"zone_id": "z0", "x": 1.9, "y": 1.9}, {"zone_id": "z1", "x": r.uniform(0, 2), "y": r.uniform(0, 2)}]} for _ in range(n)]


def costs_by_force(free, start):
    cost = {start: 0.0}
    while True:  # Bellman-Ford
        new = dict(cost)
        for (a, b), d in cost.items():
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    p = (a + da, b + db)
                    if (da or db) and 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p] and d + math.hypot(da, db) < new.get(p, math.inf) - 1e-12:
                        new[p] = d + math.hypot(da, db)
        if new == cost:
            return cost
        cost = new


def test_paths_are_shortest():
    """Lengths, cells, half widths and the stated choice among equal paths, against plain searches cell by cell."""
    config = SceneConfig(grid_cell=0.1)
    rooms = random_rooms(2, 12)
    walked = {(w.room, w.door, w.zone): w for w in walks_of(rooms, config)}
    for k, room in enumerate(rooms):
        grid = Grid([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], room["boxes"], 0.1)
        free = grid.grid
        shut = [tuple(c) for c in np.argwhere(~np.pad(free, 1)) - 1]
        for door in room["doors"]:
            cost = costs_by_force(free, grid.nearest(grid.at(door["x"], door["y"])))
            for zone in room["zones"]:
                goal = grid.nearest(grid.at(zone["x"], zone["y"]))
                w = walked.get((k, door["id"], zone["zone_id"]))
                assert (w is None) == (goal not in cost)
                if w is None:
                    continue
                assert w.length == pytest.approx(cost[goal] * 0.1)
                back, here = [goal], goal
                while cost[here] > 0:  # above, left, right, below, then diagonals
                    here = next((here[0] + dr, here[1] + dc) for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)) if abs(cost.get((here[0] + dr, here[1] + dc), math.inf) + math.hypot(dr, dc) - cost[here]) < 1e-9)
                    back.append(here)
                assert [tuple(c) for c in w.cells] == back[::-1]
                widths = [min(15, min(max(abs(r - a), abs(c - b)) for a, b in shut)) * 0.1 for r, c in w.cells]
                assert w.half_width.tolist() == pytest.approx(widths)


@pytest.mark.parametrize("margin", [0, 2, 1000])
def test_walks_search_only_around_detours(monkeypatch, margin):
    """Rectangles around detours change no path; grids and half widths of many rooms are those of each; a way that is free isn't searched."""
    config, rooms = SceneConfig(grid_cell=0.1), random_rooms(7, 20, boxes=7)
    cells = lambda: {(w.room, w.door, w.zone): (w.cells.tolist(), w.half_width.tolist()) for w in walks_of(rooms, config)}
    want = {}
    for k, room in enumerate(rooms):  # each door's whole layer is searched
        grid = Grid([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], room["boxes"], 0.1)
        free = pt.stacked([grid.grid])
        width = pt.half_widths(free, 15)
        for door in room["doors"]:
            distance = pt.distances(free, np.array([grid.nearest(grid.at(door["x"], door["y"]))]) + 1)
            for zone in room["zones"]:
                goal = np.array([grid.nearest(grid.at(zone["x"], zone["y"]))]) + 1
                if distance[0, goal[0, 0], goal[0, 1]] < pt.FAR:
                    path = pt.followed(distance, np.array([0]), goal)[0]
                    want[k, door["id"], zone["zone_id"]] = (path - 1).tolist(), (width[0, path[:, 0], path[:, 1]] * 0.1).tolist()
    monkeypatch.setattr(pt, "MARGIN", margin)
    monkeypatch.setattr(pt, "PAIRS_AT_ONCE", 3)
    assert cells() == want and len(want) > 40
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    for one, room in zip(Grid.many([(ring, r["boxes"]) for r in rooms], 0.1), rooms, strict=True):
        alone = Grid(ring, room["boxes"], 0.1)
        assert (one.x0, one.y0) == (alone.x0, alone.y0) and (one.grid == alone.grid).all()
    monkeypatch.setattr(pt, "distances", None)
    rooms = random_rooms(8, 3, boxes=0)
    assert len(cells()) == 12


def test_walking_travels_by_value(tmp_path):
    """Executors have no plenum: what walks_of() uses is in its pickle."""
    from pyspark import cloudpickle

    (tmp_path / "walks").write_bytes(cloudpickle.dumps((walks_of, random_rooms(1, 2), SceneConfig())))
    code = "import sys, pickle; f, rooms, config = pickle.load(open(sys.argv[1], 'rb')); assert f(rooms, config) and 'plenum' not in sys.modules"
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "walks")], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=60)


def test_blockers_are_the_first_tight_places():
    config = SceneConfig(grid_cell=0.1)
    rooms = random_rooms(3, 10)
    for w in walks_of(rooms, config):
        want = {}
        for (x, y), half in zip(w.points, w.half_width, strict=True):
            for b in rooms[w.room]["boxes"]:
                dx, dy, c, s = x - b["x"], y - b["y"], math.cos(b["yaw"]), math.sin(b["yaw"])
                d = math.hypot(max(abs(dx * c + dy * s) - b["width"] / 2, 0), max(abs(dy * c - dx * s) - b["depth"] / 2, 0))
                if half < 0.6 and d <= 0.4:
                    want.setdefault(b["id"], d)
        assert dict(blockers(w, rooms[w.room]["boxes"], config)) == pytest.approx(want)


def test_convex_overlaps_equal_clipping():
    r = np.random.default_rng(4)
    ends = r.uniform(0, 3, (4, 300))
    box = np.stack([*r.uniform(0, 3, (2, 300)), *r.uniform(0.1, 2, (2, 300)), r.uniform(0, 6, 300)])
    x, y = pg.corridors_of(*ends, 0.3, 16)
    got = pg.convex_in_boxes(x, y, box)
    want = [abs(pg.area(pg.clip(list(zip(x[k], y[k], strict=True)), pg.box_ring(*box[:, k])))) for k in range(300)]
    assert np.allclose(got, want, atol=1e-9) and pg.is_convex([(0, 0), (1, 0), (0, 1)]) and not pg.is_convex([(0, 0), (2, 0), (1, 0.5), (2, 2)])


def test_walk_without_room_left():
    room = {"ring": [{"x": x, "y": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))], "boxes": [{"id": "b", "x": 0.5, "y": 0.5, "width": 3.0, "depth": 3.0, "yaw": 0.0, "blocks": True}], "doors": [{"id": "d", "x": 0.1, "y": 0.0}], "zones": [{"zone_id": "z", "x": 0.9, "y": 0.9}]}
    assert len(walks_of([room], SceneConfig())) == 1


def test_areas_against_clipping():
    r = random.Random(4)
    rows = [[r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(0.1, 2), r.uniform(0.1, 2), r.uniform(-7, 7)] for _ in range(400)]
    rows += [[0, 0, 1, 1, 0], [0.5, 0, 1, 1, 0], [0, 0, 1, 1, 0], [0, 0, 1, 1, 0], [0, 0, 1, 1, 0], [1, 0, 1, 1, 0], [0, 0, 1, 1, 0], [0, 0, 1, 1, math.pi / 2]]
    one, two = np.array(rows[::2]).T, np.array(rows[1::2]).T
    want = [abs(pg.area(pg.clip(pg.box_ring(*a), pg.box_ring(*b)))) if pg.clip(pg.box_ring(*a), pg.box_ring(*b)) else 0.0 for a, b in zip(one.T, two.T, strict=True)]
    assert np.allclose(rel.box_overlaps(one, two), want, atol=1e-9)


def test_box_distance(spark):
    r = random.Random(5)
    rows = [tuple(r.uniform(-2, 2) if i % 5 < 2 else r.uniform(0.1, 1.5) for i in range(10)) for _ in range(60)]
    names = [f"{p}{c}" for p in ("a_", "b_") for c in ("x", "y", "width", "depth", "yaw")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    df = df.withColumn("n", F.monotonically_increasing_id()).cache()
    parts = []
    for p in ("a_", "b_"):
        one = g.boxed(df.select("n", *(F.col(f"{p}{c}").alias(c) for c in ("x", "y", "width", "depth", "yaw"))))
        parts.append(one.select("n", *(F.col(c).alias(f"{p}{c}") for c in g.BOXED)))
    df = parts[0].join(parts[1], "n").orderBy("n")
    got = [x.d for x in df.select(g.box_box(g.Box.of("a_"), g.Box.of("b_")).alias("d")).collect()]

    def edge_points(box):
        ring = pg.box_ring(*box)
        return np.array([(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for p, q in zip(ring, ring[1:] + ring[:1], strict=True) for t in np.linspace(0, 1, 60)])

    for d, row in zip(got, rows, strict=True):
        a, b = edge_points(row[:5]), edge_points(row[5:])
        near = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min()
        meet = bool(pg.clip(pg.box_ring(*row[:5]), pg.box_ring(*row[5:])))
        assert d == 0 if meet else abs(d - near) < 0.03


def test_line_of_sight(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 0.0), (1, 1, 0.0, 2.0, 4.0, 2.0), (1, 2, 2.0, -1.0, 2.0, 0.0), (1, 3, 1.0, 1.0, 1.0, 1.0), (2, 4, 0.0, 0.0, 1.0, 1.0)], "room long, k int, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame([(1, 0, "w", 2.0, -1.0, 2.0, 1.0)], "room long, ord int, id string, ax double, ay double, bx double, by double")
    tall = g.boxed(spark.createDataFrame([(1, "o", "wardrobe", 3.0, 2.0, 0.5, 0.5, 2.0, 0.0), (1, "c", "curtain", 2.0, 2.0, 0.5, 0.5, 2.0, 0.0)], "room long, id string, label string, x double, y double, width double, depth double, height double, yaw double"))
    seen = {r.k: r.visible for r in rel.line_of_sight(lines, rel.occluders(walls, tall), ["room", "k"]).collect()}
    assert seen == {0: False, 1: False, 2: False, 3: True, 4: True}
    end = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 0.0)], "room long, k int, ax double, ay double, bx double, by double")
    assert rel.line_of_sight(end, rel.occluders(walls, tall), ["room", "k"]).first().visible


def test_faces():
    box = [((0.0, 0.0), (4.0, 0.0)), ((4.0, 0.0), (4.0, 3.0)), ((4.0, 3.0), (0.0, 3.0)), ((0.0, 3.0), (0.0, 0.0))]
    assert pg.area(pg.largest_face(box)) == pytest.approx(12)
    assert pg.area(pg.largest_face([*box, ((1.0, -0.5), (1.0, 3.5))])) == pytest.approx(9)  # a wall inside makes two faces
    assert pg.largest_face(box[:3]) is None
    assert pg.area(pg.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == pytest.approx(4)


def test_rooms_without_walls(spark):
    columns = "room long, ord int, x double, y double, width double, depth double, yaw double"
    entities = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0, 0.0), (2, 1, 5.0, 5.0, 0.0, 0.0, 0.0)], columns)
    walls = spark.createDataFrame([(3, 1, 0.0, 0.0, 1.0, 0.0), (3, 2, 1.0, 0.0, 1.0, 1.0)], "room long, ord int, ax double, ay double, bx double, by double")
    assert {r.room: r.area for r in pg.room_polygons(walls, entities).collect()} == {1: pytest.approx(4), 2: pytest.approx(4), 3: pytest.approx(0.5)}


def test_dense(scene):
    t, _, _ = scene
    rows = {(r.s_id, r.t_id): r for r in pg.dense_relations(rel.pairs(t.furniture), t.walls, t.furniture).collect()}
    assert len(rows) == 6 and all(abs(r.distance_m - rows[b, a].distance_m) < 1e-9 for (a, b), r in rows.items())
    assert rows["bbox_0", "bbox_2"].path_blocking_score > 0 and all(r.line_of_sight == 1 for r in rows.values())


def test_grid_of_an_open_outline(monkeypatch):
    """Where corners of an upright outline are open, a grid is had without the crossings of boxes, and is the same."""
    import random

    from plenum.operators import paths as pt

    rand, ring = random.Random(5), [(0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (0.0, 4.0)]
    box = lambda: {"x": rand.uniform(0, 6), "y": rand.uniform(0, 4), "width": rand.uniform(0.3, 5), "depth": rand.uniform(0.3, 2), "yaw": rand.uniform(0, 6.3)}
    rooms = [[box() for _ in range(k % 6)] for k in range(200)]
    short = [pt._open_bounds(ring, r) is not None for r in rooms]
    assert any(short) and not all(short)
    grids = [pt.Grid(ring, r, 0.25) for r in rooms]
    monkeypatch.setattr(pt, "_open_bounds", lambda *_: None)
    for grid, r in zip(grids, rooms, strict=True):
        full = pt.Grid(ring, r, 0.25)
        assert (grid.x0, grid.y0, grid.corner_left) == (full.x0, full.y0, full.corner_left) and (grid.grid == full.grid).all()
