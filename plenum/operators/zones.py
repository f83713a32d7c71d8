"""Functional zones: seating groups by distance, beds with nightstands and lamps, desks with chairs; focal points."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import geometry as g
from ..functions import vocab
from ..functions.geometry import keyed
from .relations import is_in, plain_edges, side


def components(points: DataFrame, radius: float) -> DataFrame:
    """room, ord and group (0, 1, ... by first member) of points that chains of steps of at most radius connect.

    A room's points are one row, so that a batch holds many rooms; rooms are what bounds the memory.
    """
    rows = points.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rooms, ords, groups = [], [], []
            for room, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent = list(range(len(found)))

                def top(i: int, parent=parent) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]  # by itself: chained targets are assigned from left to right
                        i = parent[i]
                    return i

                for i, p in enumerate(found):
                    for j in range(i):
                        q = found[j]
                        if (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 <= radius * radius:
                            a, b = sorted((top(i), top(j)))
                            parent[b] = a
                numbers: dict[int, int] = {}
                for i, p in enumerate(found):
                    rooms.append(room)
                    ords.append(p["ord"])
                    groups.append(numbers.setdefault(top(i), len(numbers)))
            yield pa.RecordBatch.from_arrays([pa.array(rooms, pa.int64()), pa.array(ords, pa.int32()), pa.array(groups, pa.int32())], names=["room", "ord", "zone"])

    return rows.mapInArrow(grouped, "room long, ord int, zone int")


def seats(furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Seats with their zone and whether they are its primary: the largest sofa, couch or armchair, else the largest; first of equals."""
    rows = furniture.where(is_in(F.col("label"), vocab.SEATS))
    rows = rows.join(keyed(components(rows, config.seating_radius)), ["room", "ord"])
    best = Window.partitionBy("room", "zone").orderBy(is_in(F.col("label"), vocab.PRIMARY_SEATS).desc(), (F.col("width") * F.col("depth")).desc(), "ord")
    return rows.withColumn("is_primary", F.row_number().over(best) == 1)


ZONE = ("room", "zone_id", "type", "zone", "anchor_id", "members", "x", "y", "size")


def seating_zones(seat_rows: DataFrame) -> DataFrame:
    grouped = seat_rows.groupBy("room", "zone").agg(
        F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("m"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.max(F.when(F.col("is_primary"), F.col("id"))).alias("anchor_id"), F.count("*").cast("int").alias("size"),
    )
    return grouped.select("room", F.concat(F.lit("seating_group_"), F.col("zone")).alias("zone_id"), F.lit("seating_group").alias("type"), "zone", "anchor_id", F.transform("m", lambda m: m["id"]).alias("members"), "x", "y", "size")


def _near(anchors: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """room, a_ord and the others within a distance of an anchor's box."""
    joined = side(anchors, "a_").join(keyed(side(others, "o_")), "room")
    return joined.where(g.box_box(g.Box.of("a_"), g.Box.of("o_")) <= distance)


def _members(anchors: DataFrame, parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Anchors with a list of ids for each part (ordered by ord)."""
    out = anchors
    for name, rows in parts:
        lists = rows.groupBy("room", F.col("a_ord").alias("ord")).agg(F.sort_array(F.collect_set(F.struct(F.col("o_ord").alias("ord"), F.col("o_id").alias("id")))).alias("l"))
        lists = lists.select("room", "ord", F.transform("l", lambda m: m["id"]).alias(name))
        out = out.join(keyed(lists), ["room", "ord"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def bed_zones(furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    label = F.col("label")
    beds, stands, lamps = (furniture.where(is_in(label, n)) for n in (vocab.BEDS, vocab.NIGHTSTANDS, vocab.LAMPS))
    near_stands = g.settled(_near(beds, stands, config.nightstand))
    near_lamps = _near(beds, lamps, config.nightstand).select("room", "a_ord", "o_ord", "o_id")
    matched = near_stands.select("room", "a_ord", *(F.col(f"o_{c}").alias(f"n_{c}") for c in g.BOXED))
    by_stand = matched.join(keyed(side(lamps, "o_")), "room").where(g.box_box(g.Box.of("n_"), g.Box.of("o_")) <= config.lamp_of_nightstand).select("room", "a_ord", "o_ord", "o_id")
    rows = _members(beds, [("stands", near_stands), ("lamps", near_lamps.unionByName(by_stand))])
    number = F.row_number().over(Window.partitionBy("room").orderBy("ord")) - 1
    return rows.select("room", F.concat(F.lit("bed_group_"), number).alias("zone_id"), F.lit("bed_group").alias("type"), number.alias("zone"), F.col("id").alias("anchor_id"), F.concat(F.array("id"), "stands", "lamps").alias("members"), "x", "y", (1 + F.size("stands") + F.size("lamps")).alias("size"), "stands", "lamps")


def desk_zones(furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Desks with a seat or a computer near; only those are numbered."""
    label = F.col("label")
    desks = furniture.where(is_in(label, vocab.DESKS))
    parts = [(name, _near(desks, furniture.where(is_in(label, labels)), config.desk_chair)) for name, labels in (("chairs", vocab.SEATS), ("computers", vocab.COMPUTERS), ("lamps", vocab.LAMPS))]
    rows = _members(desks, parts).where((F.size("chairs") > 0) | (F.size("computers") > 0))
    number = F.row_number().over(Window.partitionBy("room").orderBy("ord")) - 1
    return rows.select("room", F.concat(F.lit("desk_group_"), number).alias("zone_id"), F.lit("desk_group").alias("type"), number.alias("zone"), F.col("id").alias("anchor_id"), F.concat(F.array("id"), "chairs", "computers", "lamps").alias("members"), "x", "y", (1 + F.size("chairs") + F.size("computers") + F.size("lamps")).alias("size"), "chairs", "computers", "lamps")


def all_zones(furniture: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """Seating, then bed, then desk zones, with their place in that order (zone_order)."""
    parts = (seating_zones(seats(furniture, config)), bed_zones(furniture, config), desk_zones(furniture, config))
    out = None
    for k, part in enumerate(parts):
        rows = part.select(*ZONE, F.lit(k).alias("zone_order"))
        out = rows if out is None else out.unionByName(rows)
    return out


def member_edges(zones: DataFrame) -> DataFrame:
    rows = zones.select("room", "zone_id", F.explode("members").alias("member"))
    return plain_edges(rows, F.col("member"), F.col("zone_id"), F.lit("participates_in"))


def table_edges(furniture: DataFrame, zones: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """serves: table to a seating zone whose centre is near; table_for: the same to its primary seat."""
    tables = furniture.where(is_in(F.col("label"), vocab.TABLES)).select("room", "id", "x", "y")
    targets = zones.where("type = 'seating_group'").select("room", "zone_id", "anchor_id", F.col("x").alias("zx"), F.col("y").alias("zy"))
    d = g.hypot(F.col("x") - F.col("zx"), F.col("y") - F.col("zy"))
    rows = tables.join(keyed(targets), "room").withColumn("d", d).where(F.col("d") <= config.seating_radius + config.table_for)
    both = F.array(F.struct(F.col("zone_id").alias("to"), F.lit("serves").alias("type")), F.struct(F.col("anchor_id").alias("to"), F.lit("table_for").alias("type")))
    rows = rows.select("room", "id", "d", F.explode(both).alias("e"))
    return plain_edges(rows, F.col("id"), F.col("e.to"), F.col("e.type"), distance_m=F.col("d"))


def entry_edges(zones: DataFrame, entries: DataFrame) -> DataFrame:
    """Every entry door to the anchor of every seating and bed zone."""
    rows = zones.where("type IN ('seating_group', 'bed_group')").join(keyed(entries.select("room", F.col("id").alias("door"))), "room")
    return plain_edges(rows, F.col("door"), F.col("anchor_id"), F.lit("entry_path"))


def focal_points(furniture: DataFrame, fixtures: DataFrame, zones: DataFrame) -> DataFrame:
    """room and focal_id: the largest TV, else fireplace, else window, else the first seating zone's primary seat."""
    rank = lambda label: F.when(label == "tv", 0).when(label == "fireplace", 1)
    label: Column = F.lower(F.col("label"))
    candidates = furniture.where(label.isin(*vocab.FOCAL)).select("room", "id", rank(label).alias("rank"), (F.col("width") * F.col("depth")).alias("area"), "ord")
    windows = fixtures.where("kind = 'window'").select("room", "id", F.lit(2).alias("rank"), (F.col("width") * F.col("height")).alias("area"), "ord")
    first = zones.where("type = 'seating_group' AND zone = 0").select("room", F.col("anchor_id").alias("id"), F.lit(3).alias("rank"), F.lit(0.0).alias("area"), F.lit(0).alias("ord"))
    best = Window.partitionBy("room").orderBy("rank", F.col("area").desc(), "ord")
    return candidates.unionByName(windows).unionByName(first).withColumn("n", F.row_number().over(best)).where("n = 1").select("room", F.col("id").alias("focal_id"))


def focal_edges(focal: DataFrame) -> DataFrame:
    return plain_edges(focal, F.col("focal_id"), F.lit("room_0"), F.lit("focal_point_of"))
