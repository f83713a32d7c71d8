"""The whole graph of every scene: nodes, typed edges, zones, checks and counters, and the documents made of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SceneConfig
from ..functions import geometry as g
from ..operators import encoding as en
from ..operators import paths as pt
from ..operators import polygons as pg
from ..operators import relations as rel
from ..operators import rules as ru
from ..operators import zones as zo
from ..operators.sync import settled
from ..sources import files as fs

NODE = ("room", "id", "kind", "label", "x", "y", "z", "yaw", "width", "depth", "height")


@dataclass
class SceneGraph:
    nodes: DataFrame  # room, id, type, and what NODE and centroids name
    edges: DataFrame
    zones: DataFrame
    checks: DataFrame
    summary: DataFrame

    def documents(self) -> DataFrame:
        """room and the graph as a JSON text."""
        nodes = self.nodes.select(*NODE)
        zones = self.zones.select("room", "zone_id", "type", "anchor_id", "members", "x", "y", "zone_order", "zone")
        return fs.graph_documents(nodes, self.edges, zones, self.checks, self.summary)


def scene_graph(entities: DataFrame, walls: DataFrame, config: SceneConfig = SceneConfig(), keep: Callable[[DataFrame], DataFrame] = settled) -> SceneGraph:
    """entities: boxes of all kinds with ord, z and wall_id; walls: segments.  Rooms are numbers.

    keep: gives a table back that isn't worked out again; by default it is a checkpoint, so that plans stay small.
    """
    entities, walls = keep(g.boxed(entities)), keep(walls)
    furniture, fixtures = entities.where("kind IN ('furniture', 'unknown')"), entities.where("kind IN ('door', 'window')")
    furniture = furniture.where("kind = 'furniture'")
    rooms = keep(pg.room_polygons(walls, entities, config))
    zones = keep(zo.all_zones(furniture, config))
    wall_edges = keep(rel.wall_edges(rel.wall_pairs(furniture, walls, config), config))
    doors = keep(ru.classify_doors(fixtures, walls, rooms, config))
    entries = doors.where("is_entry")
    focal = zo.focal_points(furniture, fixtures, zones)
    checks = keep(ru.evaluate(ru.Tables(furniture, fixtures, walls, rooms, zones, wall_edges.where("type = 'has_backing'"), doors, config)))
    walked = pt.walks(rooms, furniture, entries, zones, config)
    plain = rel.plain_edges(walked, F.col("src"), F.col("dst"), F.col("type"), distance_m=F.col("distance_m"), length_m=F.col("length_m"))
    edges = None
    for part in (
        rel.inside_edges(entities, rooms), rel.object_edges(rel.pairs(furniture), config), rel.overlap_edges(rel.overlaps(furniture), config), wall_edges, rel.fixture_edges(fixtures, walls),
        zo.member_edges(zones), zo.table_edges(furniture, zones, config), plain, zo.entry_edges(zones, entries), zo.focal_edges(focal), ru.check_edges(checks),
    ):
        edges = part if edges is None else edges.unionByName(part)
    edges = keep(edges)
    null = F.lit(None).cast("double")
    own = entities.select(*NODE).withColumn("type", en.node_type(F.col("kind"))).withColumns({c: null for c in ("centroid_x", "centroid_y", "area")})
    blank = {c: null for c in ("x", "y", "z", "yaw", "width", "depth", "height")}
    zone_nodes = zones.select("room", F.col("zone_id").alias("id"), F.lit("zone").alias("kind"), F.col("type").alias("label"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    zone_nodes = zone_nodes.withColumns(blank | {"area": null}).withColumn("type", F.lit("zone"))
    room_nodes = rooms.select("room", F.lit("room_0").alias("id"), F.lit("room").alias("kind"), F.lit("room").alias("label"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), "area").withColumns(blank).withColumn("type", F.lit("room"))
    nodes = own.unionByName(zone_nodes).unionByName(room_nodes)
    return SceneGraph(nodes, edges, zones, checks, ru.summary(entities, doors, zones, edges, checks, focal))


def built(scenes: DataFrame, config: SceneConfig = SceneConfig()) -> DataFrame:
    """room, document and error of scene texts (room, source, text), as a sync asks for; a text that is no scene has an error."""
    key = F.xxhash64("room")
    read = scenes.select("room", key.alias("key"), F.from_json("text", fs.SCENE).alias("s"))
    good = read.where("s.entities IS NOT NULL").select(F.col("key").alias("room"), "s.*")
    entities = settled(fs.scene_entities(good))
    documents = scene_graph(entities.drop("raw"), fs.scene_walls(entities), config).documents().withColumnRenamed("room", "key")
    rows = read.select("room", "key").join(documents, "key", "left")
    return rows.select("room", "document", F.when(F.col("document").isNull(), "ValueError: no entities").alias("error"))
