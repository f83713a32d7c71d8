"""Queries that take files and expressions through a round trip, or one operator by itself, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vocab
from ..operators import scoring as sc
from ..operators import viewer as vw
from ..sources import files as fs
from ..sources import layout as ly
from . import sql as q
from .derived import Scene, folder, table
from .queries import OBJECT_EDGES, PAIR, QUERIES, _object_edges, query, r  # noqa: F401
from .scene_graph import NODE


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query("a8_json_lines", "SELECT doc_id, text, lang FROM documents UNION ALL SELECT doc_id, text, lang FROM documents")
def json_lines(spark, sf_dir):
    """Documents written as JSON lines, appended once more, and read back; a folder that isn't there has no rows."""
    path, rows = folder(spark), _orders(spark, sf_dir).select("doc_id", "text", "lang")
    fs.write_json_lines(rows, path)
    fs.write_json_lines(rows, path, append=True)
    return fs.json_lines(spark, path, "doc_id long, text string, lang string").unionByName(fs.json_lines(spark, path + "-none", "doc_id long, text string, lang string"))


@query("a11_edges_csv", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT src AS source, dst AS target, type, count(*) AS n FROM e GROUP BY src, dst, type")
def edges_csv(spark, sf_dir):
    path = folder(spark)
    header = fs.write_edges_csv(_object_edges(spark, sf_dir).drop("room"), path)
    return spark.read.option("header", True).csv(path).select(header).groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query("a12_entities_csv", f"WITH {q.ENT} SELECT id, label, count(*) AS n, {q.r('sum(x)', 'x')}, {q.r('sum(degrees(yaw))', 'yaw_deg')} FROM ent GROUP BY id, label")
def entities_csv(spark, sf_dir):
    path = folder(spark)
    fs.write_csv(ly.entities_csv(Scene(spark, sf_dir).furniture).drop("room"), path)
    rows = spark.read.option("header", True).schema("id string, kind string, label string, x double, y double, z double, yaw_rad double, yaw_deg double, width double, depth double, height double, confirmed boolean, notes string").csv(path)
    return rows.groupBy("id", "label").agg(F.count("*").alias("n"), r(F.sum("x"), "x"), r(F.sum("yaw_deg"), "yaw_deg"))


def _scene_texts(spark, sf_dir) -> DataFrame:
    s = Scene(spark, sf_dir)
    fields = F.struct("id", "kind", "label", "x", "y", "z", F.col("yaw").alias("yaw_rad"), "width", "depth", "height")
    lists = s.furniture.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", fields.alias("e")))).alias("l"))
    return lists.select("room", F.to_json(F.struct(F.lit("room_scene_v1").alias("schema_version"), F.transform("l", lambda x: x["e"]).alias("entities"))).alias("value"))


@query("a4_scene_scan", f"WITH {q.ENT} SELECT room, ord, id, label, {q.r('x', 'x')}, {q.r('yaw', 'yaw')} FROM ent")
def scene_scan(spark, sf_dir):
    """Scenes as documents, a line each, read by the scan's schema; entities with defaults, in order."""
    path = folder(spark)
    _scene_texts(spark, sf_dir).select(F.to_json(F.struct("room", "value")).alias("value")).write.text(path)
    rows = spark.read.schema("room long, value string").json(path).select("room", F.from_json("value", fs.SCENE).alias("s")).select("room", "s.*")
    return fs.scene_entities(rows).select("room", F.col("ord").cast("long").alias("ord"), "id", "label", r("x"), r("yaw"))


@query("a5_graph_scan", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT room, type, count(*) AS n FROM e GROUP BY room, type")
def graph_scan(spark, sf_dir):
    """Graph documents written and read back: edges by room and type."""
    s = Scene(spark, sf_dir)
    nodes = s.furniture.select(*NODE)
    zones = spark.createDataFrame([], "room long, zone_id string, type string, anchor_id string, members array<string>, x double, y double, zone_order int, zone int")
    checks = spark.createDataFrame([], "room long, principle string, target string, status string, score double, evidence array<string>, against array<string>, rule_order int")
    summary = nodes.groupBy("room").agg(F.count("*").cast("string").alias("n_objects"))
    path = folder(spark)
    fs.graph_documents(nodes, _object_edges(spark, sf_dir), zones, checks, summary).select(F.to_json(F.struct("room", "document")).alias("value")).write.option("compression", "gzip").text(path)
    rows = spark.read.schema("room long, document string").json(path).select("room", F.from_json("document", fs.GRAPH).alias("g")).select("room", "g.*")
    return fs.graph_tables(rows)["edges"].groupBy("room", "type").agg(F.count("*").alias("n"))


@query("a22_export_bounds", f"WITH {q.ENT} SELECT room, " + ", ".join(q.r(f"{f}({c} {s} ({a} * abs(cos(yaw)) + {b} * abs(sin(yaw))) / 2) {s} 0.6", n) for f, c, s, a, b, n in (("min", "x", "-", "width", "depth", "min_x"), ("max", "x", "+", "width", "depth", "max_x"), ("min", "y", "-", "depth", "width", "min_y"), ("max", "y", "+", "depth", "width", "max_y"))) + " FROM ent GROUP BY room")
def export_bounds(spark, sf_dir):
    s = Scene(spark, sf_dir)
    return vw.export_bounds(s.rooms, s.furniture).select("room", *(r(c) for c in ("min_x", "max_x", "min_y", "max_y")))


@query("b3_wall_ids", "SELECT l_orderkey AS room, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN 'wall_' || l_linenumber ELSE 'w' || l_linenumber END AS wall_id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def wall_ids(spark, sf_dir):
    n = F.col("l_linenumber").cast("string")
    given = F.when(F.col("l_linenumber") % 2 == 0, n).otherwise(F.concat(F.lit("w"), n))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("room"), F.col("l_linenumber").alias("line"), ly.wall_id(given).alias("wall_id"))
    return rows.groupBy("room", "line", "wall_id").agg(F.count("*").alias("n"))


@query("b21_local_to_world", f"WITH {q.ENT} SELECT room, ord, {q.r('x + 0.5 * cos(yaw) - 0.25 * sin(yaw)', 'wx')}, {q.r('y + 0.5 * sin(yaw) + 0.25 * cos(yaw)', 'wy')} FROM ent")
def world_points(spark, sf_dir):
    x, y = vw.local_to_world(F.col("x"), F.col("y"), F.col("yaw"), F.lit(0.5), F.lit(0.25))
    return Scene(spark, sf_dir).furniture.select("room", F.col("ord").cast("long").alias("ord"), r(x, "wx"), r(y, "wy"))


@query("b32_impacts", "SELECT k AS principle, v AS impact FROM (VALUES " + ", ".join(f"('{p}', '{vocab.IMPACTS.get(p, 'medium')}')" for p in (*vocab.PRINCIPLES, "other")) + ") AS t(k, v)")
def impacts(spark, sf_dir):
    names = spark.createDataFrame([(p,) for p in (*vocab.PRINCIPLES, "other")], "principle string")
    return names.select("principle", sc.impact(F.col("principle")).alias("impact"))


@query("b33_anchors", f"WITH {q.ENT} SELECT room, ord, CASE ord % 3 WHEN 0 THEN {q.r('x', 'x').split(' AS ')[0]} WHEN 1 THEN {q.r('x + 1', 'x').split(' AS ')[0]} ELSE {q.r('y', 'x').split(' AS ')[0]} END AS x FROM ent")
def anchors(spark, sf_dir):
    """Nodes with a centre, with two corners around x + 1, and with a centroid at y."""
    kind = F.col("ord") % 3
    centroid = F.when(kind == 2, F.array("y", "x"))
    corner = lambda d: F.struct((F.col("x") + d).alias("x"), F.col("y").alias("y"))
    at = vw.anchor(centroid, F.when(kind == 1, F.array(corner(0.5), corner(1.5))), F.col("x"), F.col("y"))
    return Scene(spark, sf_dir).furniture.select("room", F.col("ord").cast("long").alias("ord"), r(at["x"], "x"))


@query("b34_snapped_yaw", f"WITH {q.ENT} SELECT room, ord, (floor(degrees(yaw) / 90 + 0.5) * 90)::BIGINT AS degrees FROM ent")
def snapped(spark, sf_dir):
    yaw = F.round(F.degrees(vw.snapped_yaw(F.col("yaw")))).cast("long")
    return Scene(spark, sf_dir).furniture.select("room", F.col("ord").cast("long").alias("ord"), yaw.alias("degrees"))


@query("b13_footprint_area", f"WITH {q.ENT} SELECT room, ord, {q.r('width * depth', 'area')} FROM ent")
def footprint_area(spark, sf_dir):
    """The area of each footprint by its corners."""
    c = g.Box.of().corners
    twice = sum((c[k][0] * c[(k + 1) % 4][1] - c[(k + 1) % 4][0] * c[k][1] for k in range(4)), F.lit(0.0))
    return Scene(spark, sf_dir).furniture.select("room", F.col("ord").cast("long").alias("ord"), r(F.abs(twice) / 2, "area"))


@query("d18_node_details", f"WITH {q.ENT}, p AS (SELECT room, id, 'p' || ord AS principle FROM ent WHERE ord % 2 = 0) SELECT e.room, e.id, count(p.principle) AS predictions, max(CASE WHEN e.ord % 3 = 0 THEN '[LLM] p: ' || e.label END) AS notes FROM ent e LEFT JOIN p ON e.room = p.room AND e.id = p.id GROUP BY e.room, e.id")
def node_details(spark, sf_dir):
    f = Scene(spark, sf_dir).furniture
    found = f.where("ord % 2 = 0").select("room", F.col("id").alias("target"), F.col("ord").alias("seq"), F.concat(F.lit("p"), "ord").alias("principle"), F.lit("weak").alias("status"), F.lit(0.5).alias("score"))
    notes = f.where("ord % 3 = 0").select("room", F.col("id").alias("target"), F.col("ord").alias("seq"), F.lit("p").alias("principle"), F.col("label").alias("text"))
    return vw.node_details(f, found, notes).select("room", "id", F.size("predictions").cast("long").alias("predictions"), "notes")


@query("e8_visible_edges", f"WITH {q.ENT}, {PAIR}, e AS ({OBJECT_EDGES}) SELECT room, type, count(*) AS n FROM e WHERE type <> 'faces' GROUP BY room, type")
def visible(spark, sf_dir):
    """Typed edges and some of checks, without those of checks and one hidden type."""
    rows = _object_edges(spark, sf_dir).select("room", "type")
    rows = rows.unionByName(rows.withColumn("type", F.concat(F.lit("principle_"), "type")))
    return vw.visible_edges(rows, ("faces",)).groupBy("room", "type").agg(F.count("*").alias("n"))


@query("h1_row_index", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row_index, doc_id FROM documents")
def row_index(spark, sf_dir):
    """Places in a sheet, below its header, file by file."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) + 1
    return _orders(spark, sf_dir).select("source", place.cast("long").alias("row_index"), "doc_id")


@query("j19_safe_stems", r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g') AS stem FROM pages WHERE url IS NOT NULL AND url <> ''")
def safe_stems(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL AND url <> ''")
    return rows.select("page_id", fs.safe_stem(F.col("url")).alias("stem"))


@query("j20_rescued_json", "SELECT doc_id, '{\"id\": ' || doc_id || '}' AS json FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 <> 0")
def rescued(spark, sf_dir):
    """Objects in the text of answers; half of them are broken."""
    n = F.col("doc_id")
    text = F.concat(F.lit("Sure, here: "), F.when(n % 2 == 0, F.concat(F.lit('{"id": '), n, F.lit("}"))).otherwise(F.concat(F.lit('{"id": '), n, F.lit(",}"))), F.lit(" as asked."))
    return table(spark, sf_dir, "documents").select("doc_id", sc.rescued_json(text).alias("json"))


@query("a3_layout_scenes", f"WITH {q.ENT} SELECT room, count(*) AS entities FROM ent GROUP BY room")
def layout_scenes(spark, sf_dir):
    """Layout texts to scene documents: how many entities each has."""
    f = Scene(spark, sf_dir).furniture
    line = F.format_string("bbox_%d=Bbox(%s,%s,%s,0,%s,%s,%s,%s)", "ord", "label", *(F.col(c).cast("string") for c in ("x", "y", "yaw", "width", "depth", "height")))
    layouts = f.groupBy("room").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("layout"))
    return ly.scene_documents(ly.parsed(ly.lines(layouts))).select("room", F.size("scene.entities").cast("long").alias("entities"))


@query("c13_room_area", f"WITH {q.SCENE} SELECT room, count(*) AS corners, {q.r('max(x1) * max(y1)', 'area')} FROM (SELECT room, ax AS x, ay AS y, bx AS x1, by_ AS y1 FROM wall) GROUP BY room")
def room_outlines(spark, sf_dir):
    """Rings of rooms: corners without the closing one, and area by its corners."""
    s = Scene(spark, sf_dir)
    area = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 2), F.lit(0.0), lambda a, i: a + F.get("ring", i)["x"] * F.get("ring", i + 1)["y"] - F.get("ring", i + 1)["x"] * F.get("ring", i)["y"]) / 2
    return s.rooms.select("room", (F.size("ring") - 1).cast("long").alias("corners"), r(area, "area"))
