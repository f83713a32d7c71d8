"""What a viewer and an editor of scenes ask for: anchors, snapping, visible edges, details of nodes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Point

EXPORT_COLUMNS = ("id", "kind", "label", "x", "y", "z", "yaw_rad", "yaw_deg", "width", "depth", "height", "confirmed", "notes")


def local_to_world(x: Column, y: Column, yaw: Column, along: Column, across: Column) -> Point:
    """A point in the frame of something at (x, y) that is turned by yaw."""
    return x + along * F.cos(yaw) - across * F.sin(yaw), y + along * F.sin(yaw) + across * F.cos(yaw)


def snapped_yaw(yaw: Column) -> Column:
    """The nearest multiple of a right angle, in radians; halves are rounded up."""
    return F.radians(F.floor(F.degrees(F.coalesce(yaw, F.lit(0.0))) / 90 + 0.5) * 90.0)


def anchor(centroid: Column, corners: Column, cx: Column, cy: Column) -> Column:
    """Where a node is drawn, as a struct x, y: its centroid, else the mean of its corners, else its centre, else null.

    centroid: array of two numbers; corners: array of structs x, y.
    """
    mean = lambda c: F.aggregate(F.transform(corners, lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / F.size(corners)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return (
        F.when(F.size(centroid) >= 2, at(F.get(centroid, F.lit(0)), F.get(centroid, F.lit(1))))
        .when(F.size(corners) > 0, at(mean("x"), mean("y"))).when(cx.isNotNull() & cy.isNotNull(), at(cx, cy))
    )


def visible_edges(edges: DataFrame, hidden: tuple[str, ...] = (), principles: bool = False) -> DataFrame:
    """Edges whose type isn't hidden; those of checks only if asked for."""
    rows = edges if principles else edges.where(~F.coalesce(F.col("type"), F.lit("")).startswith("principle_"))
    return rows.where(~F.coalesce(F.col("type"), F.lit("")).isin(*hidden)) if hidden else rows


def node_details(nodes: DataFrame, predictions: DataFrame, explanations: DataFrame) -> DataFrame:
    """room, id, predictions (structs in order) and notes (a text, a line each) of every node.

    predictions: room, target, seq, principle, status, score; explanations: room, target, seq, principle, text.
    """
    found = predictions.groupBy("room", F.col("target").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "principle", "status", "score"))).alias("predictions"))
    line = F.concat(F.lit("[LLM] "), F.coalesce("principle", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    notes = explanations.groupBy("room", F.col("target").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    notes = notes.select("room", "id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("notes"))
    rows = nodes.select("room", "id").join(found, ["room", "id"], "left").join(notes, ["room", "id"], "left")
    return rows.select("room", "id", F.transform(F.coalesce("predictions", F.array()), lambda p: p.dropFields("seq")).alias("predictions"), "notes")


def export_bounds(rooms: DataFrame, entities: DataFrame, pad: float = 0.6, least: float = 0.1) -> DataFrame:
    """room and the rectangle around its boxes, padded; sides of 0 count as `least`, and a room without boxes is 4 by 4."""
    size = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, least).otherwise(F.col(c))
    yaw, zero = F.coalesce("yaw", F.lit(0.0)), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    half_x = (size("width") * F.abs(F.cos(yaw)) + size("depth") * F.abs(F.sin(yaw))) / 2
    half_y = (size("width") * F.abs(F.sin(yaw)) + size("depth") * F.abs(F.cos(yaw))) / 2
    box = entities.groupBy("room").agg(
        (F.min(zero("x") - half_x) - pad).alias("min_x"), (F.max(zero("x") + half_x) + pad).alias("max_x"),
        (F.min(zero("y") - half_y) - pad).alias("min_y"), (F.max(zero("y") + half_y) + pad).alias("max_y"),
    )
    default = {"min_x": -2.0, "max_x": 2.0, "min_y": -2.0, "max_y": 2.0}
    return rooms.select("room").join(box, "room", "left").na.fill(default)


def _cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def export_csv(entities: DataFrame) -> DataFrame:
    """room and its entity table as one CSV text with a header.  entities: room, ord and what EXPORT_COLUMNS names but yaw_deg."""
    rows = entities.withColumn("yaw_deg", F.degrees(F.coalesce("yaw_rad", F.lit(0.0))))
    line = F.concat_ws(",", *(_cell(F.col(c)) for c in EXPORT_COLUMNS))
    lists = rows.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return lists.select("room", F.concat(F.lit(",".join(EXPORT_COLUMNS) + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("csv"))


def export_scenes(rooms: DataFrame, entities: DataFrame) -> DataFrame:
    """room and its scene as a JSON text, with bounds and degrees worked out anew."""
    rows = entities.withColumn("yaw_deg", F.degrees(F.coalesce("yaw_rad", F.lit(0.0)))).withColumn("yaw", F.col("yaw_rad"))
    lists = rows.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", *EXPORT_COLUMNS))).alias("entities"))
    lists = lists.select("room", F.transform("entities", lambda e: e.dropFields("ord")).alias("entities"))
    whole = export_bounds(rooms, rows).join(lists, "room", "left")
    return whole.select("room", F.to_json(F.struct(F.struct("min_x", "max_x", "min_y", "max_y").alias("bounds"), F.coalesce("entities", F.array()).alias("entities"))).alias("scene"))
