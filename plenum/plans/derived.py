"""Scenes and transcripts derived from the star-schema tables, so that every operator has data at any scale.

A room is an order: its lines are furniture, and every room has the same four walls, a door, a window and, for every
third room, a second door.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import boxed
from ..functions.vocab import DEFAULT_CATEGORIES

WALLS = (("wall_0", 0.0, 0.0, 6.0, 0.0), ("wall_1", 6.0, 0.0, 6.0, 4.0), ("wall_2", 6.0, 4.0, 0.0, 4.0), ("wall_3", 0.0, 4.0, 0.0, 0.0))
WALL_HEIGHT, WALL_THICKNESS = 2.7, 0.12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    base = found or (tempfile.mkdtemp(prefix="plenum-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plenum-files")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_kept: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table written now, so that what is made of them is planned and worked out apart; removed when the driver ends."""
    path = folder(df.sparkSession)
    if not _kept:
        atexit.register(_remove_kept)
    _kept.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_kept() -> None:
    for spark, path in _kept:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before; the folder belongs to it
            return


def furniture(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """room, ord, id, kind, label and the box of every piece; a room's pieces are in one partition from here on.

    keep: read from a written table, for plans that have it in many places.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("room"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    order = Window.partitionBy("room").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    names = F.array(*(F.lit(c) for c in DEFAULT_CATEGORIES))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines.select(
        "room",
        F.row_number().over(order).alias("ord"),
        F.lit("furniture").alias("kind"),
        F.get(names, (part % len(DEFAULT_CATEGORIES)).cast("int")).alias("label"),
        (F.lit(0.157) + (part % 59).cast("double") * 0.0971).alias("x"),
        (F.lit(0.131) + (supp % 41).cast("double") * 0.0913).alias("y"),
        F.lit(0.0).alias("z"),
        (F.lit(0.31) + (F.floor("l_quantity") % 9).cast("double") * 0.19).alias("width"),
        (F.lit(0.29) + (part % 7).cast("double") * 0.17).alias("depth"),
        (F.lit(0.11) + (part % 19).cast("double") * 0.103).alias("height"),
        ((F.col("l_linenumber") % 8).cast("double") * 0.7853 + 0.01).alias("yaw"),
    ).withColumn("id", F.concat(F.lit("bbox_"), F.col("ord") - 1))
    return boxed(kept(rows) if keep else rows)


def room_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("room")).distinct()


def walls(rooms: DataFrame) -> DataFrame:
    """room, ord, id, ends, height, thickness of every wall."""
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("id"), *(F.lit(v).alias(c) for v, c in zip((ax, ay, bx, by), ("ax", "ay", "bx", "by"), strict=True))) for k, (n, ax, ay, bx, by) in enumerate(WALLS)))
    return rooms.select("room", F.explode(rows).alias("w")).select("room", "w.*", F.lit(WALL_HEIGHT).alias("height"), F.lit(WALL_THICKNESS).alias("thickness"))


def drawn_walls(rooms: DataFrame) -> DataFrame:
    """Walls that differ from room to room, by the room's number modulo 4: closed, closed and split in two, a corner, one wall."""
    w, d, kind = F.lit(4.0) + F.col("room") % 7 * 0.5, F.lit(3.0) + F.col("room") % 5 * 0.5, F.col("room") % 4
    zero, split = F.lit(0.0), w * 0.4
    ends = ((zero, zero, w, zero), (w, zero, w, d), (w, d, zero, d), (zero, d, zero, zero), (split, zero, split, d))
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(f"wall_{k}").alias("id"), *(v.cast("double").alias(c) for v, c in zip(e, ("ax", "ay", "bx", "by"), strict=True))) for k, e in enumerate(ends)]
    own = F.slice(F.array(*rows), F.lit(1), F.when(kind == 0, 4).when(kind == 1, 5).when(kind == 2, 2).otherwise(1))
    return rooms.select("room", F.explode(own).alias("w")).select("room", "w.*", F.lit(WALL_HEIGHT).alias("height"), F.lit(WALL_THICKNESS).alias("thickness"))


def fixtures(rooms: DataFrame) -> DataFrame:
    """room, ord, id, kind, wall_id and the box of doors and windows."""
    room = F.col("room")

    def one(k, name, kind, wall, x, y, z, width, height, yaw):
        return F.struct(F.lit(k).alias("ord"), F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.lit(wall).alias("wall_id"), x.alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(width).alias("width"), F.lit(WALL_THICKNESS).alias("depth"), F.lit(height).alias("height"), yaw.alias("yaw"))

    first = one(10, "door_0", "door", "wall_0", F.lit(0.5) + (room % 50).cast("double") * 0.1, 0.0, 1.05, 0.85, 2.1, F.lit(0.0))
    second = one(11, "door_1", "door", "wall_2", F.lit(0.7) + (room % 40).cast("double") * 0.11, 4.0, 1.05, 0.9, 2.1, F.pi())
    window = one(20, "window_0", "window", "wall_2", F.lit(3.0), 4.0, 1.45, 1.4, 1.1, F.pi())
    rows = F.when(room % 3 == 0, F.array(first, second, window)).otherwise(F.array(first, window))
    return boxed(rooms.select("room", F.explode(rows).alias("f")).select("room", "f.*"))


def room_rings(rooms: DataFrame) -> DataFrame:
    """room, ring, area, cx, cy: what the polygon operator gives for the four walls."""
    points = [(w[1], w[2]) for w in WALLS]
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [*points, points[0]]))
    return rooms.select("room", ring.alias("ring"), F.lit(24.0).alias("area"), F.lit(3.0).alias("cx"), F.lit(2.0).alias("cy"))


class Scene:
    """The tables of a derived scene; keep: with the furniture written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        rooms = room_ids(spark, sf_dir)
        self.rooms = room_rings(rooms)
        self.walls = walls(rooms)
        self.fixtures = fixtures(rooms)
        self.furniture = furniture(spark, sf_dir, keep)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, year, title (the first line), transcript_raw, url, row_index."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        (F.lit(2018) + F.col("doc_id") % 6).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("transcript_raw"),
        F.col("source").alias("url"),
        (F.col("doc_id") + 2).cast("int").alias("row_index"),
    )
