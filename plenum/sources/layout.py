"""Layout text to entities: name_N=Ctor(arguments), one a line.

Lines that can't be read are kept with their number and the reason.  A wall that is given twice keeps its first place and
its last values; other entities may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

LINE = r"^([A-Za-z]+)_(\d+)\s*=\s*([A-Za-z]+)\s*\((.*)\)\s*$"
ARITY = {"wall": 8, "door": 6, "window": 6, "bbox": 8}
CSV_COLUMNS = ("id", "kind", "label", "x", "y", "z", "yaw_rad", "yaw_deg", "width", "depth", "height", "confirmed", "notes")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """room (the file), line_number, line of every line of the files at a path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("room"), "value")
    return lines(files.select("room", F.col("value").alias("layout")))


def lines(layouts: DataFrame) -> DataFrame:
    """layouts: room, layout."""
    parts = F.split("layout", r"\r\n|\r|\n", -1)
    return layouts.select("room", F.posexplode(parts).alias("pos", "line")).select("room", (F.col("pos") + 1).alias("line_number"), "line")


def number(value: Column) -> Column:
    """A number, 0 if it can't be read."""
    return F.coalesce(F.expr("CAST(NULL AS DOUBLE)"), value.try_cast("double"), F.lit(0.0))


def parsed(line_rows: DataFrame, blanks_shift: bool = True) -> DataFrame:
    """Lines with entity_id, ctor, params and reason (null if it can be read); blank lines and comments are left out.

    blanks_shift: empty arguments are dropped, and later ones move to the left.
    """
    text = F.trim("line")
    rows = line_rows.where((text != "") & ~text.startswith("#")).withColumn("text", text)
    m = lambda k: F.regexp_extract("text", LINE, k)
    params = F.transform(F.split(m(4), ","), lambda p: F.trim(p))
    rows = rows.withColumn("ctor", F.lower(m(3))).withColumn("params", F.filter(params, lambda p: p != "") if blanks_shift else params).withColumn("entity_id", F.concat(F.lower(m(1)), F.lit("_"), m(2)))
    enough = F.lit(False)
    for ctor, n in ARITY.items():
        enough = enough | ((F.col("ctor") == ctor) & (F.size("params") >= n))
    reason = F.when(F.col("ctor") == "", "not a recognized layout entity").when(~enough, F.concat(F.lit("unsupported constructor/arity: "), m(3)))
    return rows.withColumn("reason", reason).drop("text")


def skipped(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.where("reason IS NOT NULL").select("room", "line_number", "line", "reason")


def wall_id(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("wall_"), value)).otherwise(value)


def walls(parsed_rows: DataFrame) -> DataFrame:
    """room, ord (of the first line), id, ends, height, thickness (of the last line)."""
    names = ("ax", "ay", "az", "bx", "by", "bz", "height", "thickness")
    rows = parsed_rows.where("reason IS NULL AND ctor = 'wall'").select("room", F.col("line_number"), F.col("entity_id").alias("id"), *(number(F.get("params", F.lit(k))).alias(n) for k, n in enumerate(names)))
    grouped = rows.groupBy("room", "id").agg(F.min("line_number").alias("first"), F.max(F.struct("line_number", *names)).alias("last"))
    order = Window.partitionBy("room").orderBy("first")
    return grouped.withColumn("ord", F.row_number().over(order)).select("room", "ord", "id", *(F.col(f"last.{n}").alias(n) for n in names))


ENTITY = ("room", "ord", "id", "kind", "label", "x", "y", "z", "yaw", "width", "depth", "height", "wall_id")


def entities(parsed_rows: DataFrame) -> DataFrame:
    """Walls, then doors, windows and boxes in the order of lines, as boxes; ord is the place."""
    wall_rows = walls(parsed_rows)
    null = F.lit(None).cast("string")
    dx, dy, dz = (F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    mid = lambda c: (F.col(f"a{c}") + F.col(f"b{c}")) / 2
    as_walls = wall_rows.select("room", F.col("ord").alias("seq"), "id", F.lit("wall").alias("kind"), F.lit("wall").alias("label"), mid("x").alias("x"), mid("y").alias("y"), (mid("z") + F.col("height") / 2).alias("z"), F.atan2(dy, dx).alias("yaw"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("width"), F.greatest(F.col("thickness"), F.lit(0.02)).alias("depth"), "height", null.alias("wall_id"), F.lit(0).alias("part"))
    fixed = parsed_rows.where("reason IS NULL AND ctor IN ('door', 'window')")
    n = lambda k: number(F.get("params", F.lit(k)))
    fixed = fixed.select("room", F.col("line_number").alias("seq"), F.col("entity_id").alias("id"), F.col("ctor").alias("kind"), F.col("ctor").alias("label"), *(n(k).alias(c) for k, c in enumerate(("x", "y", "z", "width", "height"), 1)), wall_id(F.get("params", F.lit(0))).alias("wall_id"), F.when(F.col("ctor") == "door", 1).otherwise(2).alias("part"))
    own = wall_rows.select("room", F.col("id").alias("wall_id"), F.atan2(dy, dx).alias("w_yaw"), "thickness")
    fixed = fixed.join(own, ["room", "wall_id"], "left").withColumn("yaw", F.coalesce("w_yaw", F.lit(0.0))).withColumn("depth", F.when(F.col("thickness").isNull(), 0.10).otherwise(F.greatest("thickness", F.lit(0.08))))
    label = F.get("params", F.lit(0))
    boxes = parsed_rows.where("reason IS NULL AND ctor = 'bbox'").select("room", F.col("line_number").alias("seq"), F.col("entity_id").alias("id"), F.when(F.lower(label) == "unknown", "unknown").otherwise("furniture").alias("kind"), label.alias("label"), n(1).alias("x"), n(2).alias("y"), n(3).alias("z"), g.normal_yaw(n(4)).alias("yaw"), F.abs(n(5)).alias("width"), F.abs(n(6)).alias("depth"), F.abs(n(7)).alias("height"), null.alias("wall_id"), F.lit(3).alias("part"))
    columns = [c for c in ENTITY if c != "ord"]
    rows = as_walls.select(*columns, "seq", "part").unionByName(fixed.select(*columns, "seq", "part")).unionByName(boxes.select(*columns, "seq", "part"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("room").orderBy("part", "seq"))).select(*ENTITY)


def unique_entities(rows: DataFrame) -> DataFrame:
    """Entities by id as a scene keeps them: the first place, the last values."""
    grouped = rows.groupBy("room", "id").agg(F.min("ord").alias("first"), F.max(F.struct("ord", *(c for c in ENTITY if c not in ("room", "ord", "id")))).alias("last"))
    return g.boxed(grouped.select("room", F.col("first").alias("ord"), "id", *(F.col(f"last.{c}").alias(c) for c in ENTITY if c not in ("room", "ord", "id"))))


def scene_documents(parsed_rows: DataFrame) -> DataFrame:
    """room and the scene as a document (struct): version, units, bounds, entities, skipped lines."""
    from ..operators.relations import bounds

    rows = entities(parsed_rows)
    ends = walls(parsed_rows).select("room", "id", *(F.col(c).alias(f"w_{c}") for c in ("ax", "ay", "bx", "by", "height", "thickness")))
    rows = rows.join(ends, ["room", "id"], "left")
    raw = F.struct("wall_id", *(F.col(f"w_{c}").alias(c) for c in ("ax", "ay", "bx", "by", "height", "thickness")))
    rows = rows.withColumn("raw", F.when((F.col("kind") == "wall") | F.col("wall_id").isNotNull(), raw))
    lists = rows.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "kind", "label", "x", "y", "z", F.col("yaw").alias("yaw_rad"), "width", "depth", "height", F.lit(False).alias("confirmed"), F.degrees("yaw").alias("yaw_deg"), "wall_id", "raw"))).alias("entities"))
    bad = skipped(parsed_rows).groupBy("room").agg(F.sort_array(F.collect_list(F.struct("line_number", "line", "reason"))).alias("skipped_lines"))
    box = bounds(rows).select("room", F.struct("min_x", "max_x", "min_y", "max_y").alias("bounds"))
    rooms = parsed_rows.select("room").distinct()
    whole = rooms.join(lists, "room", "left").join(box, "room", "left").join(bad, "room", "left")
    default = F.struct(F.lit(-1.0).alias("min_x"), F.lit(1.0).alias("max_x"), F.lit(-1.0).alias("min_y"), F.lit(1.0).alias("max_y"))
    return whole.select("room", F.struct(F.lit("room_scene_v1").alias("schema_version"), F.lit("meters").alias("units"), F.coalesce("bounds", default).alias("bounds"), F.coalesce(F.transform("entities", lambda e: e.dropFields("ord")), F.array()).alias("entities"), F.coalesce("skipped_lines", F.array()).alias("skipped_lines")).alias("scene"))


def entities_csv(rows: DataFrame) -> DataFrame:
    """The fixed columns of the entity table export, in order."""
    wide = rows.withColumn("yaw_rad", F.col("yaw")).withColumn("yaw_deg", F.degrees("yaw")).withColumn("confirmed", F.lit(False)).withColumn("notes", F.lit(""))
    return wide.orderBy("room", "ord").select("room", *CSV_COLUMNS)
