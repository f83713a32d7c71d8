"""The nearest of a room's targets for each piece, the first of equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import keyed


def nearest(pieces: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """room, id, the target's id under `name`, and d."""
    t = targets.select("room", F.col("id").alias(name), F.col("ord").alias("t_ord"), F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    rows = pieces.select("room", "id", "x", "y").join(keyed(t), "room").withColumn("d", g.hypot(F.col("x") - F.col("t_x"), F.col("y") - F.col("t_y")))
    first = Window.partitionBy("room", "id").orderBy("d", "t_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("room", "id", name, "d")
