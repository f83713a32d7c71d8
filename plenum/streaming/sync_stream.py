"""The sync as a stream: new scene files are picked up in micro-batches, and those rooms are built again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sync_stream(spark: SparkSession, scan_root: str, cache_root: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Builds every scene file that hasn't been seen, and ends.  A room with several new files in a batch takes the latest."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "scene.json").option("recursiveFileLookup", True).load(scan_root)
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("room"), F.col("path").alias("source"), F.col("content").cast("string").alias("text"), "modificationTime")

    def write(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("room").agg(F.max_by(F.struct("source", "text"), "modificationTime").alias("f")).select("room", "f.source", "f.text")
        made = build(latest).where("document IS NOT NULL").select("room", F.col("document").alias("value"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("room").text(cache_root)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
