"""Incremental sync of a scene folder with a cache of graph documents: what is stale is built, and what fails is reported.

Listing and staleness are DataFrames; every stale room is built in its own try, so that one that fails stops no other.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import discovered, exists

RESULT = "room string, source string, destination string, status string, error string"


def stale(source: Column, destination: Column) -> Column:
    """Missing, or older than its source."""
    return destination.isNull() | (destination < source)


def plan(scenes: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """scenes and cached: room, path, mtime.  room, source, destination (null if missing), mtime and is_stale."""
    old = cached.select("room", F.col("path").alias("destination"), F.col("mtime").alias("cached_at"))
    rows = scenes.select("room", F.col("path").alias("source"), "mtime").join(old, "room", "left")
    return rows.withColumn("is_stale", F.lit(force) | stale(F.col("mtime"), F.col("cached_at")))


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now: files are listed and read once, and a later run doesn't find them in a cache."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        # a folder of one machine only where Spark runs in a single process
        own = tempfile.mkdtemp(prefix="plenum-") if context.master.startswith("local") else df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plenum-checkpoints"
        context.setCheckpointDir(found or own)
    return df.checkpoint()


def sync(spark: SparkSession, scan_root: str, cache_root: str, build: Callable[[DataFrame], DataFrame], *, recursive: bool = False, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Results by room: built, skipped, failed, would_build or would_skip.

    build gives room and document (null with an error's text in error) of the stale scenes, rows of room, source, text.
    Documents are written by Spark, a folder for each room below the cache.
    """
    scenes = discovered(spark, scan_root, recursive=recursive) if exists(spark, scan_root) else spark.createDataFrame([], "room string, path string, mtime timestamp")
    cached = _cached(spark, cache_root)
    rows = settled(plan(scenes, cached, force).withColumn("target", F.concat(F.lit(cache_root.rstrip("/") + "/room="), F.col("room"))))
    skipped = rows.where("NOT is_stale").select("room", "source", F.col("target").alias("destination"), F.lit("would_skip" if dry_run else "skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    if dry_run:
        return skipped.unionByName(rows.where("is_stale").select("room", "source", F.col("target").alias("destination"), F.lit("would_build").alias("status"), F.lit(None).cast("string").alias("error")))
    due = rows.where("is_stale").select("room", "source", F.col("target").alias("destination"))
    files = [r.source for r in due.select("source").collect()]  # paths of what is built now
    if not files:
        return skipped
    texts = spark.read.text(files, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"), F.col("value").alias("text"))
    source = due.withColumn("file", F.regexp_replace("source", "^file:/+", "/")).join(texts, "file")
    made = settled(build(source.select("room", "source", "text")))
    made.where("document IS NOT NULL").select("room", F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("room").text(cache_root)
    done = due.join(made, "room", "left").select("room", "source", "destination", F.when(F.col("document").isNull(), "failed").otherwise("built").alias("status"), F.when(F.col("document").isNull(), F.coalesce("error", F.lit("no document"))).alias("error"))
    return skipped.unionByName(done)


def _cached(spark: SparkSession, root: str) -> DataFrame:
    empty = spark.createDataFrame([], "room string, path string, mtime timestamp")
    if not exists(spark, root):
        return empty
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(root)
    room = F.regexp_extract("path", "/room=([^/]+)/", 1)
    return files.select(F.url_decode(room).alias("room"), F.regexp_replace("path", "/[^/]+$", "").alias("path"), F.col("modificationTime").alias("mtime")).groupBy("room", "path").agg(F.max("mtime").alias("mtime"))


def manifest(results: DataFrame) -> DataFrame:
    """Counts by status, and all results, as one document."""
    counts = results.groupBy("status").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("counts"))
    rooms = results.agg(F.sort_array(F.collect_list(F.struct("room", "source", "destination", "status", "error"))).alias("rooms"), F.count("*").alias("total"))
    # one row each
    return counts.withColumn("k", F.lit(0)).join(rooms.withColumn("k", F.lit(0)), "k").select(F.to_json(F.struct("total", "counts", "rooms")).alias("manifest"))
