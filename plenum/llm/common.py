"""What the operators share: table access, written tables that cut lineage, words and hashes in Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.  The same set is what bytes.split() and Arrow's ASCII split use.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a side are broadcast only when their number times their width stays below this.
BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches of a fifth of Spark's default number of rows, unless the session has its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a session without it one of our own.

    That is a temporary one where Spark runs in a single process, and otherwise one below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = tempfile.mkdtemp(prefix="plenum-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plenum-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    small_batches(spark)
    path = f"{shared_folder(spark)}/plenum-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before; the folder belongs to it
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 1024) -> DataFrame:
    """df with the sum of `value` over all rows of the same keys whose `order` (a whole number from 0, unique there) is less.

    Two levels: within a run of `width` numbers, and over runs, so that no task holds all rows of a key.
    """
    runs = df.withColumn("__run", F.floor(F.col(order) / width))
    totals = runs.groupBy(*keys, "__run").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__run", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("__inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(totals, [*keys, "__run"])
    return rows.withColumn(name, F.col("__before") + F.col("__inner")).drop("__run", "__inner", "__before")


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, counted now, is small enough to be sent to every executor."""
    return df.count() * row_bytes <= limit


def joined(left: DataFrame, right: DataFrame, on, how: str, small: bool) -> DataFrame:
    """A join whose right side is broadcast if its size has been checked, and shuffled otherwise."""
    return left.join(F.broadcast(right) if small else right, on, how)


def salted_join(rows: DataFrame, right: DataFrame, key: str, by: str, many: int = 1024) -> DataFrame:
    """rows joined with right (one row for each key), where a key that more than `many` rows have is in several tasks.

    Such rows are dealt by a hash of the column `by`, and what right has for their key goes to each of these parts.
    """
    heavy = rows.groupBy(key).count().where(F.col("count") > many).select(key, F.ceil(F.col("count") / many).cast("int").alias("__parts"))
    heavy = written(heavy, "heavy")
    small = fits_broadcast(heavy, 64)
    own = joined(rows, heavy, key, "left", small).withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(by), "__parts")).otherwise(0).cast("int")).drop("__parts")
    dealt = joined(right, heavy, key, "left", small).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return own.join(dealt, [key, "__part"]).drop("__part")


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def filtered(docs: DataFrame, keep, limit: int = 4 << 20) -> DataFrame:
    """The rows of docs for which keep(texts), a function on Arrow arrays of texts, is true; no row is moved.

    Columns are numbered meanwhile, as names with dots can't be mapped.
    """
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index('text')}"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, limit=limit):
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(text)))))

    return numbered.mapInArrow(kept, numbered.schema).toDF(*names)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def worker_kept(key, make):
    """What make() gives, kept from task to task while a Python worker lives."""
    kept = sys.modules.setdefault("_plenum_worker", types.ModuleType("_plenum_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more offset than texts).  Null: no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.values, np.asarray(lists.offsets, dtype=np.int64)
    words = words.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    full = np.asarray(pc.binary_length(words)) > 0
    encoded = words.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in encoded.dictionary.to_pylist()), dtype=np.uint64, count=len(encoded.dictionary))
    codes = np.asarray(encoded.indices)
    kept = np.concatenate([[0], np.cumsum(full)])
    return (table[codes[full]] if len(codes) else np.zeros(0, np.uint64)), kept[bounds].astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of every text, with their bounds; a shorter text that has words is one shingle."""
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(counts)), n)
    first = bounds[owner] + (np.arange(out_bounds[-1]) - out_bounds[owner])
    short = counts[owner] < width
    value = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            at = first + k
            inside = at < bounds[owner + 1]
            word = np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else np.uint64(0), np.uint64(k + 1))
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + word + (np.uint64(1) if k else np.uint64(0)) * short)
    return value, out_bounds


def give_back() -> None:
    """Returns memory that Arrow and the C library hold for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes of text or rows; a single longer text is a batch of its own.

    Memory that is kept for later is given back after each of the incoming batches, as workers live on between tasks.
    """
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0), dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        give_back()
