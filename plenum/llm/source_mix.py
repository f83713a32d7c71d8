"""Mixing sources to target weights, in blocks of a fixed number of tokens (here: words).

Every source's documents are laid end to end, in a pseudorandom but repeatable order, and cut into blocks.  The mix is a
sequence of shards with the same number of slots.  Each shard draws its counts by source from a multinomial over the
sources' shares; a source whose budget is spent takes no more slots, and what a source has left after the last shard
goes to closing shards.  The j-th slot of a source maps through a keyed permutation of the source's blocks (another one
for each epoch), so that a block is never taken twice in an epoch; the last slot of a source takes only the words that
its target still lacks.  Blocks and documents are then joined by source and block index.

A target is at most `repeat` times its source's size, and so no document is taken more than `repeat` times.

There may be any number of sources: they are ranked by ranges, the level of their targets is found by sums over all of
them, and a shard draws first for groups of `group` sources and then within each group, which is the same multinomial.
The driver holds one number for each group.  Offsets of documents, and of a source's slots over shards, are sums over two
levels, so a source with most of the rows has no task of its own.

Null sources are a source of their own, after all others.  Null, empty and blank texts keep their row, with nothing
taken.  A long text lies in as many blocks as it fills.  Repeated rows and rows with equal ids are rows of their own.  An
empty table gives no rows.  Other columns, whatever their names, are carried along and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fits_broadcast, joined, mix64, sums_before, word_count, written


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    repeat: float = 2.0
    block: int = 512
    shard_slots: int = 256
    seed: int = 20240229
    group: int = 4096


def _rounds(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    with np.errstate(over="ignore"):
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: a Feistel network over the next even number of bits, walked until it is below n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        keys = mix64(np.uint64(key & (2**64 - 1)) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = _rounds(np.asarray(index, np.uint64), half, keys, back)
    while (over := x >= np.uint64(n)).any():
        x[over] = _rounds(x[over], half, keys, back)
    return x.astype(np.int64)


def _key(seed: int, source: int, epoch: int) -> int:
    return seed * 1_000_003 + source * 8191 + epoch


def slots_for(source: int, size: int, target: float, config: MixConfig) -> tuple[int, int, int]:
    """Blocks of a source, slots that reach its target to the word, and the words of the last slot (0: its whole block)."""
    if not size:
        return 0, 0, 0
    blocks = -(-size // config.block)
    epochs, rest = divmod(int(target + 0.5), size)
    if not rest:
        return blocks, epochs * blocks, 0
    tail = size - (blocks - 1) * config.block
    short = int(permuted(np.array([blocks - 1]), blocks, _key(config.seed, source, epochs), back=True)[0])
    have = lambda j: j * config.block - (config.block - tail if short < j else 0)  # noqa: E731  words of the first j slots
    j = max(1, -(-rest // config.block))
    while have(j) < rest:
        j += 1
    return blocks, epochs * blocks + j, rest - have(j - 1)


def ranked(sizes: DataFrame) -> DataFrame:
    """skey and size with source, the place of skey in code point order."""
    parts = 1 + sizes.count() // 50_000
    ranges = written(sizes.repartitionByRange(parts, "skey").withColumn("part", F.spark_partition_id()), "ranges")
    before = sums_before(ranges.groupBy("part").count(), [], "part", "count", "before").select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy("skey")) - 1
    return ranges.withColumn("place", place).join(before, "part").select("skey", "size", (F.col("before") + F.col("place")).alias("source"))


def with_targets(sources: DataFrame, config: MixConfig) -> DataFrame:
    """sources (skey, size, source) with target: shares of the whole by weight, none above `repeat` times its size.

    All but the full sources have the same target to a unit of weight.  That level rises, from the one without any full
    source, as long as it makes more of them full.
    """
    weight = F.get(F.array(*(F.lit(float(w)) for w in config.weights)), (F.col("source") % len(config.weights)).cast("int"))
    most = F.col("size") * float(config.repeat)
    rows = written(sources.withColumn("weight", weight).withColumn("most", most), "weights")
    total = rows.agg(F.sum("size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.lit(level) * F.col("weight") > F.col("most")
        r = rows.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if r[0] == full or not r[2]:
            return rows.withColumn("target", F.when(is_full, F.col("most")).otherwise(F.lit(level) * F.col("weight")))
        full, level = r[0], (config.share * total - (r[1] or 0.0)) / r[2]


def source_plan(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """skey, source, source_size, target, blocks, slots and last_take of every source; sizes: skey and size."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [slots_for(k, n, t, config) for k, n, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                columns = [pa.array(c, pa.int64()) for c in zip(*own, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["skey", "source", "source_size", "target", "blocks", "slots", "last_take"])

    rows = with_targets(ranked(sizes), config).select("skey", "source", F.col("size").alias("source_size"), "target")
    return written(rows.mapInArrow(planned, "skey string, source long, source_size long, target double, blocks long, slots long, last_take long"), "sources")


def laid_out(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, size, tie, source, its size and target, and the offset `start` in its sequence), and the plan."""
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), skey.alias("skey"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    rows = written(rows, "sizes")
    buckets = max(1, int(rows.count() ** 0.5))  # about as many buckets as rows in one
    rows = rows.withColumn("bucket", F.pmod("tie", F.lit(buckets)))
    totals = written(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words")), "totals")
    plan = source_plan(totals.groupBy("skey").agg(F.sum("words").alias("size")), config)
    before = sums_before(totals, ["skey"], "bucket", "words", "before").drop("words")
    before = joined(before, plan.select("skey", "source", "source_size", "target"), "skey", "inner", fits_broadcast(plan, 100))
    inner = Window.partitionBy("skey", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inner", F.sum("size").over(inner) - F.col("size")).join(before, ["skey", "bucket"])
    return written(placed.select("doc_id", "size", "tie", "source", "source_size", "target", (F.col("before") + F.col("inner")).alias("start")), "laid"), plan


def shard_counts(plan: DataFrame, config: MixConfig) -> DataFrame:
    """shard, lo and hi (the slots of a source that a shard takes), source, blocks, slots and last_take."""
    spark, per, seed, group = plan.sparkSession, config.shard_slots, config.seed, config.group
    taking = plan.where("slots > 0").withColumn("grp", F.floor(F.col("source") / group))
    groups = sorted((r["grp"], r["n"]) for r in taking.groupBy("grp").agg(F.sum("slots").alias("n")).collect())  # a row for each `group` sources
    total = sum(n for _, n in groups)
    shards = -(-total // per)
    names, shares = np.array([g for g, _ in groups], np.int64), np.array([n for _, n in groups], float) / max(total, 1)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, shard]).multinomial(per, shares)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(names[at]), pa.array(counts[at])], names=["shard", "grp", "n"])

    def by_source(draws: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own, parts = own.sort_values("source"), []
        inside = (own["slots"] / own["slots"].sum()).to_numpy() if len(own) else None
        for shard, grp, n in zip(draws["shard"], draws["grp"], draws["n"], strict=True):
            counts = np.random.default_rng([seed, shard, grp]).multinomial(n, inside)
            at = np.flatnonzero(counts)
            parts.append(pd.DataFrame({"shard": shard, "source": own["source"].to_numpy()[at], "n": counts[at]}))
        return pd.concat(parts) if parts else pd.DataFrame({"shard": [], "source": [], "n": []}).astype("int64")

    # a run of 4096 shards and a group of sources are drawn together
    run = F.floor(F.col("shard") / 4096)
    draws = spark.range(shards).mapInArrow(by_group, "shard long, grp long, n long").withColumn("run", run)
    own = taking.select("grp", "source", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(shards - 1, 0) // 4096).cast("long"))).alias("run"))
    drawn = draws.groupBy("grp", "run").cogroup(own.groupBy("grp", "run")).applyInPandas(by_source, "shard long, source long, n long")
    # the shard after the last asks for whatever is left
    closing = taking.select(F.lit(shards).cast("long").alias("shard"), "source", F.col("slots").alias("n"))
    counts = sums_before(written(drawn.unionByName(closing), "draws"), ["source"], "shard", "n", "asked")
    counts = joined(counts, taking.select("source", "blocks", "slots", "last_take"), "source", "inner", fits_broadcast(taking, 32))
    spans = counts.select("shard", F.least("asked", "slots").alias("lo"), F.least(F.col("asked") + F.col("n"), F.col("slots")).alias("hi"), "source", "blocks", "slots", "last_take")
    return spans.where("hi > lo")


def slots_of(spans: DataFrame, config: MixConfig) -> DataFrame:
    """shard, source, slot, epoch, block and take (words, from the block's begin) of every slot."""
    per, seed = config.shard_slots, config.seed

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lo, hi, source, blocks, slots, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(lo, hi, dtype=np.int64)
                epoch, within = slot // blocks, slot % blocks
                block = np.empty(len(slot), np.int64)
                for e in np.unique(epoch):
                    block[epoch == e] = permuted(within[epoch == e], blocks, _key(seed, source, int(e)))
                take = np.full(len(slot), config.block, np.int64)
                if last and hi == slots:
                    take[-1] = last
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(np.full(len(slot), source)), pa.array(slot), pa.array(epoch), pa.array(block), pa.array(take)], names=["shard", "source", "slot", "epoch", "block", "take"])

    # closing rows may be long; cut them so that no row stands for more slots than a shard has
    cut = spans.withColumn("lo", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(per).cast("long")))).withColumn("hi", F.least(F.col("hi"), F.col("lo") + per))
    # rows are few bytes and much work: as many tasks as the session has, not one for their bytes
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.select("shard", "lo", "hi", "source", "blocks", "slots", "last_take").repartition(tasks, "shard", "source", "lo")
    return cut.mapInArrow(mapped, "shard long, source long, slot long, epoch long, block long, take long")


def pieces_of(laid: DataFrame, config: MixConfig) -> DataFrame:
    """The parts of documents by block: source, block, from and to in the block, offset in the document; then the row's own columns."""
    size = config.block
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    rows = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.col("block") * size
    return rows.select(
        "source", "block", "start", "doc_id", "tie", "size",
        F.greatest(F.lit(0), F.col("start") - begin).alias("lo"),
        F.least(F.lit(size), F.col("start") + F.col("size") - begin).alias("hi"),
        F.greatest(F.lit(0), begin - F.col("start")).alias("at"),
    )


@dataclass
class Mix:
    laid: DataFrame
    plan: DataFrame
    slots: DataFrame
    #: doc_id, source, start, size, tie, shard, slot, epoch, and the words [word, word + taken) of the document that a slot takes
    parts: DataFrame


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> Mix:
    laid, plan = laid_out(docs, config)
    slots = slots_of(shard_counts(plan, config), config)
    both = pieces_of(laid, config).join(slots, ["source", "block"])
    taken = F.least(F.col("hi"), F.col("take")) - F.col("lo")
    parts = both.select("doc_id", "source", "start", "size", "tie", "shard", "slot", "epoch", F.col("at").alias("word"), taken.alias("taken")).where("taken > 0")
    return Mix(laid, plan, slots, parts)


def mix_report(mixed: Mix) -> DataFrame:
    """A row for each input row: doc_id, size, source_size, target, taken."""
    # rows without words may share a start: they keep their own row, the others are summed by source and start
    rows = mixed.laid.where("size > 0").select("doc_id", "size", "source_size", "target", "source", "start", F.lit(0).cast("long").alias("taken"))
    none = F.lit(None)
    got = mixed.parts.select(none.cast("long").alias("doc_id"), none.cast("long").alias("size"), none.cast("long").alias("source_size"), none.cast("double").alias("target"), "source", "start", "taken")
    # one row of each group has more than its taken words
    sums = rows.unionByName(got).groupBy("source", "start").agg(*(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("taken").alias("taken"))
    blank = mixed.laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return sums.select(columns).unionByName(blank.select(columns))


def _cut(text: str, spans: list, finder: re.Pattern) -> str:
    """The words of the spans, with the white space within each span."""
    edges = [(m.start(), m.end()) for m in finder.finditer(text)]
    return "\n".join(text[edges[a][0] : edges[b - 1][1]] for a, b in spans if b > a)


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of it, with the text that it takes.

    Columns of docs are kept; n_chars is counted anew where the text is a part.
    """
    mixed = mix(docs, config)
    w = Window.partitionBy("doc_id", "tie").orderBy("source", "start")
    spans = mixed.parts.groupBy("doc_id", "tie", "source", "start", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("word") + F.col("taken")).alias("until")))).alias("spans"), F.sum("taken").alias("n"))
    # rows that are equal in id and text are told apart by their order only
    laid = mixed.laid.where("size > 0")
    twins = not laid.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
    if twins:
        spans = spans.join(laid.select("source", "start", F.row_number().over(w).alias("twin")), ["source", "start"])
    else:
        spans = spans.withColumn("twin", F.lit(1))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("twin").alias("k"), F.struct("size", "spans", "n").alias("part"))
    # the row's own columns travel in a struct, out of the way of those of the mix
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("doc_id", "text").alias("tie"))
    place = Window.partitionBy("row_id", "tie").orderBy(F.col("row.source").asc_nulls_last())
    rows = rows.withColumn("twin", F.row_number().over(place) if twins else F.lit(1))
    both = rows.join(spans, F.col("row_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")) & (F.col("twin") == F.col("k"))).select("row", "part")
    partial = F.col("part.n") < F.col("part.size")

    @F.pandas_udf("string")
    def cut(text: pd.Series, parts: pd.Series) -> pd.Series:
        finder = re.compile(WORD)
        return pd.Series([t if p is None else _cut(t, [(x["word"], x["until"]) for x in p], finder) for t, p in zip(text, parts, strict=True)])

    both = both.withColumn("text", cut(F.col("row").getField("text"), F.when(partial, F.col("part.spans"))))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(partial, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return both.select(*(c.alias(name) for name, c in out.items()))
