"""Near-duplicates of texts: ProbMinHash signatures of weighted word shingles, banding, exact verification, classes.

A text is the set of its runs of five words, weighted by 1 + ln(occurrences).  Every element sends a Poisson process of
arrivals at random components, at a rate of its weight; the first element to arrive at a component is that component's
value, so that two texts agree there with the probability of their probability Jaccard similarity.  An element ends when
its next arrival is later than the latest first arrival of its text.

Texts that repeat shingles have a second signature with all weights 1, which agrees at the rate of the plain Jaccard
similarity; without repeats both are the same.  So copies that differ in how often they repeat a line are candidates too.

Texts with the same words are one node.  Nodes that agree on all rows of a band are candidates.  Each bucket first
compares its members with one hub, its most connected node; links found this way make classes.  Members of one bucket
that are in different classes then go through an exact join on the shingles that they share besides the hub's.  So no pair of candidates is
left out but those whose ends are in one class already, and a bucket full of copies costs as many comparisons as it has
members.  A pair is a link if the Jaccard similarity of its sets of shingles, from the whole texts, reaches the threshold.

Texts without words are one node if they are equal, and have no links.  Null texts are classes of their own.  A text
shorter than five words is one shingle, a very long one has all of its shingles.  Repeated rows, and rows with null or
equal ids, are classed by their texts; the class id is the smallest id among the class.  An empty table gives no rows.
Other columns, whatever their names, are carried along by the stage and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fits_broadcast, joined, mix64, salted_join, shingles, sliced, word_hashes, written


@dataclass(frozen=True)
class NearConfig:
    width: int = 5
    threshold: float = 0.8
    bands: int = 42
    rows: int = 8
    seed: int = 0x5EED


def weighted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of every text in order, the text of each, and how often it occurs."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return values[at], owner[at], np.diff(np.append(at, len(values)))


def prob_minhash(values: np.ndarray, owner: np.ndarray, weights: np.ndarray, texts: int, size: int, seed: int) -> np.ndarray:
    """A row of `size` elements for each text; texts without elements have zeros."""
    best = np.full((texts, size), np.inf)
    flat = best.reshape(-1)
    out = np.zeros(texts * size, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        state = mix64(values ^ np.uint64(seed))
    time = np.zeros(len(values))
    live = np.arange(len(values))
    latest = np.where(np.bincount(owner, minlength=texts) > 0, np.inf, 0.0)
    while len(live):
        with np.errstate(over="ignore"):
            state[live] += step
            a = mix64(state[live])
            b = mix64(a ^ np.uint64(0xD1B54A32D192ED03))
        time[live] -= np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[live]
        live_now = time[live] < latest[owner[live]]
        live, b = live[live_now], b[live_now]
        if not len(live):
            break
        cell = owner[live] * size + ((b >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, cell, time[live])
        won = flat[cell] == time[live]
        out[cell[won]] = values[live[won]]
        active = np.unique(owner[live])
        latest[active] = best[active].max(axis=1)
    return out.reshape(texts, size)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signature), bands)).copy()
        for r in range(rows):
            h = mix64(h * np.uint64(0xFF51AFD7ED558CCD) + parts[:, :, r])
    return h.view(np.int64)


def all_bands(values: np.ndarray, owner: np.ndarray, counts: np.ndarray, texts: int, config: NearConfig) -> pa.ListArray:
    """The distinct band hashes of each text: of its weighted signature, and of that with weights 1 if shingles are repeated."""
    size = config.bands * config.rows
    bands = band_hashes(prob_minhash(values, owner, 1 + np.log(counts), texts, size, config.seed), config.bands, config.rows)
    repeats = np.zeros(texts, bool)
    repeats[owner[counts > 1]] = True
    own = repeats[owner]
    at, number = np.flatnonzero(repeats), np.cumsum(repeats) - 1
    unit = prob_minhash(values[own], number[owner[own]], np.ones(int(own.sum())), len(at), size, config.seed)
    both = np.concatenate([bands, bands], axis=1)
    both[at, config.bands :] = band_hashes(unit, config.bands, config.rows)
    new = np.concatenate([np.ones_like(bands, bool), both[:, config.bands :] != bands], axis=1)
    new[np.bincount(owner, minlength=texts) == 0] = False  # without words there is nothing to band
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]), pa.int32()), pa.array(both[new]))


def fingerprints(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, tie (a hash of the text), key (of the words, or of a text without words; null for null texts), n (distinct shingles) and bands of every row."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", limit=2 << 20, rows=500):
            hashes, bounds = word_hashes(batch.column(2))
            values, owner, counts = weighted(*shingles(hashes, bounds, config.width))
            keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            for k in np.flatnonzero(np.diff(bounds) == 0):
                text = batch.column(2)[int(k)].as_py()
                keys[k] = None if text is None else xxhash.xxh3_128_digest(b"wordless " + text.encode())
            lists = all_bands(values, owner, counts, batch.num_rows, config)
            n = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), lists], names=["doc_id", "tie", "key", "n", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(printed, "doc_id long, tie long, key binary, n int, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """key and set (distinct shingle hashes) of the nodes in wanted (key, doc_id, tie of one row with its text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", limit=2 << 20, rows=500):
            values, owner, _ = weighted(*shingles(*word_hashes(batch.column(1)), width))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    small = fits_broadcast(wanted, 64)
    found = joined(rows, wanted, rows["d"].eqNullSafe(wanted["doc_id"]) & (rows["t"] == wanted["tie"]), "inner", small)
    # rows that repeat id and text give the same set; one of them is enough
    return found.select("key", "text").mapInArrow(sets, "key binary, set array<long>").groupBy("key").agg(F.first("set").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of the threshold at least."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    similarity = both / (F.size("set_a") + F.size("set_b") - both)
    # a hub is an end of many pairs
    return salted_join(salted_join(pairs, left, "a", "b"), right, "b", "a").where(similarity >= threshold).select("a", "b")


def outside_pairs(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of a hub's nodes in different classes that may reach the threshold; the hub itself is none of them.

    Of x and y with the hub h, the overlap is at most min(|x & h|, |y & h|) plus what they share outside h.  A node that
    is too far from its hub therefore needs shingles outside it in common with any other, and those are few, however many
    almost-copies of one text there are.  Where the other is so much smaller than the hub that this isn't needed, both
    meet at a token that stands for the hub.  Of a token's nodes, those of its most frequent class aren't compared.
    """
    own, hub_set = sets.select("key", "set"), sets.select(F.col("key").alias("hub"), F.col("set").alias("hub_set"))
    outside = F.array_except("set", "hub_set")
    nodes = salted_join(rest, hub_set, "hub", "key").join(own, "key").select("hub", "hub_n", "key", "label", "n", outside.alias("outside"))
    nodes = nodes.withColumn("inside", F.col("n") - F.size("outside"))
    smallest = rest.groupBy("hub").agg(F.min("n").alias("least"))
    share = threshold / (1 + threshold)  # of the sum of two sizes: the overlap that the threshold asks for
    enough = F.col("inside") >= F.ceil(share * (F.col("n") + F.col("least")) - 1e-9)
    tokens = F.when(enough, F.concat("outside", F.array(F.lit(None).cast("long")))).otherwise(F.col("outside"))
    rows = nodes.join(smallest, "hub").select("hub", "key", "label", "n", "inside", F.explode(tokens).alias("token"))
    rows = written(rows.select(F.xxhash64("hub", F.coalesce("token", F.lit(0))).alias("at"), F.col("token").isNull().alias("is_hub"), "key", "label", "n", "inside"), "tokens")
    counts = rows.groupBy("at", "label").count().groupBy("at").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    marked = rows.join(counts.where("labels > 1"), "at")
    side = lambda x: [F.col("key").alias(x), F.col("label").alias(f"label_{x}"), F.col("n").alias(f"n_{x}"), F.col("inside").alias(f"inside_{x}")]
    left = marked.where("label <> main").select("at", "is_hub", *side("x"))
    right = marked.select("at", "is_hub", *side("y"), (F.col("label") == F.col("main")).alias("in_main"))
    asked = F.ceil(share * (F.col("n_x") + F.col("n_y")) - 1e-9)
    within = F.least("inside_x", "inside_y")
    alike = F.least("n_x", "n_y") >= threshold * F.greatest("n_x", "n_y")
    pairs = left.join(right, ["at", "is_hub"]).where((F.col("label_x") != F.col("label_y")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & alike & (~F.col("is_hub") | (within >= asked)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """key and label of every end of a link; equal labels: connected.

    Each round, every node is renamed to the best of itself and its neighbours (the most connected one first, then by a
    hash that changes with the round), and links are carried over to the new names.  Rounds: the logarithm of the size.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        if k == 0:
            degree = both.groupBy("a").agg(F.count("*").alias("degree"))
            ranked = both.join(degree.select(F.col("a").alias("b"), F.col("degree").alias("of_b")), "b")
            best = ranked.groupBy("a").agg(F.count("*").alias("own"), F.min(F.struct(-F.col("of_b"), F.xxhash64("b"), F.col("b").alias("to"))).alias("near"))
            own = F.struct(-F.col("own"), F.xxhash64("a"), F.col("a").alias("to"))
        else:
            best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(k)), F.col("b").alias("to"))).alias("near"))
            own = F.struct(F.xxhash64("a", F.lit(k)), F.col("a").alias("to"))
        step = written(best.select("a", F.least("near", own)["to"].alias("to")), "step")
        moved_a, moved_b = step.select("a", F.col("to").alias("to_a")), step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = written(edges.join(moved_a, "a").join(moved_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "links")
        if labels is None:
            labels = step.select(F.col("a").alias("key"), F.col("to").alias("label"))
        else:
            moved = step.select(F.col("a").alias("label"), "to")
            labels = written(labels.join(moved, "label", "left").select("key", F.coalesce("to", "label").alias("label")), "labels")
        k += 1
    return labels if labels is not None else links.select(F.col("a").alias("key"), F.col("b").alias("label")).limit(0)


@dataclass
class Classes:
    prints: DataFrame
    nodes: DataFrame  # key, rep (doc_id and tie of one row), n
    labels: DataFrame  # key and label of nodes with links


def classes(docs: DataFrame, config: NearConfig = NearConfig()) -> Classes:
    prints = written(fingerprints(docs, config), "prints")
    nodes = prints.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("key", F.struct("rep.doc_id", "rep.tie").alias("rep"), "n", "bands"), "nodes")
    slots = nodes.select(F.explode("bands").alias("bucket"), "key", "n")
    shared = slots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(slots.join(shared, "bucket"), "buckets")
    near = nodes.select("key", "n", "rep")

    reach = buckets.groupBy("key").agg(F.sum("members").alias("reach"))
    ranked = buckets.join(reach, "key")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("reach", F.col("key").alias("hub"), F.col("n").alias("hub_n"))).alias("top")).select("bucket", "top.hub", "top.hub_n")
    alike = lambda x, y: F.least(x, y) >= config.threshold * F.greatest(x, y)  # noqa: E731  sizes of sets that can be so similar
    order = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = buckets.join(hubs, "bucket").where((F.col("key") != F.col("hub")) & alike(F.col("n"), F.col("hub_n")))
    first = written(first.select(*order(F.col("key"), F.col("hub"))).distinct(), "pairs")

    # the texts of nodes that share a bucket with a node of about their size
    wanted = written(near.join(reach.select("key"), "key", "left_semi").select("key", "rep.doc_id", "rep.tie"), "wanted")
    sets = written(shingle_sets(docs, wanted, config.width), "sets")
    links = written(verified(first, sets, config.threshold), "found")
    labels = components(links)

    # what is left: nodes that share a bucket with one of another class
    classed = buckets.join(labels, "key", "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    classed = written(classed, "classed")
    split = classed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rest = classed.join(split, "bucket").join(hubs.select("bucket", "hub", "hub_n"), "bucket").where("key <> hub").select("hub", "hub_n", "key", "label", "n").distinct()
    rest = written(rest, "rest")
    more = written(outside_pairs(rest, sets, config.threshold).join(first, ["a", "b"], "left_anti"), "pairs")
    late = written(verified(more, sets, config.threshold), "found")
    if not late.isEmpty():
        labels = components(links.union(late))
    return Classes(prints, near, labels)


def _by_class(found: Classes) -> tuple[DataFrame, DataFrame]:
    """key with its label, and label with its first row."""
    keys = found.nodes.join(found.labels, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    return keys, keys.groupBy("label").agg(F.min(F.struct(F.col("rep.doc_id").isNull(), "rep")).alias("m")).select("label", F.col("m.rep").alias("first"))


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id) and text_id (the smallest doc_id with the same words) of every row."""
    found = classes(docs, config)
    keys, firsts = _by_class(found)
    table = keys.join(firsts, "label").select("key", F.col("first.doc_id").alias("class_id"), F.col("rep.doc_id").alias("text_id"))
    rows = found.prints.select("doc_id", "key")
    some = rows.where("key IS NOT NULL").join(table, "key").select("doc_id", "class_id", "text_id")
    none = rows.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"))
    return some.unionByName(none)


def drop_near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """The rows of docs with a null text, and one row of each class: that with the smallest id."""
    found = classes(docs, config)
    _, firsts = _by_class(found)
    kept = written(firsts.select(F.col("first.doc_id").alias("__d"), F.col("first.tie").alias("__t")), "kept")
    null = found.prints.where("key IS NULL").select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t")).distinct()
    repeated = not found.prints.where("key IS NOT NULL").groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
    rows = docs.withColumn("__tie", F.xxhash64("text"))

    def those(of: DataFrame) -> DataFrame:
        return joined(rows, of, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__tie") == F.col("__t")), "left_semi", fits_broadcast(of, 32))

    out = those(kept)
    if repeated:
        out = out.dropDuplicates(["doc_id", "__tie"])
    return out.unionByName(those(null)).select(*columns_of(docs))
