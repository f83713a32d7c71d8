"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of every training text.

Passages are windows of words, each twice as long as the longest item and half covering the next, so that an item which
a text holds lies in one of them whole.  Impacts are divided by the score that an item has as its own query: 1 says that
a passage has all its terms.  Postings are in item order, cut into blocks that carry their greatest impact, on two levels.
Sums of block maxima over whole batches of passages rule out most of them at once; the rest run block-max WAND one by
one, which yields every item at or above the threshold.  Hits are verified.  What the passage has of the question is the
share of its runs of five words or, if that is more, of its words less the fewest words to change, drop or insert that make
it a stretch of the passage; of the answer, the share of its words.  Each must be enough, or lack a few words only while the
whole item has enough; an answer of no more than these few words therefore decides nothing by itself.

An item's answer is its last sentence or line, its question what comes before; an item of one sentence is cut in half.

Null, empty and blank items and texts match nothing; an empty benchmark leaves all texts.  Items with equal texts are
reported each, repeated rows of texts each for itself.  A very long text is searched whole, passage by passage.  Where two
passages of a text hold an item, the row is the first with the best score.  Other columns, whatever their names, aren't
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, sliced, written


@dataclass(frozen=True)
class LeakConfig:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.7
    block: int = 2
    coarse: int = 16
    light: float = 0.1
    width: int = 5
    question: float = 0.8
    answer: float = 0.8
    whole: float = 0.8
    few: int = 3
    min_window: int = 64
    slab_bytes: int = 16 << 20


_EDGES = re.compile(r"^\W+|\W+$")


def term(word: str) -> str:
    return _EDGES.sub("", word).lower()


def terms(text: str | None) -> list[str]:
    return [t for w in (text or "").encode().split() if (t := term(w.decode()))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if terms(p)]
    if len(parts) > 1:
        return terms(" ".join(parts[:-1])), terms(parts[-1])
    words = terms(text)
    return words[: -(-len(words) // 2)], words[-(-len(words) // 2) :]


def runs(words: list[str], width: int) -> set[tuple[str, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def edits(words: list[str], passage: list[str]) -> int:
    """The fewest words to change, drop or insert that make words a stretch of the passage."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([numbers.get(w, -1) for w in passage], np.int64)
    places = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, np.int64)
    for w in words:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (codes != numbers[w]))
        row = np.minimum.accumulate(step - places) + places
    return int(row.min())


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark, whatever part of it an index holds: items with terms, their mean length, the longest one's
    words, and in how many items a term is that isn't in one only."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


def statistics_of(texts: list[str | None]) -> Statistics:
    held = [(t, ts) for t in texts if (ts := terms(t))]
    df = {t: k for t, k in Counter(t for _, ts in held for t in set(ts)).items() if k > 1}
    return Statistics(len(held), sum(len(ts) for _, ts in held) / max(len(held), 1), max((len(t.encode().split()) for t, _ in held), default=1), df)


class Postings:
    """Items of each term in order, with impacts, and the greatest impact of each block of items that has the term.

    Lists lie end to end; nothing is held for a block without the term.
    """

    def __init__(self, term: np.ndarray, item: np.ndarray, impact: np.ndarray, terms_: int, block: int):
        order = np.lexsort((item, term))
        self.item, self.impact = item[order].astype(np.int32), impact[order].astype(np.float32)
        self.at = np.searchsorted(term[order], np.arange(terms_ + 1))
        self.blocks, self.block_at, self.block_max = self.maxima(block)
        self.term_max = np.maximum.reduceat(self.impact, self.at[:-1]) if len(self.item) else np.zeros(0, np.float32)

    def maxima(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.item):
            return np.zeros(0, np.int32), np.zeros(len(self.at), np.int64), np.zeros(0, np.float32)
        block = self.item // size
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[self.at[1:-1]] = True
        begin = np.flatnonzero(new)
        return block[begin], np.searchsorted(begin, self.at), np.maximum.reduceat(self.impact, begin)


class Index:
    """Postings with block maxima.  items: (item_id, text), those without terms left out."""

    def __init__(self, items: list[tuple[int, str]], config: LeakConfig, known: Statistics | None = None):
        self.config = config
        self.items = [(i, t) for i, t in items if terms(t)]
        known = known or statistics_of([t for _, t in self.items])
        n = known.items
        own_terms = [Counter(terms(t)) for _, t in self.items]
        self.vocab = {t: k for k, t in enumerate(sorted({t for ts in own_terms for t in ts}))}
        term_, item_, impact_ = [], [], []
        for k, ts in enumerate(own_terms):
            norm = config.k1 * (1 - config.b + config.b * ts.total() / known.mean)
            impact = np.array([np.log(1 + (n - (d := known.df.get(t, 1)) + 0.5) / (d + 0.5)) * f * (config.k1 + 1) / (f + norm) for t, f in ts.items()])
            term_ += [self.vocab[t] for t in ts]
            item_ += [k] * len(ts)
            impact_ += (impact / impact.sum()).tolist()
        self.postings = Postings(np.array(term_, np.int64), np.array(item_, np.int64), np.array(impact_), len(self.vocab), config.block)
        self.coarse, self.coarse_at, self.coarse_max = self.postings.maxima(config.coarse)
        self.coarse_blocks = -(-len(self.items) // config.coarse)
        #: the terms with the least maxima: all together they add no more than light to a score, so that bounds do without them
        top = self.postings.term_max
        order = np.argsort(top, kind="stable")
        sums = np.cumsum(top[order], dtype=np.float64)
        few = int(np.searchsorted(sums, config.light, side="right"))
        self.heavy = np.ones(len(self.vocab) + 1, bool)
        self.heavy[order[:few]] = False
        self.heavy[-1] = False
        self.light = float(sums[few - 1]) if few else 0.0
        self.window = max(config.min_window, 2 * known.longest)
        parts = [question_and_answer(t) for _, t in self.items]
        self.asked = [q for q, _ in parts]
        self.questions = [runs(q, config.width) for q, _ in parts]
        self.answers = [Counter(a) for _, a in parts]

    def possible(self, term: np.ndarray, passage: np.ndarray, passages: int) -> np.ndarray:
        """Whether the maxima of a passage's distinct heavy terms sum up, in any block, to what an item needs: in large
        blocks first, and where they do in small ones."""
        p = self.postings
        out = self._reaching(term, passage, passages, self.coarse, self.coarse_at, self.coarse_max, self.coarse_blocks)
        left = np.flatnonzero(out)
        some = out[passage]
        number = np.cumsum(out) - 1
        out[left] = self._reaching(term[some], number[passage[some]], len(left), p.blocks, p.block_at, p.block_max, -(-len(self.items) // self.config.block))
        return out

    def _reaching(self, term: np.ndarray, passage: np.ndarray, passages: int, blocks: np.ndarray, block_at: np.ndarray, maxima: np.ndarray, n_blocks: int) -> np.ndarray:
        out = np.zeros(passages, bool)
        floor = self.config.threshold - self.light - 1e-4
        step = max(1, (1 << 20) // max(n_blocks, 1))  # sums of so many passages at a time, in bounded memory
        edges = np.searchsorted(passage, np.arange(0, passages + step, step))
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            t, first = term[lo:hi], k * step
            n = block_at[t + 1] - block_at[t]
            place = np.repeat(block_at[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat((passage[lo:hi] - first) * n_blocks, n) + blocks[place]
            many = min(step, passages - first)
            sums = np.bincount(key, weights=maxima[place], minlength=many * n_blocks)
            out[first : first + many] = (sums.reshape(many, -1) >= floor).any(axis=1)
        return out

    def wand(self, query: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms of a query is the threshold at least: block-max WAND."""
        floor, size, p = self.config.threshold - 1e-6, self.config.block, self.postings
        lists = [(p.item[p.at[t] : p.at[t + 1]], p.impact[p.at[t] : p.at[t + 1]], float(p.term_max[t]), p.blocks[p.block_at[t] : p.block_at[t + 1]], p.block_max[p.block_at[t] : p.block_at[t + 1]]) for t in query]
        at = [0] * len(lists)
        end = len(self.items)
        here = [int(ids[0]) for ids, *_ in lists]  # the item at which each list stands

        def most(j: int, block: int) -> float:
            blocks, maxima = lists[j][3], lists[j][4]
            k = int(np.searchsorted(blocks, block))
            return float(maxima[k]) if k < len(blocks) and blocks[k] == block else 0.0

        order = sorted(range(len(lists)), key=here.__getitem__)
        found = []
        while order:
            bound, pivot = 0.0, -1
            for k, j in enumerate(order):
                if here[j] == end:
                    break
                bound += lists[j][2]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == item:
                pivot += 1
            ahead = order[: pivot + 1]
            block = item // size
            if sum(most(j, block) for j in ahead) >= floor:
                if here[order[0]] == item:
                    score = sum(float(lists[j][1][at[j]]) for j in ahead)
                    if score >= floor:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:  # no item of this block can do; go to the next block, or to the next list's item if that comes first
                target = min((block + 1) * size, here[order[pivot + 1]] if pivot + 1 < len(order) else end)
                target = max(target, item + 1)
            for j in ahead:
                if here[j] < target:
                    at[j] = int(np.searchsorted(lists[j][0], target))
                    here[j] = int(lists[j][0][at[j]]) if at[j] < len(lists[j][0]) else end
            order.sort(key=here.__getitem__)
        return found

    def overlaps(self, item: int, words: list[str]) -> tuple[float, float]:
        have, bag = runs_of(words, self.config.width, self.questions[item]), Counter(words)
        q = len(have) / max(len(self.questions[item]), 1)
        if self.questions[item] and q < 1:
            q = max(q, 1 - edits(self.asked[item], words) / len(self.asked[item]))
        wanted = self.answers[item]
        a = sum(min(n, bag[t]) for t, n in wanted.items()) / max(sum(wanted.values()), 1)
        return (q if self.questions[item] else 1.0), (a if wanted else 1.0)

    def held(self, item: int, q: float, a: float) -> bool:
        config, asked, answered = self.config, len(self.asked[item]), sum(self.answers[item].values())
        lacks_q, lacks_a = (1 - q) * asked, (1 - a) * answered
        enough = lambda share, least, lacks: share >= least - 1e-9 or lacks <= config.few + 1e-9
        return enough(q, config.question, lacks_q) and enough(a, config.answer, lacks_a) and lacks_q + lacks_a <= (1 - config.whole) * (asked + answered) + 1e-9


def runs_of(words: list[str], width: int, wanted: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    width = len(next(iter(wanted))) if wanted else width
    return wanted & {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _terms_of(texts: pa.Array, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers (-1: not in the index) of all words of all texts, and each text's bounds."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    full = np.asarray(pc.binary_length(words)) > 0
    encoded = words.dictionary_encode()
    # most words are letters only, and need no stripping
    table = np.fromiter((vocab.get(w.lower() if w.isalpha() else term(w), -1) for w in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
    kept = np.concatenate([[0], np.cumsum(full)])
    codes = np.asarray(encoded.indices)
    return (table[codes[full]] if len(codes) else np.zeros(0, np.int64)), kept[bounds]


def find_in_batch(ids: list, texts: pa.Array, index: Index) -> list[tuple]:
    numbers, bounds = _terms_of(texts, index.vocab)
    window, stride = index.window, index.window // 2
    counts = np.diff(bounds)
    passages = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - window) // stride)), 0)
    owner = np.repeat(np.arange(len(counts)), passages)
    if not len(owner) or not index.items:
        return []
    begin = bounds[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(passages) - passages, passages)) * stride
    until = np.minimum(begin + window, bounds[owner + 1])
    heavy = np.flatnonzero(index.heavy[numbers])
    lo, hi = np.searchsorted(heavy, begin), np.searchsorted(heavy, until)
    # passages with their distinct heavy terms
    n = hi - lo
    place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    both = np.unique(np.repeat(np.arange(len(owner)), n) * len(index.vocab) + numbers[heavy[place]])
    possible = index.possible(both % len(index.vocab), both // len(index.vocab), len(owner))
    best: dict[tuple[int, int], tuple] = {}
    cached: tuple[int, list[str]] = (-1, [])
    for p in np.flatnonzero(possible):
        query = np.unique(numbers[begin[p] : until[p]])  # repeated words count once
        query = query[query >= 0]
        hits = index.wand(query.tolist())
        if not hits:
            continue
        doc = int(owner[p])
        if cached[0] != doc:
            cached = (doc, [term(w.decode()) for w in texts[doc].as_py().encode().split()])
        first = int(begin[p] - bounds[doc])
        margin = window // 8  # what insertions push over a passage's edges
        words = [t for t in cached[1][max(0, first - margin) : first + window + margin] if t]
        for item, score in hits:
            q, a = index.overlaps(item, words)
            if index.held(item, q, a):
                if (doc, item) not in best or best[doc, item][2] < score:
                    best[doc, item] = (index.items[item][0], first, score, q, a)
    return [(ids[doc], item_id, first, score, q, a) for (doc, _), (item_id, first, score, q, a) in best.items()]


def global_statistics(items: DataFrame) -> Statistics:
    """As statistics_of, by Spark; terms that are in one item only aren't listed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if ts := terms(text):
                    yield pa.RecordBatch.from_pydict({"term": [None, *sorted(set(ts))], "n": [len(ts)] + [1] * len(set(ts)), "words": [len(text.encode().split())] + [0] * len(set(ts))})

    rows = items.mapInArrow(counted, "term string, n long, words long").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"), F.max("words").alias("longest"))
    rows = written(rows, "terms")
    own = rows.where("term IS NULL").first()
    if own is None:
        return Statistics(0, 0.0, 1, {})
    return Statistics(own.df, own.n / own.df, own.longest, {r.term: r.df for r in rows.where("term IS NOT NULL AND df > 1").toLocalIterator()})


def indexes(benchmark: DataFrame, config: LeakConfig) -> Iterator[Broadcast]:
    """Indexes, broadcast, of at most `slab_bytes` of text each.

    A larger benchmark is split by a hash, and each part is a pass of its own over the texts.  Scores don't depend on the
    split, as all parts have the statistics of the whole.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slabs = -(-size // config.slab_bytes)
    known = global_statistics(items) if slabs > 1 else None
    for slab in range(slabs):
        part = items if slabs == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slabs)) == slab)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield spark.sparkContext.broadcast(Index(rows, config, known))


def leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """doc_id, item_id, word (where the passage begins), score, question and answer overlap: a row for each text and item it holds."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, word long, score double, question double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(indexes(benchmark, config)):

        def found(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text", limit=3 << 20):
                rows = find_in_batch(batch.column(0).to_pylist(), batch.column(1), index.value)
                if rows:
                    columns = zip(*rows, strict=True)
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "word", "score", "question", "answer"])

        rows = source.mapInArrow(found, schema)
        out = rows if not k else out.unionByName(rows)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of docs in which no item was found, as they are; no row is moved."""
    for index in indexes(benchmark, config):

        def clean(texts: pa.Array, index=index) -> np.ndarray:
            kept = np.ones(len(texts), bool)
            kept[[r[0] for r in find_in_batch(list(range(len(texts))), texts, index.value)]] = False
            return kept

        docs = filtered(docs, clean, limit=3 << 20)
    return docs
