"""License scan: patience alignment of texts with license templates.

Words are lower-cased and stripped of punctuation.  A window of a text is aligned with a template: words that are unique
in both sides are anchors, the longest increasing run of them is kept, and the gaps between anchors are aligned in the
same way; a gap without anchors keeps a longest common subsequence.  Coverage is the share of the template's words that
are aligned.  A template is found if its coverage reaches the threshold and the words that it must have are aligned.

Windows have the template's length and some slack on both sides, and are laid at its rarest words.  These are so many
that an alignment which has none of them would miss the threshold, so no window that reaches it is passed over; what
can't have enough of the template's words, counted with repeats, isn't aligned.

A row is returned for each text and license found: the best window, the first of equal ones, and the number of windows
that reach the threshold.  Where windows of two templates overlap, the one with more aligned words stays, then the one
with more coverage, then the template listed first.

Null, empty and blank texts match nothing; a very long text is scanned whole; repeated rows give repeated rows, equal ids
rows of their own.  An empty table gives no rows.  Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .license_texts import TEMPLATES, Template


@dataclass(frozen=True)
class LicenseConfig:
    templates: tuple[Template, ...] = TEMPLATES
    threshold: float = 0.8
    slack: float = 0.25


_EDGES = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    return _EDGES.sub("", word).lower()


def plain_words(text: str | None) -> list[str]:
    return [plain(w.decode()) for w in (text or "").encode().split()]


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    where: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = where[p - 1] if p else -1
        tops[p : p + 1], where[p : p + 1] = [v], [i]
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every beginning of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in a and b: halves of a are given the parts of b that serve them best.

    Memory grows with the sum of the lengths, not with their product.
    """
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in side], np.int64) for side in (a, b))
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i >= i_end or j >= j_end:
            continue
        if i_end - i == 1:
            at = np.flatnonzero(y[j:j_end] == x[i])
            if len(at):
                out.append((i, j + int(at[0])))
            continue
        middle = (i + i_end) // 2
        sums = _last_row(x[i:middle], y[j:j_end]) + _last_row(x[middle:i_end][::-1], y[j:j_end][::-1])[::-1]
        cut = j + int(np.argmax(sums))
        todo += [(i, middle, j, cut), (middle, i_end, cut, j_end)]
    return sorted(out)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal words in a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        if i >= i_end or j >= j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at_b = {w: j + k for k, w in enumerate(b[j:j_end]) if in_b[w] == 1 and in_a.get(w) == 1}
        unique = [(i + k, at_b[w]) for k, w in enumerate(a[i:i_end]) if w in at_b]
        anchors = [unique[k] for k in increasing([y for _, y in unique])]
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
        elif in_a.keys() & in_b.keys():
            out += [(i + x, j + y) for x, y in common(a[i:i_end], b[j:j_end])]
    return sorted(out)


@dataclass(frozen=True)
class _Known:
    """A template in numbers of words."""

    name: str
    words: list[int]
    must: frozenset[int]
    need: int
    slack: int
    seeds: dict[int, list[int]]  # places of the words of which any alignment has one
    own: np.ndarray  # whether a number is one of its words; the last is for all other words


class Scanner:
    """Scans texts whose words are numbers in `vocab`; other words are -1."""

    def __init__(self, config: LicenseConfig):
        self.config = config
        texts = [[w for w in plain_words(t.text) if w] for t in config.templates]
        self.vocab = {w: k for k, w in enumerate(sorted({w for words in texts for w in words}))}
        n = len(self.vocab)
        self.counts = np.zeros((len(texts), n + 1), np.int64)
        self.templates: list[_Known] = []
        for k, (template, words) in enumerate(zip(config.templates, texts, strict=True)):
            numbers = [self.vocab[w] for w in words]
            np.add.at(self.counts[k], numbers, 1)
            need = max(1, math.ceil(config.threshold * len(words) - 1e-9))
            # long words are taken for rare ones; what is rare decides the speed only
            rare = sorted(template.must or set(words), key=lambda w: (-len(w), w))
            seeds: dict[int, list[int]] = {}
            for w in rare:
                seeds[self.vocab[w]] = [q for q, x in enumerate(words) if x == w]
                if template.must or sum(map(len, seeds.values())) > len(words) - need:
                    break
            must = frozenset(self.vocab[w] for w in template.must)
            self.templates.append(_Known(template.name, numbers, must, need, max(3, int(config.slack * len(words))), seeds, self.counts[k] > 0))
        self.need = np.array([t.need for t in self.templates])
        self.is_seed = np.zeros(n + 1, bool)
        for t in self.templates:
            self.is_seed[list(t.seeds)] = True

    def align(self, codes: np.ndarray, k: int) -> list[tuple[float, int, int, int]]:
        """coverage, words aligned, begin and end of every window that qualifies, none of them inside another."""
        t, size = self.templates[k], len(codes)
        m, reach, found = len(t.words), 0, []
        at = [(int(p), int(p) - q) for w, places in t.seeds.items() for p in np.flatnonzero(codes == w) for q in places]
        if not at:
            return found
        at = np.unique(np.array(at), axis=0)
        lo, hi = np.maximum(0, at[:, 1] - t.slack), np.minimum(size, at[:, 1] + m + t.slack)
        inside = np.concatenate([[0], np.cumsum(t.own[codes])])
        enough = inside[hi] - inside[lo] >= t.need
        at, lo, hi = at[enough], lo[enough], hi[enough]
        tried: set[tuple[int, int]] = set()
        i = 0
        while i < len(at):
            p, best = at[i, 0], None
            while i < len(at) and at[i, 0] == p:
                window = (max(int(lo[i]), reach), int(hi[i]))
                i += 1
                if p >= reach and window not in tried:
                    tried.add(window)
                    hit = self.window(codes, k, *window)
                    best = max(filter(None, (best, hit)), key=lambda h: (h[1], -h[2]), default=None)
            if best:
                # laid at a word before or after its own place, a window may lack an edge of the passage
                again = self.window(codes, k, max(reach, best[2] - t.slack), min(size, best[3] + t.slack))
                best = again if again and again[1] > best[1] else best
                found.append(best)
                reach = best[3]
        return found

    def window(self, codes: np.ndarray, k: int, lo: int, hi: int) -> tuple[float, int, int, int] | None:
        t, own = self.templates[k], codes[lo:hi]
        bag = np.bincount(own[own >= 0], minlength=len(self.vocab) + 1)
        if np.minimum(bag, self.counts[k]).sum() < t.need:
            return None
        pairs = patience(own.tolist(), t.words)
        if len(pairs) < t.need or not t.must <= {t.words[j] for _, j in pairs}:
            return None
        return len(pairs) / len(t.words), len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1

    def scan(self, codes: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """name, coverage, begin, end and windows of every license in a text."""
        bag = np.bincount(codes[codes >= 0], minlength=len(self.vocab) + 1)
        spans = []
        for k in np.flatnonzero(np.minimum(bag, self.counts).sum(axis=1) >= self.need):
            spans += [(-n, -coverage, int(k), begin, end) for coverage, n, begin, end in self.align(codes, int(k))]
        best: dict[str, list] = {}
        taken: list[tuple[int, int]] = []  # in order, none over another
        for _, minus, k, begin, end in sorted(spans):
            place = bisect_left(taken, (begin, end))
            before = place == 0 or taken[place - 1][1] <= begin
            if before and (place == len(taken) or end <= taken[place][0]):
                insort(taken, (begin, end))
                best.setdefault(self.templates[k].name, []).append((minus, begin, end))
        return [(name, -min(s)[0], *min(s)[1:], len(s)) for name, s in sorted(best.items())]


def license_scan(docs: DataFrame, config: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, first and end word, and windows: a row for each text and license found in it."""
    schema = "doc_id long, license string, coverage double, begin_word long, end_word long, windows long"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(config)
        for batch in sliced(batches, "text"):
            lists = pc.ascii_split_whitespace(batch.column(1).cast(pa.large_string()).fill_null(""))
            offsets = np.asarray(lists.offsets, np.int64)
            words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            offsets = offsets - offsets[0]
            table = np.fromiter((scanner.vocab.get(w.lower() if w.isalpha() else plain(w), -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            full = np.asarray(pc.binary_length(words.dictionary)) > 0
            numbers = np.asarray(words.indices)
            codes, kept = (table[numbers], full[numbers]) if len(words) else (np.zeros(0, np.int64), np.zeros(0, bool))
            codes, offsets = codes[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]
            rows = []
            for k in np.unique(np.searchsorted(offsets, np.flatnonzero(scanner.is_seed[codes]), side="right") - 1):
                rows += [(batch.column(0)[int(k)].as_py(), *found) for found in scanner.scan(codes[offsets[k] : offsets[k + 1]])]
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scanned, schema)
