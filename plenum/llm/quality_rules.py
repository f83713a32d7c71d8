"""Quality rules: word, symbol and repetition counts, and bands of zstandard ratios.

A text is compressed whole and in chunks of fixed size.  Its ratio (compressed bytes to bytes) must lie in a band that
depends on its length, as short texts compress badly: below the band it is repetitive, above it incompressible.  A text
fails the chunk rule if more than half of its chunks leave the chunk band.  The chunks cover every byte of a text that
has one at least: what is left after the last whole chunk is judged by a chunk that ends with the text.  A text shorter
than a chunk is judged whole only.

Null and empty texts have no words, and so fail the base rule.  Texts shorter than the first band have no ratio to judge.
A very long text is judged by all of its bytes, repeated rows each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: From so many bytes on, the ratio must be at least the second and at most the third value.
BANDS = (
    (128, 0.38, 1.02),
    (256, 0.38, 0.95),
    (512, 0.36, 0.90),
    (1024, 0.34, 0.85),
    (2048, 0.32, 0.82),
    (4096, 0.30, 0.80),
    (8192, 0.28, 0.78),
    (16384, 0.26, 0.78),
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    repeat_words: int = 3
    symbols: str = "#*$%&|<>"
    level: int = 3
    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (0.22, 0.85)
    max_bad_chunks: float = field(default=0.5)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long, verdict string"
)


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text has twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, reach = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + width - max(reach, i)
            reach = i + width
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    counts = Counter(lines)
    if len(counts) == len(lines):
        return 0
    return sum(n - 1 for line, n in counts.items() if n > 1 and line.encode("utf-8", "surrogatepass").split())


class _Judge:
    def __init__(self, rules: QualityRules):
        self.rules = rules
        self.compress = zstandard.ZstdCompressor(level=rules.level, write_content_size=False, write_checksum=False).compress
        self.strip = bytes(c for c in range(256) if chr(c) not in rules.symbols)

    def band(self, size: int) -> tuple[float, float] | None:
        fitting = [b for b in self.rules.bands if size >= b[0]]
        return fitting[-1][1:] if fitting else None

    def __call__(self, doc_id, text: str | None) -> tuple:
        r = self.rules
        raw = (text or "").encode()
        words = raw.split()
        n = len(words)
        chars = sum(map(len, words)) if raw.isascii() else len(b"".join(words).decode())
        repeats = repeated_words(words, r.repeat_words)
        failed = n < r.min_words or 100 * repeats > r.max_repeat_percent * n
        ratio = len(self.compress(raw)) / len(raw) if raw else None
        verdict, chunks, bad = "in band", 0, 0
        band = self.band(len(raw))
        if band:
            verdict = "repetitive" if ratio < band[0] else "incompressible" if ratio > band[1] else verdict
        if len(raw) >= r.chunk_bytes:
            starts = list(range(0, len(raw) - r.chunk_bytes + 1, r.chunk_bytes))
            if len(raw) % r.chunk_bytes:
                starts.append(len(raw) - r.chunk_bytes)
            for at in starts:
                own = len(self.compress(raw[at : at + r.chunk_bytes])) / r.chunk_bytes
                chunks += 1
                bad += not r.chunk_band[0] <= own <= r.chunk_band[1]
            if verdict == "in band" and bad > r.max_bad_chunks * chunks:
                verdict = "chunks out of band"
        return doc_id, n, chars, len(raw.translate(None, self.strip)), duplicate_lines(text or ""), repeats, failed, not failed and verdict == "in band", ratio, chunks, bad, verdict


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row with counts, base rule and verdict for every row of docs; other columns, whatever their names, aren't read."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, schema = _Judge(rules), None
        for batch in sliced(batches, "text"):
            rows = [judge(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            schema = schema or pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunks", pa.int64()), ("bad_chunks", pa.int64()), ("verdict", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(judged, SCHEMA)
