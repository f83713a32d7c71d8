"""Token ids in binary files, packed by Simple-8b.

Null and empty texts are the end id alone; a very long text is one document of its block, however many ids it has; equal
texts and repeated rows are documents of their own, in the order of their ids, then of a hash of the text (null ids come
first).  An empty table gives files without blocks, and no rows.  Other columns, whatever their names, aren't read.

A 64-bit word holds a selector in its low four bits and, above it, as many ids of equal width as the selector says.
Selectors 0 and 1 stand for runs of zeros, 15 for one value of 60 bits; there the all-ones value is an escape, and the
true value is the next of the block's escapes.  A document always begins at a new word.  A block is a row of a Parquet
file: whole documents in order, with ids and lengths, the packed words, the escapes, the word at which each document
begins, and how many ids its shard holds before it, so that any document or block is decoded by itself.

Spark's own committer writes the files, so a task that is run again never leaves a half-written shard.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import batched, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, sliced, sums_before, worker_kept

#: Ids and bits an id, by selector (fixed values of the coding).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
SMALL_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

#: Byte-level BPE's own split (fixed), for characters that every version of Unicode takes for the same; a line feed stands between words.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", r"!-/:-@\[-`{-~"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n")
UNSURE = re.compile(rf"[^{LETTERS}0-9{MARKS} \n]")
#: The characters that byte-level BPE has for the bytes (fixed): printing ones stay, others follow from 256 on; the line feed, which no piece has, stays here.
PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = "".join("\n" if b == 10 else chr(b if b in PRINTING else 256 + b - sum(p < b for p in PRINTING)) for b in range(256))

BLOCK = "shard int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, word_at array<long>, words binary, escapes binary"


def pack(values: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of runs of ids (all one run unless lengths are given), the escapes, and the word at which each run begins.

    Greedy: at each place the selector that takes most ids, of those that fit their bits and stay inside the run.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    ends = np.cumsum([n] if lengths is None else lengths)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    # np.frexp rounds above 2^53, where only the widest selector is left
    if values.max() < len(SMALL_BITS):
        bits, escaped = SMALL_BITS[values], np.zeros(n, bool)
    else:
        bits, escaped = np.frexp(values.astype(np.float64))[1].astype(np.uint8), values >= np.uint64(ESCAPE)
        bits[values >= np.uint64(1 << 53)] = 60
    # no selector asks for more than 240
    left = np.minimum(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n), 255).astype(np.uint8)
    choice = np.full(n, 15, np.uint8)
    span, reach = bits, 1  # span[i]: most bits in values[i : i + reach]
    for s in range(14, -1, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        while reach < count:
            step = min(reach, count - reach)
            span = np.maximum(span[: len(span) - step], span[step:])
            reach += step
        fits = (span <= np.uint8(WIDTHS[s])) & (left[: len(span)] >= np.uint8(count))
        np.minimum(choice[: len(fits)], np.where(fits, np.uint8(s), np.uint8(15)), out=choice[: len(fits)])
        if s < 10 and span.min() > WIDTHS[s]:  # narrower selectors ask for more ids of fewer bits
            break
    steps, starts, i = COUNTS.astype(np.uint8)[choice].tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64)
    held = np.where(escaped, np.uint64(ESCAPE), values) if escaped.any() else values
    for s in range(2, 16):
        at = np.flatnonzero(chosen == s)
        if len(at):
            place, part = starts[at], words[at]
            for k in range(int(COUNTS[s])):
                part |= held[place + k] << np.uint64(4 + k * int(WIDTHS[s]))
            words[at] = part
    return words, values[escaped], np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of packed words, a selector at a time."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    chosen = (words & np.uint64(15)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(COUNTS[chosen])]).astype(np.int64)
    out = np.zeros(begin[-1], np.uint64)
    for s in range(2, 16):
        at = np.flatnonzero(chosen == s)
        if len(at):
            shift = np.uint64(4) + np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            out[begin[at][:, None] + np.arange(COUNTS[s])] = (words[at][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
    out[out == np.uint64(ESCAPE)] = escapes
    return out


class _Kept(dict):
    """Slots of strings; a slot is a part of a pool of ids.  When it holds too many, the half that most batches asked for stays."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep = keep
        # slot 0: strings without ids of their own
        self.start, self.size, self.uses, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def slots(self, strings: list[str]) -> np.ndarray:
        if len(self) > self.keep:
            self.trim()
        out = np.fromiter(map(self.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = list(dict.fromkeys([strings[i] for i in missing.tolist()]))
            self.learn(new)
            out[missing] = np.fromiter(map(self.__getitem__, [strings[i] for i in missing.tolist()]), np.int64, len(missing))
        self.uses[out] += 1
        return out

    def learn(self, strings: list[str]) -> None:
        raise NotImplementedError

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.start)
        self.update(zip(strings, range(n, n + len(strings)), strict=True))
        self.start = np.append(self.start, len(self.pool) + np.cumsum(sizes) - sizes)
        self.size, self.pool = np.append(self.size, sizes), np.append(self.pool, ids)
        self.uses = np.append(self.uses, np.zeros(len(strings), np.int64))

    def trim(self) -> None:
        most = np.argsort(-self.uses[1:], kind="stable")[: self.keep // 2] + 1
        stays = np.zeros(len(self.start), bool)
        stays[most] = True
        slot = np.cumsum(stays) * stays
        moved = slot[np.fromiter(self.values(), np.int64, len(self))]
        left = list(compress(self, moved.tolist()))
        self.clear()
        self.update(zip(left, moved[moved > 0].tolist(), strict=True))
        stays[0] = True
        size = self.size[stays]
        self.pool = self.pool[np.repeat(self.start[stays] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, self.uses[stays] // 2


class _Pieces(_Kept):
    """Ids of pre-tokens, from the library's model."""

    def __init__(self, model, keep: int):
        super().__init__(keep)
        self.model = model
        self["\n"] = 0

    def trim(self) -> None:
        super().trim()
        self["\n"] = 0

    def learn(self, pieces: list[str]) -> None:
        shown = codecs.charmap_decode("\n".join(pieces).encode(), "strict", BYTE_CHARS)[0].split("\n")
        ids, sizes = array("I"), array("q")
        for some in batched(shown, 1024):
            found = list(map(self.model.tokenize, some))
            ids.extend([t.id for tokens in found for t in tokens])
            sizes.extend(map(len, found))
        self.add(pieces, np.array(ids, np.uint32), np.array(sizes, np.int64))


class _Words(_Kept):
    """Ids of words, each after a space or each after a line feed.  Those in slot 0 have other white space or an added token."""

    def __init__(self, encoder: WordEncoder, before: str, keep: int):
        super().__init__(keep)
        self.encoder, self.before = encoder, before

    def learn(self, words: list[str]) -> None:
        e = self.encoder
        joined = " ".join(words)
        if len(joined.split()) != len(words) or e.has_added(joined):
            strange = {w for w in words if w.split() != [w] or e.has_added(w)}
            self.update(dict.fromkeys(strange, 0))
            words = [w for w in words if w not in strange]
        if e.pieces is None:
            unsure = words
        elif UNSURE.search(joined):
            unsure = [w for w in words if UNSURE.search(w)]
            words = [w for w in words if not UNSURE.search(w)]
        else:
            unsure = []
        if e.pieces is not None and words:
            self.add(words, *self.by_pieces(words))
        for at in range(0, len(unsure), 512):
            some = unsure[at : at + 512]
            self.add(some, *self.in_one_text(some))

    def by_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        kept = self.encoder.pieces
        pieces = SPLIT.findall(self.before + self.before.join(words))
        slots = kept.slots(pieces)
        sizes = kept.size[slots]
        ids = kept.pool[np.repeat(kept.start[slots] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        begin = np.flatnonzero(np.fromiter(map(str.startswith, pieces, repeat(self.before)), bool, len(pieces)))
        return ids, np.add.reduceat(sizes, begin)

    def in_one_text(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same: the ids of each word begin at an id that only a separator gives."""
        e, space = self.encoder, self.before == " "
        ids = e.raw([self.before + self.before.join(words)])[0]
        begin = np.flatnonzero(e.spaced[ids] if space else ids == e.line_feed)
        if len(begin) == len(words):
            counts = np.diff(np.append(begin, len(ids)))
            return (ids, counts) if space else (np.delete(ids, begin), counts - 1)
        own = e.raw([" " + w if space else w for w in words])
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)


class WordEncoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, with the ids of frequent words kept.

    Its pre-tokens never reach over a single space or line feed between two other characters, so a text without other
    white space is the sequence of its words, each with the space before it; any other text is encoded as a whole.  So is
    a text that holds an added token of the vocabulary (<|endoftext|> and the like), which the library finds by itself.
    """

    def __init__(self, path: str, keep: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        #: an added token with white space, or found in normalised text, isn't seen in any word: then every text is encoded whole
        self.only_whole = any(t.split() != [t] for t in self.added) or self.tokenizer.normalizer is not None
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self.line_feed = int(self.raw(["\n"])[0][0])
        self.pieces = _Pieces(self.tokenizer.model, keep) if self.splits_plainly() else None
        self.inner, self.first = _Words(self, " ", keep), _Words(self, "\n", keep // 6)

    def splits_plainly(self) -> bool:
        """Whether the tokenizer is a BPE without chance, of pieces split as by SPLIT."""
        from tokenizers.models import BPE

        if not isinstance(self.tokenizer.model, BPE) or self.tokenizer.model.dropout or self.tokenizer.pre_tokenizer is None:
            return False
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        return split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False

    def has_added(self, words: str) -> bool:
        return any(t in words for t in self.added)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 64):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def __call__(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of every text, and the end id.  Null texts are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.only_whole:
            return [np.append(own, np.uint32(end)).astype("<u4") for own in self.raw(texts.to_pylist())]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        bounds = np.asarray(lists.offsets, np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        codes, table = np.asarray(words.indices, np.int64), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        feed = table.index("\n") if "\n" in table else -1
        # a word that begins a text or a line has no space before it
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        first[1:] |= codes[:-1] == feed
        heads = np.unique(codes[first])
        special = np.array([w in ("", "\n") for w in table])
        slots = np.zeros(len(table), np.int64)
        slots[~special] = self.inner.slots([w for w in table if w and w != "\n"])
        head_slots = np.zeros(len(heads), np.int64)
        head_slots[~special[heads]] = self.first.slots([w for k in heads if (w := table[k]) and w != "\n"])
        # an empty word: two spaces, or a space or line feed next to a line feed or an end of the text
        strange = np.concatenate([slots == 0, head_slots == 0])
        start = np.concatenate([self.inner.start[slots], self.first.start[head_slots] + len(self.inner.pool)])
        sizes = np.concatenate([self.inner.size[slots], self.first.size[head_slots]])
        pool = np.concatenate([self.inner.pool, self.first.pool, np.array([self.line_feed], np.uint32)])
        if feed >= 0:
            strange[feed], start[feed], sizes[feed] = False, len(pool) - 1, 1
        codes[first] = len(table) + np.searchsorted(heads, codes[first])
        lengths = sizes[codes]
        whole = np.add.reduceat(strange[codes].astype(np.int64), bounds[:-1]) > 0
        counts = np.add.reduceat(lengths, bounds[:-1])
        at = np.repeat(start[codes] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        out = np.full(len(at) + len(counts), end, "<u4")
        out[np.arange(len(at)) + np.repeat(np.arange(len(counts)), counts)] = pool[at]
        ends = np.cumsum(counts + 1)
        ids = [out[b - n - 1 : b] for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        odd = np.flatnonzero(whole).tolist()
        for i, own in zip(odd, self.raw([texts[i].as_py() for i in odd]), strict=True):
            ids[i] = np.append(own, np.uint32(end)).astype("<u4")
        return ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, shards: int, end_id: int = 0, block_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, and writes shards in ascending order of ids (null ids first, ties by a hash of the text).

    Null texts are empty ones: the end id alone.  A block ends with the document that fills it.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        encoder = worker_kept(("encoder", tokenizer), lambda: WordEncoder(tokenizer))
        held: list[tuple] = []
        ids = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, ids
            lengths = [len(v) for _, v in held]
            words, escapes, at = pack(np.concatenate([v for _, v in held]), np.array(lengths))
            row = [[shard], [block], [first], [ids], [[d for d, _ in held]], [lengths], [at], [words.astype("<u8").tobytes()], [escapes.astype("<u8").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            block, first, held, ids = block + 1, first + ids, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in sliced(batches, "text", limit=5 << 20):
            for doc_id, values in zip(batch.column(0).to_pylist(), encoder(batch.column(1), end_id), strict=True):
                held.append((doc_id, values))
                ids += len(values)
                if ids >= block_ids:
                    yield flush()
        if held:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(shards, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(encoded, BLOCK).write.option("compression", "snappy").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and place of every document, all from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                words, escapes = (np.frombuffer(column[c][i].as_buffer(), "<u8") for c in ("words", "escapes"))
                lengths = np.asarray(column["lengths"][i].values, dtype=np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(unpack(words, escapes).astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                shard, block = (np.full(n, column[c][i].as_py(), np.int32) for c in ("shard", "block"))
                yield pa.RecordBatch.from_arrays([column["doc_ids"][i].values, pa.array(shard), pa.array(block), pa.array(column["first"][i].as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "shard", "block", "in_shard", "n_tokens", "ids_crc32"])

    files = spark.read.schema(BLOCK).parquet(path)
    docs = files.mapInArrow(decoded, "doc_id long, shard int, block int, in_shard long, n_tokens long, ids_crc32 long")
    # one row for a shard, that is for a file of many MB
    before = sums_before(files.groupBy("shard").agg(F.sum("n_ids").alias("ids")), [], "shard", "ids", "before").select("shard", "before")
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def shard_count(docs: DataFrame, rows: int = 20_000) -> int:
    """A shard for so many rows at most, and for each task of the session at least."""
    session = docs.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, shards: int | None = None, **options) -> DataFrame:
    """Writes and reads back; path: a new one in the shared folder unless given."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_token_files(docs, path, tokenizer, shards or shard_count(docs), **options)
    return read_token_files(spark, path)
