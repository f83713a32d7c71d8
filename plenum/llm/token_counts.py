"""Token counts of a unigram tokenizer without its tokens: an Aho-Corasick automaton and a Viterbi that carries counts.

The automaton lists the vocabulary's pieces that end at each character.  For each end, the best score and the number of
pieces on that path are kept, and nothing else.  Ties go to the piece that begins first, as in the tokenizers library,
whose Unigram model reaches an end from earlier beginnings first and replaces only a lower score.  A character that is
no piece by itself may be unknown, at the least score less ten; it then counts as its UTF-8 bytes if all bytes are
pieces, and otherwise a run of unknown characters is one token.

Text is cut where no piece can reach over: before a space mark that follows another character, if no piece has one
inside, and around line feeds, if no longer piece has one.  Counts of parts are kept, as words recur.

The public vocabularies hold no unigram model.  piece_bpe_32k.model's pieces and scores are read as one; what is exact
is the count of the tokenizers library's Unigram over that vocabulary, without the model file's normaliser.

Null and empty texts have no tokens.  A very long text is counted whole, in parts; repeated rows each for itself, and an
empty table gives no rows.  Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, worker_kept

SPACE = "▁"
PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool
    prefix: bool = True


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Vocabulary(tuple((p.piece, p.score) for p in model.pieces), model.trainer_spec.byte_fallback, model.normalizer_spec.add_dummy_prefix)


class Counter(dict):
    """Counts by part of a text; keeps those of the last two generations of `keep` parts."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000):
        import ahocorasick

        super().__init__()
        self.keep, self.old = keep, {}
        scores = dict(vocabulary.pieces)
        automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self.iter = automaton.iter
        self.unknown = min(scores.values()) - PENALTY
        self.bytes = vocabulary.byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        self.prefix = vocabulary.prefix
        long = [p for p in scores if len(p) > 1]
        if not self.bytes or any(SPACE in p.lstrip(SPACE) for p in long):
            self.parts = lambda text: [text]
        elif any("\n" in p for p in long):
            self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        else:
            self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def __missing__(self, part: str) -> int:
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        n = self.old.get(part)
        if n is None:
            n = self.viterbi(part)
        if len(part) < 100:
            self[part] = n
        return n

    def viterbi(self, text: str) -> int:
        n = len(text)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list | None] = [None] * n
        for end, piece in self.iter(text):
            if ends[end] is None:
                ends[end] = [piece]
            else:
                ends[end].append(piece)
        for end in range(n):
            top, tokens, single, run = float("-inf"), 0, False, False
            longest = 0
            for length, score in ends[end] or ():
                value = best[end + 1 - length] + score
                if value > top or (value == top and length > longest):
                    top, tokens, longest = value, count[end + 1 - length] + 1, length
                single = single or length == 1
            if not single:
                value = best[end] + self.unknown
                if value > top:
                    top, run = value, True
                    tokens = count[end] + (len(text[end].encode()) if self.bytes else int(not open_run[end]))
            best[end + 1], count[end + 1], open_run[end + 1] = top, tokens, run
        return count[n]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.parts((SPACE if self.prefix else "") + text.replace(" ", SPACE))))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_kept(("counter", hash(vocabulary)), lambda: Counter(vocabulary))
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.tokens(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(counted, "doc_id long, n_tokens long")
