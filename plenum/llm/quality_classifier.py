"""Quality classifier: a regularised quadratic discriminant over transformed statistics of documents.

Each class has a normal density over the statistics.  Its covariance is shrunk towards the pooled covariance and a multiple
of the identity; the Cholesky factors of both classes are computed once, on the driver, and sent with the tasks.  A score
is the posterior probability of label 1 from the difference of the log densities (Mahalanobis distances and log
determinants), tempered by the logistic scale and offset that fit the labelled rows best.

Fitting moves sums only: counts, sums and sums of products by class, and a histogram of the differences of fixed size.
Without labels of both classes every score is 0.5 or the single class's own side.  Null and empty texts have statistics
like any others, and get a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, sliced
from .quality_rules import duplicate_lines, repeated_words

STATISTICS = ("words", "word_length", "distinct", "symbols", "shouted", "digits", "marks", "dup_lines", "repeats", "ratio")
_SYMBOLS = bytes(c for c in range(256) if chr(c) not in "#*$%&|<>{}[]\\^~@=+_/")
_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
_MARKS = bytes(c for c in range(256) if chr(c) not in ".,;:!?")
_SHOUT = re.compile(rb"[A-Z]{2,}")


def _logit(part: float, whole: float, weight: float) -> float:
    """The log odds of a share, drawn to one half by `weight` rows of each kind."""
    return float(np.log((part + weight) / (max(whole - part, 0) + weight)))


def statistics(text: str | None, compress) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    inner = sum(map(len, words))
    log_n = float(np.log1p(n))
    # compressed size against what a text of this length usually has: the ratio falls with the logarithm of the length
    packed = np.log((len(compress(raw)) + 8) / (len(raw) + 8)) if raw else 0.0
    lines = 1 + (text or "").count("\n")
    return [
        log_n,
        float(np.log((inner + 5) / (n + 1))),
        _logit(len(set(words)), n, 1) + 0.5 * log_n,
        _logit(len(raw.translate(None, _SYMBOLS)), inner, 0.5) + float(np.log(inner + 1)) * 0.5,
        _logit(len(_SHOUT.findall(raw)), n, 0.5) + 0.5 * log_n,
        _logit(len(raw.translate(None, _DIGITS)), inner, 0.5) + float(np.log(inner + 1)) * 0.5,
        _logit(len(raw.translate(None, _MARKS)), inner, 1),
        float(np.sqrt(duplicate_lines(text or "") / (lines + 8))),
        float(np.sqrt(repeated_words(words) / (n + 60))),
        float(packed + 0.06 * np.log(len(raw) + 64)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the statistics of every row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches, "text"):
            rows = [statistics(t, compress) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(measured, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Quadratic:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1; then scale and offset of the logit."""

    means: np.ndarray
    whiten: np.ndarray
    log_dets: np.ndarray
    log_prior: float
    scale: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) + log P(1) - log p(x | 0) - log P(0), row by row."""
        if not len(self.means):
            return np.full(len(x), self.log_prior)
        d = [-0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return d[1] - d[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.difference(x) + self.offset, -30, 30)))


def _moments(labelled: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count("*").cast("double"), *(F.sum(F.col("x")[i]) for i in range(d)), *(F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs)]
    out = {}
    for row in labelled.groupBy("label").agg(F.array(*sums).alias("m")).collect():  # two rows
        m = np.array(row["m"])
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, m[1 + d :], strict=True):
            second[i, j] = second[j, i] = v
        out[row["label"]] = (m[0], m[1 : 1 + d] / m[0], second / m[0])
    return out


def fit_quadratic(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02, bins: int = 4000, reach: float = 400.0) -> Quadratic:
    """Fits to rows of label (0 or 1) and x.  shrink: weight of the pooled covariance; ridge: of the mean variance's identity."""
    d = len(STATISTICS)
    moments = _moments(labelled, d)
    n0, n1 = (moments.get(c, (0.0,))[0] for c in (0, 1))
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if min(n0, n1) < 2:
        return Quadratic(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), prior if n0 + n1 else 0.0)
    covs = [moments[c][2] - np.outer(moments[c][1], moments[c][1]) for c in (0, 1)]
    pooled = (n0 * covs[0] + n1 * covs[1]) / (n0 + n1)
    whiten, dets = [], []
    for n, cov in zip((n0, n1), covs, strict=True):
        weight = min(1.0, shrink + d / n)
        mixed = (1 - weight) * cov + weight * pooled
        mixed = (1 - ridge) * mixed + ridge * np.diag(np.diag(pooled)) + 1e-6 * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Quadratic(np.array([moments[0][1], moments[1][1]]), np.array(whiten), np.array(dets), prior)
    return _tempered(model, labelled, bins, reach)


def _tempered(model: Quadratic, labelled: DataFrame, bins: int, reach: float) -> Quadratic:
    """Scale and offset by Newton steps on a histogram of the differences, in bins evenly spaced in arsinh."""
    edge = float(np.arcsinh(reach))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = np.arcsinh(model.difference(_matrix(batch.column(1))))
                at = np.clip((u + edge) / (2 * edge) * bins, 0, bins - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], names=["label", "bin"])

    rows = labelled.select("label", "x").mapInArrow(binned, "label int, bin long").groupBy("label", "bin").count().collect()  # at most 2 * bins
    counts = np.zeros((2, bins))
    for r in rows:
        counts[r["label"], r["bin"]] += r["count"]
    value = np.sinh((np.arange(bins) + 0.5) / bins * 2 * edge - edge)
    total, beta = counts.sum(axis=0), np.array([0.3, 0.0])
    design = np.stack([value, np.ones(bins)])
    start = np.array([0.3, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        gradient = design @ (counts[1] - total * p) - 1e-3 * (beta - start) * total.sum()
        hessian = (design * (total * p * (1 - p))) @ design.T + 1e-3 * np.eye(2) * total.sum()
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
    scale = float(max(beta[0], 1e-3))
    return Quadratic(model.means, model.whiten, model.log_dets, model.log_prior, scale, float(beta[1]))


def _matrix(column: pa.Array) -> np.ndarray:
    d = len(STATISTICS)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def score_quadratic(stats: DataFrame, model: Quadratic) -> DataFrame:
    """doc_id and score of every row of document_statistics()."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """label and x of rows that aren't held out; a document with both labels counts under each, repeated rows once."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct()
    return stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("label", "x")


def quality_model(stats: DataFrame, labels: DataFrame, **options) -> Quadratic:
    return fit_quadratic(training_rows(stats, labels), **options)


def keep_quality(docs: DataFrame, model: Quadratic, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of `least` at least, as they are; no row is moved."""

    def good(texts: pa.Array) -> np.ndarray:
        compress = zstandard.ZstdCompressor(level=3).compress
        return model.score(np.array([statistics(t, compress) for t in texts.to_pylist()])) >= least

    return filtered(docs, good)
