"""The registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import license_scan as ls
from . import near_dedup as nd
from . import quality_classifier as qc
from . import quality_rules as qr
from . import secrets as sc
from . import source_mix as sm
from . import token_counts as tc
from . import token_files as tf
from . import url_filter as uf
from .common import table, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in documents by patience alignment, a row for each text and license found.

    Null, empty and blank texts, and an empty table, give no rows; repeated rows and equal ids give rows of their own; long
    texts are scanned whole; of equal windows the first counts, of equal templates the one listed first.
    """
    return ls.license_scan(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as token files, read back: a row for each document.

    Null and empty texts are the end id alone; null ids come first; equal ids are in the order of a hash of their texts,
    repeated rows beside each other; long texts are one document; an empty table gives no rows.
    """
    return tf.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, a row for each document.

    Null and empty texts have no spans; equal starts are in the order of kinds; repeated rows have the same spans each and
    count each in the false-discovery control; long texts are scanned whole; an empty table gives no rows.
    """
    return sc.secret_digest(sc.secrets(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and compression bands of documents, a row for each document.

    Null, empty and blank texts have no words and fail; repeated rows are judged each by itself; long texts are judged by all
    their bytes; an empty table gives no rows.
    """
    return qr.quality_rules(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources of documents takes of each document, a row for each.

    Null sources are the last source; null, empty and blank texts have size 0 and nothing is taken; repeated rows and equal
    ids are documents of their own; a long text is taken block by block; an empty table gives no rows.
    """
    return sm.mix_report(sm.mix(table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents, a row for each document.

    Null and empty texts are scored by their statistics, as all texts; null ids are never held out; repeated rows are scored
    alike; equal labels of an id count once, unequal ones under each; without labels every score is 0.5; long texts are
    measured whole; an empty table gives no rows.
    """
    stats = written(qc.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = qc.quality_model(stats, table(spark, sf_dir, "labels"))
    scored = qc.score_quadratic(stats, model)
    return scored.select("doc_id", qc.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of pages, a row for each page.

    Null URLs, and those without ://, have an empty host and path and fit no rule; of fitting rules the longest wins;
    repeated rows are judged alike and count each in the models; long URLs count with all their characters; an empty table
    gives no rows.
    """
    return uf.url_filter(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents, a row for each document.

    Null texts are classes of their own, equal texts without words one class; a text of fewer than five words is one
    shingle; repeated rows and equal ids are classed by their texts; the least id names a class; long texts have all their
    shingles; an empty table gives no rows.
    """
    return nd.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark in documents, a row for each text and item it holds.

    Null, empty and blank texts and items match nothing; equal items are found each, repeated rows each for itself; of equal
    passages the first counts; long texts are searched whole; an empty table on either side gives no rows.
    """
    return dc.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of documents, a row for each document.

    Null and empty texts have no tokens; of equally good segmentations the one whose last piece begins first counts, as in
    the tokenizers library; repeated rows are counted each; long texts are counted whole; an empty table gives no rows.
    """
    return tc.token_counts(table(spark, sf_dir, "documents"), tc.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents; what each does with odd rows stands there."""
    import corpus_pipeline  # it imports tokenizer_path from here

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_files": op2_token_files,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mix": op5_source_mix,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_url_filter": op7_url_filter,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}
