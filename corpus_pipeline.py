"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, token files; each stage on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import decontaminate, near_dedup, quality_classifier, source_mix, token_files
from plenum.llm.common import table, written
from plenum.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learnt from the labelled ones that aren't held out, takes for label 1.

    Null and empty texts are scored like any others; repeated rows stay or go together; without labels all stay; long texts
    are measured whole; an empty table stays empty.  Other columns are carried along, whatever their names.
    """
    labels = table(spark, sf_dir, "labels")
    # statistics are joined with labels, so that no text is
    stats = written(quality_classifier.document_statistics(docs), "statistics")
    return quality_classifier.keep_quality(docs, quality_classifier.quality_model(stats, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id, null ids last.

    Null texts all stay; of equal texts without words one stays, of repeated rows one.  Long texts are compared by all their
    shingles; an empty table stays empty.  Other columns are carried along, whatever their names.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark.

    Null, empty and blank texts stay, and without items all do; repeated rows stay or go together; long texts are searched
    whole; an empty table stays empty.  Other columns are carried along, whatever their names.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and epoch, with the text that it gives to the mix.

    Documents without words (null, empty, blank) give none; null sources are the last source; repeated rows are documents of
    their own; a long text is given block by block; an empty table stays empty.  Other columns are carried along.
    """
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mix, from its token files.

    Null and empty texts are the end id alone; rows with equal ids are in the order of a hash of their texts; long texts are
    one document each; an empty table gives no rows.
    """
    return token_files.token_files(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixture),
    ("token files", tokens),
]

#: Fits, signatures, random draws and encodings aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
