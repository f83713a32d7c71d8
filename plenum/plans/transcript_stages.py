"""The transcript stages, each by itself or all: ingest, clean, rules, aggregate.  A stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import text as tx
from ..operators.scoring import beside
from ..sources import files as fs

STAGES = ("ingest", "clean", "rules", "aggregate")
RAW = fs.RECORD + ", seq long"
FLAGS = "struct<too_short:boolean,too_long:boolean,non_english:boolean>"
CLEAN = RAW + f", transcript_clean string, sentences array<string>, quality_flags {FLAGS}"
MATCH = "struct<principle:string,polarity:string,target:string,action:string,evidence_span:string,char_start:int,char_end:int,confidence:double>"
EXTRACTED = CLEAN + f", matched_keywords array<string>, is_on_topic boolean, principles array<{MATCH}>, rule_confidence double, needs_llm boolean"


def numbered(records: DataFrame) -> DataFrame:
    """Records with seq, their place by file and row."""
    part = Window.partitionBy("source_xlsx").orderBy("row_index")
    rows = records.withColumn("n", F.row_number().over(part))
    files = rows.groupBy("source_xlsx").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("source_xlsx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each workbook
    return rows.join(files.select("source_xlsx", before.alias("before")), "source_xlsx").withColumn("seq", F.col("before") + F.col("n")).drop("n", "before")


def summary(extracted: DataFrame) -> DataFrame:
    """One row: totals, documents by year, counts of principles, actions and targets, and the best examples."""
    totals = extracted.agg(F.count("*").alias("docs_total"), F.count_if("is_on_topic").alias("on_topic"), F.count_if(~F.col("is_on_topic")).alias("off_topic"))
    records = extracted.drop("principles", "matched_keywords", "is_on_topic", "rule_confidence", "needs_llm")
    years, counts = tx.topic_counts(records)
    entries = lambda k, v: F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v))))
    by_year = years.agg(entries(F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("k"), F.col("docs").alias("v")).alias("docs_by_year"))
    named = counts.groupBy("kind").agg(entries("name", "n").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("counts"))
    best = tx.examples(records).groupBy("principle").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "span"))), lambda x: x["span"]).alias("spans"))
    best = best.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("principle", "spans")))).alias("examples"))
    return beside(totals, by_year, named, best)


def run(spark: SparkSession, input_dir: str, out_dir: str, stage: str = "all") -> DataFrame:
    """Runs one stage, or all; gives the summary where there is an aggregate, and else the number of documents."""
    if stage not in (*STAGES, "all"):
        raise ValueError(f"no stage {stage}")
    out, does = out_dir.rstrip("/"), lambda name: stage in ("all", name)
    if does("ingest"):
        fs.write_json_lines(numbered(fs.transcripts(spark, input_dir)), f"{out}/raw")
    rows = fs.json_lines(spark, f"{out}/raw", RAW)
    if does("clean"):
        fs.write_json_lines(tx.first_of_equal(tx.cleaned(rows)), f"{out}/clean")
    if stage != "ingest":
        rows = fs.json_lines(spark, f"{out}/clean", CLEAN)
    if does("rules"):
        fs.write_json_lines(tx.extracted(rows), f"{out}/rule_extracted")
    if stage in ("all", "rules", "aggregate"):
        rows = fs.json_lines(spark, f"{out}/rule_extracted", EXTRACTED)
    if not does("aggregate"):
        return rows.agg(F.count("*").alias("docs_total"))
    total = summary(rows)
    fs.write_json_lines(total.coalesce(1), f"{out}/summary")
    years = sorted(r.year for r in rows.where("year IS NOT NULL").select("year").distinct().collect())  # the years of the file names
    if years:
        fs.write_csv(tx.principle_by_year(rows.drop("principles"), years), f"{out}/principle_by_year")
    return spark.read.json(f"{out}/summary")
