"""Transcripts: cleaning, sentences, keep-first dedup, phrase spans with actions and targets, topics, counts.

Built-in functions only.  Order is carried in seq, so that "first" means the same on every cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.arrays import let, sums_before
from ..functions.geometry import settled


@dataclass(frozen=True)
class TextConfig:
    principles: tuple[tuple[str, tuple[str, ...]], ...] = tuple(vocab.TEXT_PRINCIPLES.items())
    actions: tuple[str, ...] = vocab.ACTIONS
    targets: tuple[str, ...] = vocab.TARGETS
    topics: tuple[str, ...] = vocab.TOPICS
    avoid: tuple[str, ...] = vocab.AVOID
    window: int = 80
    short_words: int = 20
    long_words: int = 800
    english_least: float = 0.02
    english_from: int = 30
    examples: int = 10


def normalized(text: Column) -> Column:
    """Without bracket tags, with plain apostrophes, white space as single spaces (all of Unicode's)."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[(music|applause|laughter|noise)\]", " ")
    text = F.replace(text, F.lit("’"), F.lit("'"))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")


def sentences(text: Column) -> Column:
    """Parts after . ! ? and white space, without a sentence that equals the one before it but for case."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return let(parts, lambda p: F.filter(p, lambda s, i: (i == 0) | (F.lower(s) != F.lower(F.get(p, i - 1)))))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z']+"), F.lit(0))


def english_ratio(text: Column) -> Column:
    hits = lambda words: F.size(F.filter(words, lambda w: w.isin(*vocab.COMMON_ENGLISH)))
    return let(word_tokens(text), lambda words: F.when(F.size(words) == 0, 0.0).otherwise(hits(words) / F.size(words)))


def stable_id(url: Column, date: Column, title: Column, row_index: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (url, date, title, row_index))))


def cleaned(records: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """records with title and transcript_raw normalised, transcript_clean, sentences and quality_flags."""
    rows = records.withColumn("title", normalized(F.col("title"))).withColumn("transcript_raw", normalized(F.col("transcript_raw")))
    rows = settled(rows.withColumn("sentences", sentences(F.col("transcript_raw"))))
    rows = settled(rows.withColumn("transcript_clean", F.array_join("sentences", " ")))
    words = F.size(word_tokens(F.col("transcript_clean")))
    ratio = english_ratio(F.col("transcript_clean"))
    flags = F.struct((words < config.short_words).alias("too_short"), (words > config.long_words).alias("too_long"), ((ratio < config.english_least) & (words > config.english_from)).alias("non_english"))
    return rows.withColumn("quality_flags", flags)


def first_of_equal(records: DataFrame, seq: str = "seq") -> DataFrame:
    """The first record by seq of those with the same title and clean text, case aside."""
    w = Window.partitionBy(F.lower("title"), F.lower("transcript_clean")).orderBy(seq)
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def spans(text: Column, phrase: str) -> Column:
    """Starts of all occurrences that don't overlap: lengths of what lies between them, summed."""
    lengths = F.transform(F.split(text, "\\Q" + phrase + "\\E", -1), lambda p: F.char_length(p))
    size = len(phrase)

    def starts(n: Column) -> Column:
        steps = F.transform(F.slice(n, 1, F.size(n) - 1), lambda v: v + size)
        return F.transform(F.arrays_zip(sums_before(steps).alias("before"), steps.alias("step")), lambda x: (x["before"] + x["step"] - size).cast("int"))

    return F.when(F.contains(text, F.lit(phrase)), let(lengths, starts)).otherwise(F.array().cast("array<int>"))


def _first_word(window: Column, words: tuple[str, ...]) -> Column:
    found = F.filter(F.regexp_extract_all(window, F.lit("[a-zA-Z_'-]+"), F.lit(0)), lambda w: w.isin(*words))
    return F.get(found, F.lit(0))


def matches(records: DataFrame, config: TextConfig = TextConfig(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each phrase found in "title. transcript", lower-cased: principle, span, action, target, polarity, confidence."""
    full = F.lower(F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("transcript_clean", F.lit("")))))
    rows = settled(records.select(*keys, full.alias("text")))
    def located(k: int, principle: str, j: int, phrase: str) -> Column:
        def place(s: Column) -> Column:
            return F.struct(F.lit(principle).alias("principle"), F.lit(k).alias("principle_order"), F.lit(j).alias("phrase_order"), s.alias("char_start"), (s + len(phrase)).alias("char_end"))

        return F.transform(spans(F.col("text"), phrase.lower()), place)

    found = F.flatten(F.array(*(located(k, p, j, phrase) for k, (p, phrases) in enumerate(config.principles) for j, phrase in enumerate(phrases))))
    rows = rows.select(*keys, "text", F.inline(found))
    left = F.greatest(F.col("char_start") - config.window, F.lit(0))
    right = F.least(F.col("char_end") + config.window, F.char_length("text"))
    window = F.substring(F.col("text"), left + 1, right - left)
    rows = settled(rows.withColumn("window", window)).withColumn("evidence_span", F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("text")
    joined = F.array_join(F.regexp_extract_all("window", F.lit("[a-zA-Z_'-]+"), F.lit(0)), " ")
    action = _first_word(F.col("window"), config.actions)
    target = F.coalesce(_first_word(F.col("window"), config.targets), F.when(F.contains(joined, F.lit("living room")), "living_room"))
    avoid = F.lit(False)
    for word in config.avoid:
        avoid = avoid | F.contains("window", F.lit(word))
    rows = rows.withColumn("action", action).withColumn("target", target).withColumn("polarity", F.when(avoid, "avoid").otherwise("promote"))
    rows = settled(rows)
    score = F.least(F.lit(0.98), F.lit(0.75) + F.when(F.col("action").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("target").isNotNull(), 0.1).otherwise(0.0))
    return rows.withColumn("confidence", F.round(score, 3)).drop("window")


def topics(records: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """records with is_on_topic and matched_keywords (substrings of title and text, sorted)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("transcript_clean", F.lit(""))))
    found = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(k)), k) for k in sorted(set(config.topics)))))
    return records.withColumn("matched_keywords", found).withColumn("is_on_topic", F.size("matched_keywords") > 0)


def extracted(records: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """Cleaned records with topic, their matches in order, rule_confidence and needs_llm."""
    found = matches(records, config)
    order = ("principle_order", "phrase_order", "char_start")
    fields = ("principle", "polarity", "target", "action", "evidence_span", "char_start", "char_end", "confidence")
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("m")))).alias("l"), F.max("confidence").alias("best"))
    lists = lists.select("doc_id", F.transform("l", lambda x: x["m"]).alias("principles"), "best")
    rows = topics(records, config).join(lists, "doc_id", "left").withColumn("rule_confidence", F.coalesce("best", F.lit(0.0)))
    return rows.withColumn("needs_llm", F.col("is_on_topic") & F.col("principles").isNull()).drop("best")


def topic_counts(records: DataFrame, config: TextConfig = TextConfig()) -> tuple[DataFrame, DataFrame]:
    """Documents by year with on-topic ones; and (kind, name, n) of principles, actions and targets of on-topic documents."""
    rows = topics(records, config)
    years = rows.groupBy("year").agg(F.count("*").alias("docs"), F.count_if("is_on_topic").alias("on_topic"))
    found = matches(rows.where("is_on_topic"), config)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("principle", "action", "target")))
    counts = found.select(F.explode(kinds).alias("c")).where("c.name IS NOT NULL").groupBy("c.kind", "c.name").agg(F.count("*").alias("n"))
    return years, counts


def principle_by_year(records: DataFrame, years: list[int], config: TextConfig = TextConfig()) -> DataFrame:
    """A row for each principle, a column for each year, 0 where there is none.  years: the columns, which a plan must know."""
    found = matches(topics(records, config).where("is_on_topic"), config, ("doc_id", "year"))
    return found.groupBy("principle").pivot("year", years).count().na.fill(0).orderBy("principle")


def examples(records: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """The best distinct spans of each principle, highest confidence first, then the earliest."""
    found = matches(topics(records, config).where("is_on_topic"), config, ("seq",))
    found = found.withColumn("span", F.trim("evidence_span")).where("span <> ''")
    place = F.struct((-F.col("confidence")).alias("c"), "seq", "phrase_order", "char_start")
    once = found.groupBy("principle", "span").agg(F.min(place).alias("place"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("principle").orderBy("place", "span")))
    return ranked.where(F.col("rank") <= config.examples).select("principle", "rank", "span", (-F.col("place.c")).alias("confidence"))
