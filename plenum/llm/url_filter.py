"""URL filter: rules first, then the ratio of two character language models.  DataFrame functions only.

The rules label the pages they fit; a model of accepted and one of rejected URLs are learnt from those.  A model is a
variable-order Markov chain: the chance of a character after its context is that of its count there, mixed with the
chance after the context without its first character in proportion to the number of different followers (Witten and
Bell), down to single characters and a uniform chance.  A URL's score is the difference of its log-likelihoods, divided
by its length with the end mark.  One labelled URL in five is kept from the counts; the threshold is the score that
separates those best.

Counts are taken once, for the longest runs; shorter ones are sums of them.  Likelihoods are worked out for every
different run, not for every place it occurs.  Places are then joined with runs: runs that make up more than a
thousandth of all places, of which there can't be more than a thousand, are broadcast, and all others shuffled.

Null URLs, and those without ://, have an empty host and path, fit no rule and are scored as the empty text.  Without
labelled URLs of both kinds the threshold is 0, and a URL that nothing speaks against is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

#: verdict, host and path of the contract's rules (fixed values).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass(frozen=True)
class UrlConfig:
    rules: tuple[tuple[str, str, str], ...] = RULES
    order: int = 4
    alphabet: float = 256.0
    held_out: int = 5
    frequent: float = 1e-3
    part: int = 512
    bins: int = 200


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEGIN, _END = "\u0002", "\u0003"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """verdict and rule of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _places(urls: DataFrame, config: UrlConfig) -> DataFrame:
    """uid, weights and the run of order + 1 characters that ends at each place of each URL, with the end mark's."""
    k = config.order
    whole = F.concat(F.lit(_BEGIN * k), "body", F.lit(_END))
    # long URLs in parts that overlap by the order, so that no substring is sought far into a text
    parts = urls.withColumn("whole", whole).withColumn("from", F.explode(F.sequence(F.lit(1), F.char_length("whole") - k, F.lit(config.part))))
    parts = parts.withColumn("piece", F.substring(F.col("whole"), F.col("from"), F.lit(config.part + k)))
    places = parts.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("piece") - k)))
    return places.select("uid", "accepted", "rejected", "weight", F.substring(F.col("piece"), F.col("at"), F.lit(k + 1)).alias("run"))


def run_scores(runs: DataFrame, config: UrlConfig) -> DataFrame:
    """run and diff, log P(last | others; accepted) - log P(...; rejected), for runs with counts accepted and rejected."""
    k = config.order
    levels = [runs]
    for _ in range(k):
        last = levels[-1]
        levels.append(last.groupBy(F.substring(F.col("run"), F.lit(2), F.lit(k + 1)).alias("run")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    below = None
    for level, counts in zip(range(k + 1), reversed(levels), strict=True):
        w = Window.partitionBy(F.substring("run", 1, level))  # as many rows as there are characters
        here = counts
        for c in ("accepted", "rejected"):
            here = here.withColumn(f"{c}_all", F.sum(c).over(w)).withColumn(f"{c}_kinds", F.sum((F.col(c) > 0).cast("double")).over(w))
        if below is None:
            here = here.withColumn("p_accepted", F.lit(1 / config.alphabet)).withColumn("p_rejected", F.lit(1 / config.alphabet))
        else:
            here = here.withColumn("tail", F.substring(F.col("run"), F.lit(2), F.lit(k + 1))).join(below, "tail")
        chance = {}
        for c in ("accepted", "rejected"):
            base, room = F.col(f"p_{c}"), F.col(f"{c}_all") + F.col(f"{c}_kinds")
            chance[c] = F.when(room > 0, (F.col(c) + F.col(f"{c}_kinds") * base) / room).otherwise(base)
        below = here.select(F.col("run").alias("tail"), chance["accepted"].alias("p_accepted"), chance["rejected"].alias("p_rejected"))
    return below.select(F.col("tail").alias("run"), (F.log("p_accepted") - F.log("p_rejected")).alias("diff"))


def _threshold(scored: DataFrame, config: UrlConfig) -> float:
    """The score that separates held-out labelled URLs with the best mean of both recalls; nearest to 0 of the best."""
    edge = 20 * config.bins
    bins = scored.where("held IS NOT NULL").groupBy(F.least(F.greatest(F.floor(F.col("score") * config.bins), F.lit(-edge)), F.lit(edge)).alias("bin")).agg(F.sum("held").alias("good"), F.sum(F.col("weight") - F.col("held")).alias("bad")).collect()  # at most 2 * edge + 1 rows
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0.0
    cuts = sorted({0, *(int(r["bin"]) for r in bins), *(int(r["bin"]) + 1 for r in bins)})
    value = lambda cut: sum(r["good"] for r in bins if r["bin"] >= cut) / good + sum(r["bad"] for r in bins if r["bin"] < cut) / bad
    return max(cuts, key=lambda cut: (round(value(cut), 12), -abs(cut))) / config.bins


def url_filter(pages: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) and threshold of every row."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    body = F.coalesce(F.regexp_extract("url", "(?s)://(.*)", 1), F.lit(""))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), config.rules))
    # equal URLs are scored once and counted as often as they occur
    urls = ruled.groupBy("url").agg(F.count("*").alias("weight"), F.first("found").alias("found")).withColumn("body", body)
    kept = F.pmod(F.xxhash64("url"), F.lit(config.held_out)) != 0
    is_good, is_bad = F.col("found.verdict") == "allow", F.col("found.verdict") == "block"
    urls = urls.select(
        F.monotonically_increasing_id().alias("uid"), "url", "body", "weight",
        F.when(is_good & kept, F.col("weight")).otherwise(0).cast("double").alias("accepted"),
        F.when(is_bad & kept, F.col("weight")).otherwise(0).cast("double").alias("rejected"),
        F.when(~kept & F.col("found").isNotNull(), F.when(is_good, F.col("weight")).otherwise(0)).alias("held"),
        F.col("found").isNull().alias("open"),
    )
    urls = written(urls, "urls")
    runs = written(_places(urls, config).groupBy("run").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("places")), "runs")
    scores = written(run_scores(runs.drop("places"), config).join(runs.select("run", "places"), "run"), "scores")
    total = scores.agg(F.sum("places")).first()[0] or 0
    often = F.col("places") >= max(1.0, config.frequent * total)
    hot, cold = scores.where(often).select("run", "diff"), scores.where(~often).select("run", "diff")

    asked = _places(urls.where("open OR held IS NOT NULL"), config).select("uid", "run")
    tagged = asked.join(F.broadcast(hot), "run", "left")  # at most 1 / frequent rows
    summed = tagged.where("diff IS NOT NULL").select("uid", "diff").unionByName(tagged.where("diff IS NULL").select("uid", "run").join(cold, "run").select("uid", "diff"))
    scored = summed.groupBy("uid").agg((F.sum("diff") / F.count("*")).alias("score"))
    scored = written(urls.join(scored, "uid", "left").select("url", "score", "weight", "held"), "scored")
    threshold = _threshold(scored, config)
    by_url = scored.select(F.col("url").alias("u"), F.col("score").alias("s"))
    out = ruled.join(by_url, F.col("url").eqNullSafe(F.col("u")))
    score = F.when(F.col("found").isNull(), F.col("s"))
    return out.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.when(F.col("s") >= threshold, "allow").otherwise("block")).alias("verdict"), score.alias("score"), F.lit(threshold).alias("threshold"))
