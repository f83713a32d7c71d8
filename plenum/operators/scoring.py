"""Predictions and teachers compared, and reports made of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def argmax(values: Column) -> Column:
    """The first place of the greatest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def expected_score(logits: Column, axis: tuple[float, ...] = vocab.STATUS_SCORES) -> Column:
    return F.aggregate(F.zip_with(softmax(logits), F.array(*(F.lit(a) for a in axis)), lambda p, a: p * a), F.lit(0.0), lambda s, v: s + v)


def status_counts(rows: DataFrame, key: str = "principle") -> DataFrame:
    """key, status, tp, fp, fn.  rows: key, predicted and actual statuses."""
    long = rows.select(key, F.explode(F.array(*(F.lit(s) for s in vocab.STATUSES))).alias("status"), "predicted", "actual")
    p, a = F.col("predicted") == F.col("status"), F.col("actual") == F.col("status")
    return long.groupBy(key, "status").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))


def f1_by_key(counts: DataFrame, key: str = "principle") -> DataFrame:
    """Mean F1 over the statuses that occur, for each key; supervised: labels."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    present = tp + fn > 0
    return counts.groupBy(key).agg((F.coalesce(F.sum(F.when(present, f1)), F.lit(0.0)) / F.greatest(F.count_if(present), F.lit(1))).alias("f1"), F.sum(tp + fn).alias("supervised"))


def macro_f1(by_key: DataFrame, keys: int) -> DataFrame:
    """The mean over all keys; those without rows count as 0."""
    return by_key.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / keys).alias("macro_f1"), F.sum("supervised").alias("supervised_cells"))


def mean_absolute(predicted: Column, actual: Column) -> Column:
    """Null where nothing is compared."""
    return F.avg(F.abs(predicted - actual))


def score_label(score: Column) -> Column:
    out = F.lit("Unknown")
    for low, name in reversed(vocab.SCORE_LABELS):
        out = F.when((score >= low) & (score < 1.01), name).otherwise(out)
    return out


def status_rank(status: Column) -> Column:
    return F.when(status == "violated", 0).when(status == "weak", 1).otherwise(2)


def impact(principle: Column) -> Column:
    out = F.lit("medium")
    for name, value in vocab.IMPACTS.items():
        out = F.when(principle == name, value).otherwise(out)
    return out


def worst_by_principle(predictions: DataFrame, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """The worst result that isn't good for each principle (status, then score, then order) and how many nodes it affects."""
    bad = predictions.where(F.col("status").isin("violated", "weak"))
    first = F.min(F.struct(status_rank(F.col("status")).alias("rank"), "score", "seq", "target", "status"))
    rows = bad.groupBy(*keys, "principle").agg(first.alias("w"), F.count("*").alias("affected_count"))
    return rows.select(*keys, "principle", "w.target", "w.status", "w.score", "affected_count")


def worst_by_node(predictions: DataFrame, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    rank = F.min(status_rank(F.col("status")))
    return predictions.groupBy(*keys, "target").agg(F.when(rank == 0, "violated").when(rank == 1, "weak").otherwise("good").alias("worst"))


def recommendations(predictions: DataFrame, most: int = 3, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """The first results that aren't good, as sentences."""
    rows = predictions.where(F.col("status").isin("violated", "weak")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    return rows.where(F.col("rank") <= most).select(*keys, "rank", F.format_string("Address the '%s' issue on %s.", "principle", "target").alias("recommendation"))


def ranked_violations(predictions: DataFrame, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    rows = predictions.where(F.col("status").isin("violated", "weak"))
    w = Window.partitionBy(*keys).orderBy("score", "seq")
    return rows.select(*keys, F.row_number().over(w).alias("rank"), "principle", "target", "status", "score", impact(F.col("principle")).alias("impact"))


def room_summary(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """A sentence for each room: score, its label, violations and warnings.  scores: room, graph_score."""
    counts = predictions.groupBy("room").agg(F.count_if(F.col("status") == "violated").alias("v"), F.count_if(F.col("status") == "weak").alias("w"))
    rows = scores.join(counts, "room", "left").na.fill(0, ["v", "w"])
    label = score_label(F.col("graph_score"))
    return rows.select("room", "graph_score", label.alias("overall_score_label"), F.format_string("Room score: %.2f (%s). %d violation(s) and %d warning(s) detected.", "graph_score", label, "v", "w").alias("summary"))


def report_prompt(worst: DataFrame, scores: DataFrame) -> DataFrame:
    """The table of worst results as text, for a writer of reports."""
    line = F.format_string("| %s | %s | %s | %.2f | %d node(s) |", "principle", "target", "status", "score", "affected_count")
    rows = worst.groupBy("room").agg(F.sort_array(F.collect_list(F.struct(status_rank(F.col("status")).alias("rank"), "score", "principle", line.alias("line")))).alias("l"))
    head = "| principle | worst_target | status | score | affected |\n|-----------|--------------|--------|-------|----------|\n"
    rows = scores.join(rows, "room", "left")
    table = F.when(F.col("l").isNull(), "All principles scored as good.").otherwise(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    return rows.select("room", F.concat(F.format_string("Room graph_score: %.2f (%s)\n\nNon-good principle results:\n", "graph_score", score_label(F.col("graph_score"))), table).alias("prompt"))


def rescued_json(text: Column) -> Column:
    """The outermost object in a model's text, null if it doesn't parse."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(part).isNotNull(), part)


def explanations(predictions: DataFrame, keys: tuple[str, ...] = ("room",)) -> DataFrame:
    """A sentence for each result that isn't good."""
    text = F.concat(F.initcap(F.replace("principle", F.lit("_"), F.lit(" "))), F.lit(" is "), F.col("status"), F.lit(" for "), F.col("target"), F.lit("."))
    return predictions.where(F.col("status").isin("violated", "weak")).select(*keys, "seq", "target", "principle", "status", F.coalesce("score", F.lit(0.0)).alias("score"), text.alias("text"))


_RANKED = "principle string, target string, score double, status string, impact string"
_EXPLAINED = "target string, principle string, status string, score double, text string"


def completed_extras(answers: DataFrame, predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """room, summary, recommendations, ranked_violations, explanations: a model's answer, or what predictions give where it has no such key.

    answers: room and answer, a text that may hold a JSON object; a key counts if it is a text that isn't blank, or a list.
    An impact that is missing is that of the principle.
    """
    read = answers.select("room", F.try_parse_json(rescued_json(F.col("answer"))).alias("v"))
    has = lambda key, kind: F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")).startswith(kind)
    listed = lambda schema: "array<struct<" + schema.replace(" ", ":").replace(",:", ",") + ">>"
    own = read.select(
        "room",
        F.when(has("summary", "STRING"), F.try_variant_get("v", "$.summary", "string")).alias("own_summary"),
        F.when(has("recommendations", "ARRAY"), F.try_variant_get("v", "$.recommendations", "array<string>")).alias("own_recommendations"),
        F.when(has("ranked_violations", "ARRAY"), F.try_variant_get("v", "$.ranked_violations", listed(_RANKED))).alias("own_ranked"),
        F.when(has("explanations", "ARRAY"), F.try_variant_get("v", "$.explanations", listed(_EXPLAINED))).alias("own_explanations"),
    )
    def lists(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        rows = df.groupBy("room").agg(F.sort_array(F.collect_list(F.struct(order, value.alias("v")))).alias("l"))
        return rows.select("room", F.transform("l", lambda x: x["v"]).alias(name))

    fields = lambda schema: F.struct(*(c.split()[0] for c in schema.split(", ")))
    rows = room_summary(predictions, scores).select("room", "summary").join(own, "room", "left")
    rows = rows.join(lists(recommendations(predictions), "rank", F.col("recommendation"), "r"), "room", "left")
    rows = rows.join(lists(ranked_violations(predictions), "rank", fields(_RANKED), "k"), "room", "left").join(lists(explanations(predictions), "seq", fields(_EXPLAINED), "e"), "room", "left")
    given = F.transform("own_ranked", lambda x: x.withField("impact", F.coalesce(x["impact"], impact(x["principle"]))))
    pick = lambda own, made, kind: F.coalesce(own, made, F.array().cast(kind))
    return rows.select(
        "room", F.when(F.trim("own_summary") != "", F.col("own_summary")).otherwise(F.col("summary")).alias("summary"),
        pick(F.col("own_recommendations"), F.col("r"), "array<string>").alias("recommendations"),
        pick(given, F.col("k"), listed(_RANKED)).alias("ranked_violations"), pick(F.col("own_explanations"), F.col("e"), listed(_EXPLAINED)).alias("explanations"),
    )


def beside(*tables: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = tables[0].withColumn("__k", F.lit(0))
    for other in tables[1:]:
        out = out.join(other.withColumn("__k", F.lit(0)), "__k")
    return out.drop("__k")


def evaluation(cells: DataFrame, graphs: DataFrame, principles: int = len(vocab.PRINCIPLES)) -> DataFrame:
    """One row: macro_f1, supervised_cells, score_mae, graph_mae, graphs and f1 by principle.

    cells: principle, predicted, actual (statuses), score and teacher_score of supervised cells; graphs: graph_score and target.
    """
    by = f1_by_key(status_counts(cells))
    per = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("principle", "f1")))).alias("per_principle_f1"))
    errors = cells.agg(mean_absolute(F.col("score"), F.coalesce("teacher_score", F.lit(0.0))).alias("score_mae"))
    whole = graphs.agg(mean_absolute(F.col("graph_score"), F.col("target")).alias("graph_mae"), F.count("*").alias("graphs"))
    return beside(macro_f1(by, principles), errors, whole, per)


def pooled(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, dim, mean and max of all vectors of a key."""
    long = vectors.select(key, F.posexplode(column).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy(key, "dim").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def attention(edges: DataFrame, dst: str, head: str, logit: str, value: str) -> DataFrame:
    """dst, head and the sum of values weighted by the softmax of logits over incoming edges, in two aggregates."""
    top = edges.groupBy(dst, head).agg(F.max(logit).alias("__top"))
    e = F.exp(F.col(logit) - F.col("__top"))
    return edges.join(top, [dst, head]).groupBy(dst, head).agg((F.sum(e * F.col(value)) / F.sum(e)).alias("out"))


def edge_scaling(edges: DataFrame, weight: str) -> DataFrame:
    """Every edge with its weight scaled to [0, 1] within its room; 0.5 where all weights are equal."""
    w = Window.partitionBy("room")
    low, high = F.min(weight).over(w), F.max(weight).over(w)
    return edges.withColumn("scaled", F.when(high == low, 0.5).otherwise((F.col(weight) - low) / (high - low)))


def undirected(edges: DataFrame, seq: list[str]) -> DataFrame:
    """The first edge of each type between two nodes, direction aside."""
    w = Window.partitionBy("room", F.least("src", "dst"), F.greatest("src", "dst"), "type").orderBy(*seq)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def running_best(epochs: DataFrame) -> DataFrame:
    """Epochs that beat all before them.  epochs: run, epoch, macro_f1."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return epochs.withColumn("is_best", F.coalesce(F.col("macro_f1") > F.max("macro_f1").over(before), F.lit(True)))
