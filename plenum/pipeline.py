"""The stages end to end: transcripts, scenes, graphs, training, evaluation, prediction, each of which may be skipped.

What turns a point cloud into a layout, and what writes about predictions, are programs of their own; they are given as
functions.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocab
from .operators import encoding as en
from .operators import model as md
from .operators import scoring as sc
from .operators import sync as sy
from .operators import training as tr
from .plans import scene_graph as sg
from .plans import transcript_stages as ts
from .sources import files as fs
from .sources import layout as ly

#: From the path of a point cloud to the text of its layout.
Detector = Callable[[str], str]
#: From prompts (room, prompt) to answers (room, answer).
Writer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    out: str
    transcripts: str | None = None
    clouds: tuple[str, ...] = ()
    layouts: str | None = None
    checkpoint: str | None = None
    skip: frozenset[str] = frozenset()
    train: tr.TrainConfig = field(default_factory=tr.TrainConfig)


STAGES = ("transcripts", "spatial", "graph", "train", "eval", "predict")


def _scenes(spark: SparkSession, o: Options, detector: Detector | None) -> None:
    """A scene document in a folder of each layout's name."""
    if o.layouts:
        rows = ly.scan(spark, o.layouts).withColumn("room", F.regexp_replace(F.url_decode(F.element_at(F.split("room", "/"), -1)), r"\.[^.]*$", ""))
    elif o.clouds and detector:
        texts = [(fs_stem(p), detector(p)) for p in o.clouds]  # one for each cloud that was named
        rows = ly.lines(spark.createDataFrame(texts, "room string, layout string"))
    else:
        raise ValueError("scenes need layouts, or clouds and a detector; or skip them")
    documents = ly.scene_documents(ly.parsed(rows.withColumn("room", fs.safe_stem(F.col("room")))))
    documents.select("room", F.to_json("scene").alias("value")).write.mode("overwrite").partitionBy("room").text(f"{o.out}/scenes")


def fs_stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _graphs(spark: SparkSession, o: Options) -> DataFrame:
    """Graph documents of all scenes; gives room, document and error."""
    texts = spark.read.text(f"{o.out}/scenes", wholetext=True).select("room", F.lit(None).cast("string").alias("source"), F.col("value").alias("text"))
    made = sy.settled(sg.built(texts.withColumn("room", F.col("room").cast("string"))))
    made.where("document IS NOT NULL").select("room", F.col("document").alias("value")).write.mode("overwrite").partitionBy("room").text(f"{o.out}/graphs")
    return made


def _learning(spark: SparkSession, o: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Node vectors, edge vectors, teacher cells and graph scores of the graph documents; and their rooms by name."""
    graphs = sy.settled(fs.graphs(spark, f"{o.out}/graphs"))
    names = graphs.select(F.xxhash64("room").alias("room"), F.col("room").alias("name"))
    parts = {k: sy.settled(v) for k, v in fs.graph_tables(graphs.withColumn("room", F.xxhash64("room"))).items() if k != "zones"}
    null = F.lit(None).cast("double")
    kind = F.col("kind")
    nodes = parts["nodes"].withColumn("type", F.when(kind.isin("zone", "room"), kind).otherwise(en.node_type(kind))).withColumns({c: null for c in ("centroid_x", "centroid_y", "area")})
    vectors = sy.settled(en.node_vectors(nodes))
    types = vectors.select("room", "id", "node_type")
    edges = sy.settled(en.edge_vectors(parts["edges"], types, reverse=True))
    taught = en.teacher_rows(parts["principle_checks"], types)
    return vectors, edges, sy.settled(en.teacher_cells(taught, ["ord"])), sy.settled(en.graph_scores(taught)), names


def _importance(spark: SparkSession, o: Options):
    import numpy as np

    if not fs.exists(spark, f"{o.out}/transcripts/summary"):
        return np.ones(len(vocab.PRINCIPLES))
    counts = spark.read.schema("counts map<string,map<string,long>>").json(f"{o.out}/transcripts/summary").select(F.explode(F.col("counts")["principle"]).alias("principle", "n"))
    return np.array([r.weight for r in en.principle_weights(spark, counts).orderBy("principle_ix").collect()])


def run(spark: SparkSession, o: Options, detector: Detector | None = None, writer: Writer | None = None) -> dict[str, DataFrame]:
    """Runs the stages that aren't skipped, in order; gives a table for each: summary, graphs, history, metrics, predictions, extras."""
    unknown = o.skip - set(STAGES)
    if unknown:
        raise ValueError(f"no stages {sorted(unknown)}")
    if o.skip >= set(STAGES) - {"transcripts"}:
        raise ValueError("nothing is left to run")
    out: dict[str, DataFrame] = {}
    if "transcripts" not in o.skip and o.transcripts:
        out["summary"] = ts.run(spark, o.transcripts, f"{o.out}/transcripts")
    if "spatial" not in o.skip:
        _scenes(spark, o, detector)
    if "graph" not in o.skip:
        out["graphs"] = _graphs(spark, o)
    if {"train", "eval", "predict"} <= o.skip:
        return out
    vectors, edges, cells, scores, names = _learning(spark, o)
    folder = f"{o.out}/model"
    if "train" not in o.skip:
        rooms = sy.settled(tr.examples(vectors, edges, cells, scores))
        done = tr.train(rooms, _importance(spark, o), o.train, (vectors, edges, cells, scores), folder)
        out["history"] = spark.createDataFrame([tr._log_row(h) for h in done.history], "epoch int, train_loss double, train_examples long, components map<string,double>, macro_f1 double, is_best boolean")
    checkpoint = o.checkpoint or f"{folder}/best"
    if {"eval", "predict"} <= o.skip:
        return out
    weights = tr.load(spark, checkpoint)
    if "eval" not in o.skip:
        out["metrics"] = tr.evaluate(vectors, edges, cells, scores, weights, o.train.model).withColumn("checkpoint", F.lit(checkpoint))
        fs.write_json_lines(out["metrics"], f"{o.out}/metrics")
    if "predict" not in o.skip:
        found = sy.settled(md.predictions(vectors, edges, weights, o.train.model))
        out["predictions"] = found.join(names, "room").select(F.col("name").alias("room"), "target", "principle", "status", "score", "graph_score")
        fs.write_json_lines(out["predictions"], f"{o.out}/predictions")
        if writer:
            out["extras"] = annotated(out["predictions"], writer)
            fs.write_json_lines(out["extras"], f"{o.out}/extras")
    return out


def annotated(predictions: DataFrame, writer: Writer) -> DataFrame:
    """What a writer says of the predictions of each room, completed from the predictions themselves."""
    numbered = predictions.withColumn("seq", F.struct("target", "principle"))
    scores = predictions.groupBy("room").agg(F.first("graph_score").alias("graph_score"))
    prompts = sc.report_prompt(sc.worst_by_principle(numbered), scores)
    return sc.completed_extras(writer(prompts), numbered, scores)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plenum", description="Transcripts, scenes, graphs, training, evaluation, prediction.")
    parser.add_argument("--out", required=True)
    parser.add_argument("--transcripts")
    parser.add_argument("--layouts")
    parser.add_argument("--checkpoint")
    parser.add_argument("--epochs", type=int, default=tr.TrainConfig.epochs)
    for stage in STAGES:
        parser.add_argument(f"--skip-{stage}", action="store_true")
    args = parser.parse_args(argv)
    skip = frozenset(s for s in STAGES if getattr(args, f"skip_{s}"))
    spark = SparkSession.builder.appName("plenum").getOrCreate()
    run(spark, Options(args.out, args.transcripts, (), args.layouts, args.checkpoint, skip, tr.TrainConfig(epochs=args.epochs)))
    return 0
