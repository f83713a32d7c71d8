"""Training of the attention model: AdamW, one room at a time.

An epoch is one Spark job.  Rooms are dealt to `workers` tasks in an order that changes with the epoch; each task goes
through its rooms from the common weights, and what tasks end with is averaged by their numbers of rooms.  One worker is
the plain loop.  What reaches the driver is the weights of each worker, whose size doesn't depend on the data.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tape as t
from ..functions import vocab
from . import model as md
from .scoring import evaluation

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 20
    rate: float = 1e-3
    decay: float = 1e-4
    seed: int = 0
    workers: int = 1
    model: md.ModelConfig = field(default_factory=md.ModelConfig)


@dataclass
class Trained:
    history: list[dict]
    best: Weights | None
    best_macro_f1: float | None
    last: Weights


def examples(nodes: DataFrame, edges: DataFrame, cells: DataFrame, graphs: DataFrame) -> DataFrame:
    """room, nodes, edges, cells and target: a row for each room.

    nodes, edges: as encoding gives them; cells: as teacher_cells(); graphs: room and graph_score.
    """
    taught = cells.groupBy("room").agg(F.sort_array(F.collect_list(F.struct("target", "node_type", "principle_ix", "status_ix", "score"))).alias("cells"))
    return md.room_graphs(nodes, edges).join(taught, "room", "left").join(graphs.select("room", F.col("graph_score").alias("target")), "room", "left")


def room_loss(room: dict, w: dict[str, t.Var], importance: np.ndarray, config: md.ModelConfig) -> tuple[t.Var | None, dict[str, float]]:
    """The loss of one room and its parts; None if nothing is taught there.

    Cross-entropy and score errors are means over the taught cells of a node type, summed over types.
    """
    vectors, links, _, place = md._tensors(room)
    logits, graph = md.forward(vectors, links, w, config)
    parts, total = {}, None

    def add(name: str, loss: t.Var, factor: float) -> None:
        nonlocal total
        parts[name] = float(loss.value)
        part = loss.scaled(factor)
        total = part if total is None else total + part

    axis = t.Var(np.array(vocab.STATUS_SCORES))
    for kind in vocab.HEAD_TYPES:
        own = [c for c in room["cells"] or () if c["node_type"] == kind and c["target"] in place]
        if kind not in logits or not own:
            continue
        principle = np.array([c["principle_ix"] for c in own])
        flat = logits[kind].reshaped(-1, len(vocab.STATUSES)).rows(np.array([place[c["target"]] for c in own]) * len(vocab.PRINCIPLES) + principle)
        add(f"ce_{kind}", t.cross_entropy(flat, np.array([c["status_ix"] for c in own]), importance[principle]), 1.0)
        if config.lambda_score > 0:
            scores = np.array([0.0 if c["score"] is None or math.isnan(c["score"]) else c["score"] for c in own])
            add(f"score_{kind}", t.smooth_l1((t.softmax(flat) * axis).total(axis=1), scores), config.lambda_score)
    if config.lambda_graph > 0 and graph is not None and room["target"] is not None and not math.isnan(room["target"]):
        add("graph_score", t.smooth_l1(t.sigmoid(graph).reshaped(1), np.array([room["target"]])), config.lambda_graph)
    return total, parts


class AdamW:
    """Steps by first and second moments, with a decay of the weights beside them."""

    def __init__(self, rate: float, decay: float, state: dict | None = None):
        self.rate, self.decay = rate, decay
        self.steps, self.first, self.second = (state or {}).get("steps", 0), (state or {}).get("first", {}), (state or {}).get("second", {})

    def step(self, weights: Weights, gradients: Weights) -> None:
        self.steps += 1
        for name, g in gradients.items():
            m = self.first[name] = 0.9 * self.first.get(name, 0.0) + 0.1 * g
            v = self.second[name] = 0.999 * self.second.get(name, 0.0) + 0.001 * g * g
            scaled = (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            weights[name] = weights[name] * (1 - self.rate * self.decay) - self.rate * scaled


def _packed(arrays: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(content: bytes) -> Weights:
    with np.load(io.BytesIO(content)) as f:
        return {k: f[k] for k in f.files}


def _epoch(rooms: DataFrame, weights: Weights, state: dict, importance: np.ndarray, epoch: int, config: TrainConfig) -> tuple[Weights, dict, dict]:
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, adam = dict(weights), AdamW(config.rate, config.decay, {"steps": state.get("steps", 0), "first": dict(state.get("first", {})), "second": dict(state.get("second", {}))})
        loss, n, parts = 0.0, 0, {}
        for batch in batches:
            for room in batch.to_pylist():
                held = {k: t.Var(v) for k, v in own.items()}
                total, some = room_loss(room, held, importance, config.model)
                if total is None:
                    continue
                total.back()
                adam.step(own, {k: v.grad for k, v in held.items() if v.grad is not None})
                loss, n = loss + float(total.value), n + 1
                for k, v in some.items():
                    parts[k] = parts.get(k, 0.0) + v
        if n:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": pa.array([n], pa.int64()), "steps": pa.array([adam.steps], pa.int64()), "parts": pa.array([list(parts.items())], pa.map_(pa.string(), pa.float64())), "weights": [_packed(own)], "first": [_packed(adam.first)], "second": [_packed(adam.second)]})

    order = F.xxhash64("room", F.lit(epoch), F.lit(config.seed))
    dealt = rooms.repartition(config.workers, order).sortWithinPartitions(order, "room")
    rows = dealt.mapInArrow(worked, "loss double, n long, steps long, parts map<string,double>, weights binary, first binary, second binary").collect()  # a row for each worker
    n = sum(r["n"] for r in rows)
    if not n:
        return weights, state, {"loss": 0.0, "n": 0, "parts": {}}

    def mean(column: str) -> Weights:
        out: Weights = {}
        for r in rows:
            for k, v in _unpacked(r[column]).items():
                out[k] = out.get(k, 0.0) + v * (r["n"] / n)
        return out

    parts: dict[str, float] = {}
    for r in rows:
        for k, v in r["parts"].items():
            parts[k] = parts.get(k, 0.0) + v
    state = {"steps": max(r["steps"] for r in rows), "first": mean("first"), "second": mean("second")}
    return mean("weights"), state, {"loss": sum(r["loss"] for r in rows), "n": n, "parts": parts}


def evaluate(nodes: DataFrame, edges: DataFrame, cells: DataFrame, graphs: DataFrame, weights: Weights, config: md.ModelConfig = md.ModelConfig()) -> DataFrame:
    """The metrics document of a model's predictions against the teacher, as one row."""
    found = md.predictions(nodes, edges, weights, config)
    name = lambda values, ix: F.get(F.array(*(F.lit(v) for v in values)), F.col(ix))
    taught = cells.select("room", "target", name(vocab.PRINCIPLES, "principle_ix").alias("principle"), name(vocab.STATUSES, "status_ix").alias("actual"), F.col("score").alias("teacher_score"))
    rows = found.join(taught, ["room", "target", "principle"]).withColumnRenamed("status", "predicted")
    whole = found.groupBy("room").agg(F.first("graph_score").alias("graph_score")).join(graphs.select("room", F.col("graph_score").alias("target")), "room")
    return evaluation(rows.select("principle", "predicted", "actual", "score", "teacher_score"), whole)


def train(rooms: DataFrame, importance: np.ndarray, config: TrainConfig = TrainConfig(), validation: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None, folder: str | None = None) -> Trained:
    """rooms: as examples(); importance: a weight for each principle; validation: nodes, edges, cells and graphs.

    The best weights are the first with the greatest macro F1.  With a folder, log (JSON lines, one an epoch) and the
    best and last weights are written there.
    """
    spark = rooms.sparkSession
    if rooms.isEmpty():
        raise ValueError("no rooms to train on")
    weights, state = md.init_weights(config.model, config.seed), {}
    history, best, best_f1 = [], None, None
    for epoch in range(1, config.epochs + 1):
        weights, state, sums = _epoch(rooms, weights, state, importance, epoch, config)
        n = max(sums["n"], 1)
        record = {"epoch": epoch, "train_loss": round(sums["loss"] / n, 6), "train_examples": sums["n"], "components": {k: round(v / n, 6) for k, v in sorted(sums["parts"].items())}}
        if validation:
            metrics = evaluate(*validation, weights, config.model).first()
            record["val"] = {k: metrics[k] for k in ("macro_f1", "supervised_cells", "score_mae", "graph_mae")}
            if best_f1 is None or record["val"]["macro_f1"] > best_f1:
                best, best_f1, record["is_best"] = weights, record["val"]["macro_f1"], True
                if folder:
                    save(spark, weights, f"{folder}/best")
        history.append(record)
    if folder:
        spark.createDataFrame([_log_row(r) for r in history], "epoch int, train_loss double, train_examples long, components map<string,double>, macro_f1 double, is_best boolean").coalesce(1).write.mode("overwrite").json(f"{folder}/log")
        save(spark, weights, f"{folder}/last")
    return Trained(history, best, best_f1, weights)


def _log_row(r: dict) -> tuple:
    return r["epoch"], r["train_loss"], r["train_examples"], r["components"], r.get("val", {}).get("macro_f1"), r.get("is_best", False)


def save(spark, weights: Weights, path: str) -> None:
    rows = [(k, list(v.shape), v.astype(float).ravel().tolist()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Weights:
    return {r.name: np.array(r.v).reshape(r.shape) for r in spark.read.parquet(path).collect()}  # the model's size


def parameters(weights: Weights) -> int:
    return sum(v.size for v in weights.values())
