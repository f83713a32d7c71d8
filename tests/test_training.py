"""Gradients against finite differences, training against a plain loop, metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.functions import tape as t
from plenum.functions import vocab
from plenum.operators import model as md
from plenum.operators import training as tr

SMALL = md.ModelConfig(hidden=8, heads=2, layers=2, label_size=4)


def room(seed, taught=True):
    r = np.random.default_rng(seed)
    node = lambda i, kind: {"id": i, "node_type": kind, "label_ix": int(r.integers(0, len(vocab.LABELS) + 1)), "features": r.normal(size=8).tolist()}
    nodes = [node("a", "object"), node("b", "object"), node("c", "object"), node("w", "wall"), node("d", "door"), node("r", "room")]
    kind = {n["id"]: n["node_type"] for n in nodes}
    edges = []
    for s, rel, e in (("a", "spatial", "b"), ("b", "spatial", "a"), ("c", "spatial", "a"), ("a", "to_wall", "w"), ("d", "aperture_wall", "w"), ("a", "to_room", "r"), ("d", "to_room", "r"), ("d", "entry_path", "c")):
        features = r.normal(size=md.EDGE_SIZE).tolist()
        edges.append({"src": s, "dst": e, "src_type": kind[s], "relation": rel, "dst_type": kind[e], "features": features})
        edges.append({"src": e, "dst": s, "src_type": kind[e], "relation": f"rev_{rel}", "dst_type": kind[s], "features": features})
    cells = [{"target": i, "node_type": kind[i], "principle_ix": int(p), "status_ix": int(r.integers(0, 3)), "score": float(r.uniform())} for i in ("a", "c", "d", "r") for p in r.choice(9, 2, replace=False)]
    return {"room": seed, "nodes": nodes, "edges": edges, "cells": cells if taught else None, "target": 0.4 if taught else None}


def test_gradients_equal_finite_differences():
    weights = md.init_weights(SMALL, 1)
    rng = np.random.default_rng(0)
    weights = {k: v + rng.normal(0, 0.05, v.shape) for k, v in weights.items()}
    importance = rng.uniform(0.5, 1.5, 9)
    one = room(3)

    def loss(w):
        return float(tr.room_loss(one, {k: t.Var(v) for k, v in w.items()}, importance, SMALL)[0].value)

    held = {k: t.Var(v) for k, v in weights.items()}
    total, parts = tr.room_loss(one, held, importance, SMALL)
    total.back()
    assert set(parts) >= {"ce_object", "score_object", "ce_room", "graph_score"}
    names = [k for k in weights if held[k].grad is not None]
    assert len(names) > 60
    for name in names:
        at = tuple(rng.integers(0, n) for n in weights[name].shape)
        step = np.zeros_like(weights[name])
        step[at] = 1e-5
        slope = (loss(weights | {name: weights[name] + step}) - loss(weights | {name: weights[name] - step})) / 2e-5
        assert held[name].grad[at] == pytest.approx(slope, abs=2e-6, rel=1e-4), name


def test_loss_parts():
    """Cross-entropy, score and graph errors by their formulas."""
    one, importance = room(5), np.linspace(0.5, 1.5, 9)
    weights = {k: t.Var(v) for k, v in md.init_weights(SMALL, 2).items()}
    total, parts = tr.room_loss(one, weights, importance, SMALL)
    vectors, links, by_type, place = md._tensors(one)
    logits, graph = md.forward(vectors, links, weights, SMALL)
    want = 0.0
    for kind in vocab.HEAD_TYPES:
        own = [c for c in one["cells"] if c["node_type"] == kind]
        if own:
            rows = [logits[kind].value[place[c["target"]], c["principle_ix"]] for c in own]
            shares = [np.exp(x) / np.exp(x).sum() for x in rows]
            ce = np.mean([-math.log(p[c["status_ix"]]) * importance[c["principle_ix"]] for p, c in zip(shares, own, strict=True)])
            far = [abs(float(p @ np.array(vocab.STATUS_SCORES)) - c["score"]) for p, c in zip(shares, own, strict=True)]
            l1 = np.mean([d * d / 2 if d < 1 else d - 0.5 for d in far])
            assert parts[f"ce_{kind}"] == pytest.approx(ce) and parts[f"score_{kind}"] == pytest.approx(l1)
            want += ce + 0.5 * l1
    d = abs(1 / (1 + math.exp(-graph.value.item())) - 0.4)
    assert float(total.value) == pytest.approx(want + 0.25 * d * d / 2)
    assert tr.room_loss(room(6, taught=False), weights, importance, SMALL) == (None, {})


ROOM = (
    "room long, nodes array<struct<id:string,node_type:string,label_ix:int,features:array<double>>>, edges array<struct<src:string,dst:string,src_type:string,relation:string,dst_type:string,features:array<double>>>, "
    "cells array<struct<target:string,node_type:string,principle_ix:int,status_ix:int,score:double>>, target double"
)


def test_training(spark, tmp_path):
    rows = [room(k) for k in range(6)] + [room(9, taught=False)]
    rooms = spark.createDataFrame([tuple(r[c] if c in ("room", "target") else [tuple(x.values()) for x in r[c]] if r[c] else None for c in ("room", "nodes", "edges", "cells", "target")) for r in rows], ROOM)
    config = tr.TrainConfig(epochs=6, rate=5e-3, model=SMALL)
    importance = np.ones(9)
    done = tr.train(rooms, importance, config, folder=str(tmp_path / "run"))
    assert [h["train_examples"] for h in done.history] == [6] * 6 and done.history[-1]["train_loss"] < 0.8 * done.history[0]["train_loss"]
    # the first epoch is the plain loop in the order of the rooms' hashes
    order = [r.room for r in rooms.select("room", F.xxhash64("room", F.lit(1), F.lit(0)).alias("h")).orderBy("h", "room").collect()]
    weights, adam, losses = md.init_weights(SMALL, 0), tr.AdamW(5e-3, 1e-4), []
    for k in order:
        held = {n: t.Var(v) for n, v in weights.items()}
        total, _ = tr.room_loss({x["room"]: x for x in rows}[k], held, importance, SMALL)
        if total is not None:
            total.back()
            adam.step(weights, {n: v.grad for n, v in held.items() if v.grad is not None})
            losses.append(float(total.value))
    assert done.history[0]["train_loss"] == pytest.approx(np.mean(losses), abs=1e-5)
    back = tr.load(spark, str(tmp_path / "run/last"))
    assert all((back[k] == v).all() for k, v in done.last.items()) and tr.parameters(back) == tr.parameters(done.last)
    assert spark.read.json(str(tmp_path / "run/log")).count() == 6
    nodes = rooms.select("room", F.explode("nodes").alias("n")).select("room", "n.*")
    edges = rooms.select("room", F.explode("edges").alias("e")).select("room", "e.*")
    cells = rooms.select("room", F.explode("cells").alias("c")).select("room", "c.*")
    graphs = rooms.select("room", F.col("target").alias("graph_score"))
    before, after = (tr.evaluate(nodes, edges, cells, graphs, w, SMALL).first() for w in (md.init_weights(SMALL, 0), done.last))
    assert after.macro_f1 > before.macro_f1 and after.supervised_cells == before.supervised_cells > 0 and after.graphs == 7
    split = tr.train(rooms, importance, tr.TrainConfig(epochs=2, rate=5e-3, workers=3, model=SMALL), validation=(nodes, edges, cells, graphs))
    assert split.best_macro_f1 == max(h["val"]["macro_f1"] for h in split.history) and split.best is not None
    with pytest.raises(ValueError):
        tr.train(rooms.limit(0), importance, config)
