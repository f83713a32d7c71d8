"""The stages end to end on two layouts and a workbook, and what viewers and exports ask for."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scene import SAMPLE  # tests/test_scene.py
from test_sources import workbook  # tests/test_sources.py

from plenum import pipeline as pl
from plenum.operators import model as md
from plenum.operators import scoring as sc
from plenum.operators import training as tr
from plenum.operators import viewer as vw
from plenum.plans import transcript_stages as ts
from plenum.sources import files as fs


def test_stages_end_to_end(spark, tmp_path):
    layouts, books, out = tmp_path / "layouts", tmp_path / "books", str(tmp_path / "out")
    layouts.mkdir()
    books.mkdir()
    (layouts / "my room.txt").write_text(SAMPLE)
    (layouts / "other.txt").write_text(SAMPLE.replace("bed,1.1,2.0", "bed,2.6,2.3"))
    workbook(books / "dm_shorts_2022.xlsx", [["Video Date", "Video Title", "Video Transcript", "Video URL"], ["d1", "living room", "Move the sofa against the wall so you can see the door. " * 3, "u1"], ["d2", "cats", "They sleep.", "u2"]])
    options = pl.Options(out, str(books), (), str(layouts), train=tr.TrainConfig(epochs=1, model=md.ModelConfig(hidden=8, heads=2, label_size=4)))

    def writer(prompts):
        return prompts.select("room", F.when(F.col("room") == "other", '{"summary": "fine", "recommendations": ["do"]}').otherwise("no answer").alias("answer"))

    got = pl.run(spark, options, writer=writer)
    assert set(got) == {"summary", "graphs", "history", "metrics", "predictions", "extras"}
    assert got["summary"].first().docs_total == 2 and got["summary"].first().on_topic == 1
    assert {r.room: r.error for r in got["graphs"].select("room", "error").collect()} == {"my_room": None, "other": None}
    graphs = fs.graphs(spark, f"{out}/graphs")
    assert {r.room for r in graphs.collect()} == {"my_room", "other"} and {r.schema_version for r in graphs.collect()} == {"scene_graph_v1"}
    parts = fs.graph_tables(graphs)
    nodes = {r.id for r in parts["nodes"].where("room = 'my_room'").collect()}
    assert {"bbox_0", "wall_0", "door_0", "room_0", "bed_group_0"} <= nodes
    edges = parts["edges"].where("room = 'my_room'")
    assert {(r.src, r.dst) for r in edges.where("type = 'against_wall'").collect()} == {("bbox_2", "wall_3")}
    assert edges.where("type = 'traffic_path'").count() == 3
    assert [h.epoch for h in got["history"].orderBy("epoch").collect()] == [1]
    metrics = got["metrics"].first()
    assert 0 <= metrics.macro_f1 <= 1 and metrics.supervised_cells > 0 and metrics.graphs == 2
    extras = {r.room: r for r in got["extras"].collect()}
    assert extras["other"].summary == "fine" and extras["other"].recommendations == ["do"]
    assert extras["my_room"].summary.startswith("Room score:")
    # what is skipped isn't run, and a given checkpoint is used
    only = pl.run(spark, pl.Options(out, checkpoint=f"{out}/model/last", skip=frozenset(("transcripts", "spatial", "graph", "train", "predict")), train=options.train))
    assert set(only) == {"metrics"} and only["metrics"].first().checkpoint == f"{out}/model/last"
    for bad in (frozenset(pl.STAGES), frozenset(("x",))):
        with pytest.raises(ValueError):
            pl.run(spark, pl.Options(out, skip=bad))
    with pytest.raises(ValueError):
        pl.run(spark, pl.Options(out, clouds=("a.ply",)))


def test_transcript_stages_one_by_one(spark, tmp_path):
    books, out = tmp_path / "books", str(tmp_path / "out")
    books.mkdir()
    workbook(books / "dm_shorts_2021.xlsx", [["Video Title", "Video Transcript"], ["living room", "Move the sofa against the wall so you can see the door."], ["Living Room", "Move the sofa against the wall so you can see the door."]])
    workbook(books / "dm_shorts_2020.xlsx", [["Video Title", "Video Transcript"], ["a", "b"]])
    assert fs.ingest_counts(spark, str(books)).first().asDict() == {"files": 2, "rows_seen": 3, "rows_emitted": 3}
    assert ts.run(spark, str(books), out, "ingest").first().docs_total == 3
    assert [r.seq for r in spark.read.json(f"{out}/raw").orderBy("source_xlsx", "row_index").collect()] == [1, 2, 3]
    assert ts.run(spark, str(books), out, "clean").first().docs_total == 2
    assert ts.run(spark, str(books), out, "rules").first().docs_total == 2
    whole = ts.run(spark, str(books), out, "aggregate").first()
    assert (whole.docs_total, whole.on_topic, whole.off_topic) == (2, 1, 1) and whole.docs_by_year.asDict() == {"2020": 1, "2021": 1}
    with pytest.raises(ValueError):
        ts.run(spark, str(books), out, "other")


def test_edges_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "near", 1.5, None, None), ("b", "c", "faces", None, 3.0, None)], "src string, dst string, type string, distance_m double, angle double, other double")
    assert fs.write_edges_csv(rows, str(tmp_path / "e")) == ["source", "target", "type", "distance_m", "angle"]
    assert fs.write_edges_csv(rows.limit(0), str(tmp_path / "f")) == ["source", "target", "type"]
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2


def test_names(spark):
    rows = spark.createDataFrame([("predict_my room!",), ("",), (None,), ("a-b_1",)], "n string")
    assert [r[0] for r in rows.select(fs.safe_stem(F.col("n"))).collect()] == ["predict_my_room_", "scene", "scene", "a-b_1"]
    assert [r[0] for r in rows.select(fs.extras_stem(F.col("n"))).collect()] == ["my_room_", "", "", "a-b_1"]


def test_viewer(spark):
    row = spark.createDataFrame([([1.0, 2.0], [(0.0, 0.0)], 5.0, 6.0), (None, [(0.0, 0.0), (2.0, 4.0)], 5.0, 6.0), (None, None, 5.0, 6.0), (None, [], None, 6.0)], "c array<double>, k array<struct<x:double,y:double>>, x double, y double")
    got = [r[0] and (r[0].x, r[0].y) for r in row.select(vw.anchor(F.col("c"), F.col("k"), F.col("x"), F.col("y"))).collect()]
    assert got == [(1.0, 2.0), (1.0, 2.0), (5.0, 6.0), None]
    yaws = spark.createDataFrame([(math.radians(d),) for d in (44, 46, -46, 135.1, 270)] + [(None,)], "yaw double")
    assert [round(math.degrees(r[0])) for r in yaws.select(vw.snapped_yaw(F.col("yaw"))).collect()] == [0, 90, -90, 180, 270, 0]
    x, y = vw.local_to_world(F.lit(1.0), F.lit(2.0), F.lit(math.pi / 2), F.lit(3.0), F.lit(0.5))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((0.5, 5.0))
    edges = spark.createDataFrame([("near",), ("principle_x",), (None,), ("faces",)], "type string")
    assert [r.type for r in vw.visible_edges(edges, ("faces",)).collect()] == ["near", None]
    assert vw.visible_edges(edges, principles=True).count() == 4
    boxes = spark.createDataFrame([(1, 1, "a", "furniture", 'a "b", c', 1.0, 1.0, 0.0, 0.0, 0.0, 2.0, 1.0, False, "x\ny")], "room long, ord int, id string, kind string, label string, x double, y double, z double, yaw_rad double, width double, depth double, height double, confirmed boolean, notes string")
    text = vw.export_csv(boxes).first().csv
    assert text == 'id,kind,label,x,y,z,yaw_rad,yaw_deg,width,depth,height,confirmed,notes\na,furniture,"a ""b"", c",1.0,1.0,0.0,0.0,0.0,0.0,2.0,1.0,false,"x\ny"'
    rooms = spark.createDataFrame([(1,), (2,)], "room long")
    scenes = {r.room: json.loads(r.scene) for r in vw.export_scenes(rooms, boxes).collect()}
    assert scenes[1]["bounds"] == pytest.approx({"min_x": 0.35, "max_x": 1.65, "min_y": -0.6, "max_y": 2.6}) and scenes[2] == {"bounds": {"min_x": -2.0, "max_x": 2.0, "min_y": -2.0, "max_y": 2.0}, "entities": []}
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "room long, id string")
    found = spark.createDataFrame([(1, "a", 2, "q", "weak", 0.5), (1, "a", 1, "p", "good", 1.0), (1, "z", 3, "p", "good", 1.0)], "room long, target string, seq int, principle string, status string, score double")
    notes = spark.createDataFrame([(1, "a", 1, "p", "text"), (1, "a", 2, None, "more")], "room long, target string, seq int, principle string, text string")
    got = {r.id: r for r in vw.node_details(nodes, found, notes).collect()}
    assert [p.principle for p in got["a"].predictions] == ["p", "q"] and got["a"].notes == "[LLM] p: text\n[LLM] : more"
    assert got["b"].predictions == [] and got["b"].notes is None


def test_completed_extras(spark):
    found = spark.createDataFrame([(1, "a", 1, "solid_backing", "violated", 0.2), (1, "b", 2, "clear_center", "weak", 0.1), (1, "c", 3, "clear_center", "good", 1.0), (2, "a", 1, "clear_center", "good", 1.0)], "room long, target string, seq int, principle string, status string, score double")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9)], "room long, graph_score double")
    answers = spark.createDataFrame([(1, 'Sure! {"summary": " ", "ranked_violations": [{"principle": "clear_center", "target": "b"}]} bye'), (2, '{"summary": "ok", "recommendations": "none"}')], "room long, answer string")
    got = {r.room: r for r in sc.completed_extras(answers, found, scores).collect()}
    one, two = got[1], got[2]
    assert one.summary == "Room score: 0.50 (Fair). 1 violation(s) and 1 warning(s) detected." or one.summary.startswith("Room score: 0.50")
    assert one.recommendations == ["Address the 'solid_backing' issue on a.", "Address the 'clear_center' issue on b."]
    assert [(v.principle, v.target) for v in one.ranked_violations] == [("clear_center", "b")] and one.ranked_violations[0].impact is not None
    assert [e.text for e in one.explanations] == ["Solid Backing is violated for a.", "Clear Center is weak for b."]
    assert two.summary == "ok" and two.recommendations == [] and two.ranked_violations == [] and two.explanations == []


def test_evaluation(spark):
    cells = spark.createDataFrame([("p", "good", "good", 1.0, 0.5), ("p", "weak", "good", 0.5, None), ("q", "weak", "weak", 0.5, 0.5)], "principle string, predicted string, actual string, score double, teacher_score double")
    graphs = spark.createDataFrame([(0.5, 0.25), (0.5, None)], "graph_score double, target double")
    got = sc.evaluation(cells, graphs, 2).first()
    assert got.macro_f1 == pytest.approx((2 / 3 + 1) / 2) and got.supervised_cells == 3
    assert got.score_mae == pytest.approx(1 / 3) and got.graph_mae == 0.25 and got.graphs == 2 and got.per_principle_f1 == pytest.approx({"p": 2 / 3, "q": 1.0})
    assert np.isfinite(got.macro_f1)
