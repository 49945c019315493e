"""Readers and writers: round trips through files, and small golden inputs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import models, taxonomy
from frameloom.operators import evaluation, joins, labels_ops, masks, rasters, topk
from frameloom.plans import views as V
from frameloom.sinks import writers
from frameloom.sources import readers


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in readers.jsonl(spark, path, "a int").orderBy("a").collect()] == [1, 2]
    assert readers.jsonl(spark, str(tmp_path / "missing.jsonl"), "a int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    writers.write_jsonl(spark.range(3), str(tmp_path / "out"))
    writers.append_jsonl(spark.range(2), str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), "id bigint").count() == 5


def test_twin_files_and_fallback(spark, tmp_path):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "id int, box array<double>")
    b = spark.createDataFrame([(2, "x")], "id int, extra string")
    writers.write_twins([a, b], str(tmp_path / "t"))
    assert readers.table(spark, str(tmp_path / "t.parquet")).columns == ["id", "box", "extra"]
    flat = readers.csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()
    assert flat[0]["box"] == "[1.0,2.0]" and flat[1]["extra"] == "x"
    assert readers.table(spark, str(tmp_path / "t.csv")).count() == 2
    assert readers.row_count(spark, str(tmp_path / "t.parquet")) == readers.row_count(spark, str(tmp_path / "t.csv")) == 2
    assert writers.without_rasters(a.withColumn("mask", F.lit(1))).columns == ["id", "box"]
    (tmp_path / "only.csv").write_text("id\n7\n")
    assert readers.table(spark, str(tmp_path / "only.parquet")).first()["id"] == "7"


def test_matrix_reader(spark, tmp_path):
    m = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "m.npy", m)
    rows = readers.npy(spark, str(tmp_path / "m.npy")).orderBy("embedding_idx").collect()
    assert [r["embedding"] for r in rows] == m.tolist()


def test_video_listing(spark, tmp_path):
    for name in ("b.mp4", "a.MOV", "c.txt", "sub/d.mkv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = [r["path"].rsplit("/", 1)[1] for r in readers.videos(spark, str(tmp_path)).collect()]
    assert names == ["a.MOV", "b.mp4", "d.mkv"]


def test_replay_takes_the_last_line(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"frame_idx": 1, "detections": [{"label": "pot", "bbox": [0, 0, 1, 1]}]}\n{"frame_idx": 1, "detections": [{"label": "pan", "bbox": [0, 0, 2, 2], "confidence": 0.5}, {"label": "lid", "bbox": [1, 1, 2, 2]}]}\n')
    rows = readers.detections_replay(spark, str(tmp_path / "d.jsonl")).orderBy("seq").collect()
    assert [(r["label"], r["confidence"], r["bbox"]["x2"]) for r in rows] == [("pan", 0.5, 2.0), ("lid", 1.0, 2.0)]


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 8}], "categories": [{"id": 5, "name": "pot"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 5, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 2, 2, 3, 3]], "area": 12}, {"id": 10, "image_id": 7, "category_id": 6, "bbox": [0, 0, 1, 1], "segmentation": [], "area": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    a, b = readers.coco(spark, str(tmp_path / "c.json")).orderBy("id").collect()
    assert (a["label"], a["file_name"], tuple(a["bbox"]), len(a["polygon"])) == ("pot", "a.jpg", (1.0, 2.0, 4.0, 6.0), 8)
    assert b["label"] is None and b["polygon"] == []


def test_visor_and_supervisely(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps([{"image": {"image_path": "x/1.jpg"}, "annotations": [{"name": "pan", "segments": [[[0, 0], [1, 0], [1, 1]]]}]}, {"image": {"name": "2.jpg"}, "annotations": []}]))
    rows = readers.visor(spark, str(tmp_path / "v.json")).collect()
    assert [(r["image"], r["name"], r["segments"]) for r in rows] == [("x/1.jpg", "pan", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]])]
    shape = lambda kind, title, n: {"geometryType": kind, "classTitle": title, "points": {"exterior": [[i, i] for i in range(n)]}}
    (tmp_path / "s.json").write_text(json.dumps({"size": {"height": 4, "width": 5}, "objects": [shape("polygon", "Pan ", 3), shape("polygon", "pan", 2), shape("line", "pan", 3), shape("polygon", "dog", 3)]}))
    found = readers.supervisely(spark, str(tmp_path / "s.json"), spark.createDataFrame([("pan", "pan")], "title string, label string")).collect()
    assert [(r["label"], r["width"], r["points"]) for r in found] == [("pan", 5, [0.0, 0.0, 1.0, 1.0, 2.0, 2.0])]


def test_yolo_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("f1", 1, 3, [0.0, 0.0, 5.0, 0.0, 20.0, 10.0]), ("f1", 2, None, [0.0] * 6), ("f1", 3, 0, [1.0, 1.0]), ("f2", 4, 1, [0.0, 0.0, 1.0, 1.0, 2.0, 2.0])], "frame string, proposal_id int, class_idx int, polygon array<double>").withColumns({"w": F.lit(10.0), "h": F.lit(10.0)})
    lines = {r["frame"]: (r["text"], r["n"]) for r in writers.yolo_lines(d, "w", "h").collect()}
    assert lines["f1"] == ("3 0.000000 0.000000 0.500000 0.000000 1.000000 1.000000", 1) and lines["f2"][1] == 1
    for name, (text, _) in lines.items():
        (tmp_path / f"{name}.txt").write_text(text + "\nbad line\n")
    rows = readers.yolo_labels(spark, str(tmp_path)).orderBy("stem", "pos").collect()
    assert [(r["stem"], r["pos"], r["class_id"], len(r["points"])) for r in rows] == [("f1", 0, 3, 6), ("f2", 0, 1, 6)]
    writers.write_partitioned_text(writers.yolo_lines(d, "w", "h"), str(tmp_path / "out"), "frame")
    assert {r["frame"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"f1", "f2"}


def test_golden_evaluation(spark):
    names = spark.createDataFrame(list(enumerate(["pot", "pan", "carton", "box", "sponge"])), "idx int, name string")
    files = lambda ids: spark.createDataFrame([("a", i, c) for i, c in enumerate(ids)], "stem string, pos int, class_id int")
    r = evaluation.accuracy(files([0, 2, 4]), files([1, 3, 4]), names).first()
    assert (r["fine_correct"], r["coarse_correct"], r["coarse_accuracy"], r["unmatched"]) == (1, 3, 1.0, 0) and r["fine_accuracy"] == pytest.approx(1 / 3)
    assert evaluation.accuracy(files([0, 2]), files([]), names).first()["unmatched"] == 2
    m = {r["truth"]: r for r in evaluation.confusion_matrix(spark.createDataFrame([("a", "a"), ("a", "b")], "truth string, predicted string"), ["a", "b"]).collect()}
    assert (m["a"]["a"], m["a"]["b"]) == (1, 1)


def test_coco_documents_and_tables(spark, small):
    d = V.labelled(spark, small).limit(50)
    images, categories, annotations = writers.coco_tables(d)
    assert annotations.count() == 50 and sorted(r["id"] for r in annotations.collect()) == list(range(1, 51))
    assert images.count() == d.select("video_id", "frame_idx").distinct().count() and categories.count() == d.select("fine").distinct().count()
    rows = labels_ops.class_index(d, "fine").select(F.lit("train").alias("split"), F.col("det_id").alias("proposal_id"), F.concat_ws("_", "video_id", "frame_idx").alias("frame"), "class_idx", F.col("fine").alias("label"), "bbox")
    doc = json.loads(writers.coco_documents(rows, "split").first()["document"])
    assert len(doc["annotations"]) == 50 and {a["category_id"] for a in doc["annotations"]} == {c["id"] for c in doc["categories"]}


def test_splits(spark):
    d = spark.createDataFrame([(f"f{i % 20}", i) for i in range(100)], "frame string, id int")
    split = topk.split_index(d, "frame", 3, 0.2)
    assert split.groupBy("frame").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert split.where("split = 'val'").select("frame").distinct().count() == 4
    inside, outside = joins.split_by_frames(d, split.where("split = 'val'").select("frame").distinct(), "frame")
    assert inside.count() == 20 and outside.count() == 80
    folders = writers.class_folders(d.selectExpr("'a' as label", "frame as crop_path"), 10, 1, 0.3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in folders} == {"train": 7, "val": 3}


def test_model_boundary(spark):
    image = np.zeros((20, 30), np.uint8)
    image[2:6, 3:9] = 255
    image[10:18, 10:25] = 255
    frames = spark.createDataFrame([(0, i, image.tobytes(), 20, 30) for i in range(4)], "video_id bigint, frame_idx bigint, image binary, height int, width int")
    rows = models.detected(frames, "blobs", ["pot", "lid"], every=2).orderBy("frame_idx", "seq").collect()
    assert [(r["frame_idx"], r["label"], r["x1"], r["y2"]) for r in rows] == [(0, "pot", 10.0, 18.0), (0, "lid", 3.0, 6.0), (2, "pot", 10.0, 18.0), (2, "lid", 3.0, 6.0)]
    assert models.detected(frames, "unheard of", []).count() == 0
    crops = spark.createDataFrame([(1, bytes(range(12)), 2, 2), (2, None, 0, 0)], "proposal_id bigint, image binary, height int, width int")
    (one,) = models.embedded(crops).collect()
    assert one["proposal_id"] == 1 and len(one["embedding"]) == 128 and np.linalg.norm(one["embedding"]) == pytest.approx(1)
    assert "uncertain" in models.reviewed(crops).first()["response"]
    assert models.capabilities(["numpy", "no_such_module"]) == [("numpy", "OK"), ("no_such_module", "missing")]


def test_rasters():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (32, 40, 3), dtype=np.uint8)
    assert (rasters.gamma(image, 1.0) == image).mean() > 0.9 and rasters.gamma(image, 1.5).mean() > image.mean()
    flat = np.full((16, 16, 3), 90, np.uint8)
    assert (rasters.sharpened(flat) == flat).all() and rasters.enhanced(flat, ["unknown"]) is flat
    bright = np.full((4, 4, 3), 255, np.uint8)
    assert (rasters.compressed_highlights(bright) == 250).all()
    assert rasters.enhanced(image, ["light", "edge", "glare_light"]).shape == image.shape
    assert rasters.normalized_depth(np.full((3, 3), 2.0)).max() == 0 and rasters.normalized_depth(np.arange(100.0).reshape(10, 10)).max() == 1
    mask = np.zeros((30, 30), np.uint8)
    mask[8:22, 8:22] = 1
    depth = np.where(mask > 0, 0.8, 0.2).astype(float)
    m = rasters.depth_metrics(mask, depth)
    assert (m["area"], m["parts"], m["median"], m["separation"]) == (196, 1, 0.8, 1.0) and m["compactness"] > 0.999 and m["edge_alignment"] > 0.3
    depth[8, 8:22] = 0.2
    trimmed, safe, share = rasters.boundary_trim(mask, depth)
    assert safe and trimmed.sum() == 196 - 14 and 0 < share < 0.3
    low, high, part = rasters.two_layers(np.r_[np.zeros(30), np.ones(10)])
    assert (low, high, part) == (0.0, 1.0, 0.25)
    assert rasters.cleaned(mask, "pot").sum() == 196 and masks.decode(masks.encode(mask), 30, 30).sum() == 196
    assert rasters.depth_metrics(np.zeros((4, 4)), np.zeros((4, 4)))["area"] == 0


def test_taxonomies(spark):
    assert taxonomy.inverted(taxonomy.TRACKING_GROUPS)["kettle"] == "cookware" and taxonomy.inverted(taxonomy.INFERENCE_TAXONOMY)["kettle"] == "appliance"
    assert taxonomy.dimension(spark, taxonomy.REVIEW_HIERARCHY, "review").where("coarse = 'hand'").count() == 2


def test_reports(tmp_path):
    assert writers.summary_text({"a": 1}, "Run") == "Run\n- a: 1\n"


def test_running_total(spark):
    from frameloom.operators.windows import running_total

    d = spark.range(1000).selectExpr("id * 7 as k", "id % 5 as v").orderBy(F.rand(1))
    got = {r["k"]: r["t"] for r in running_total(d, "k", F.col("v"), "t", span=100).collect()}
    total = 0
    for i in range(1000):
        assert got[i * 7] == total
        total += i % 5
