"""Configuration, galleries, rounds, outlines and caches."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import config
from frameloom.operators import masks, tracks
from frameloom.sinks import writers
from frameloom.streaming import steps
from tests.test_steps import row


def test_configuration(tmp_path):
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert config.merged(base, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}} and base["a"]["b"] == 1
    assert config.read_yaml(tmp_path / "no.yaml") == {} and config.read_json(tmp_path / "no.json", 7) == 7
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="no mapping"):
        config.read_yaml(tmp_path / "l.yaml")
    (tmp_path / "m.yaml").write_text(config.dataset_yaml("/d", ["pot", "a b"]))
    assert config.read_yaml(tmp_path / "m.yaml")["names"] == {0: "pot", 1: "a b"}
    (tmp_path / "h.yaml").write_text(config.hierarchy_yaml({"b": ["y", "x", "y"], "a": ["z"]}))
    assert config.read_yaml(tmp_path / "h.yaml") == {"a": ["z"], "b": ["x", "y"]}
    now = datetime(2026, 1, 2, 3, 4, 5)
    assert [config.new_run(tmp_path, now).name for _ in range(2)] == ["20260102_030405", "20260102_030405_01"]
    assert config.first_existing([tmp_path / "no", tmp_path / "m.yaml"]) == tmp_path / "m.yaml"
    assert list(config.tuning_profile([{"label": "a", "sample_count": 1}, {"label": "b"}], 2)) == ["b"]


def test_gallery():
    step, state = tracks.Gallery(), {}
    make = lambda v, q=0.9, c=False: {"track_id": 1, "vector": v, "quality": q, "in_conflict": c}
    got = [step(state, [make(v, q, c)])[0] for v, q, c in (([1, 0], 0.9, False), ([0, 1], 0.9, False), ([1, 0.1], 0.5, False), ([1, 0.1], 0.9, True), ([1, 0.1], 0.9, False), (None, 0.9, False))]
    assert [r["added"] for r in got] == [True, False, False, False, True, False]
    assert got[0]["appearance"] == 0.5 and got[1]["appearance"] == 0.0 and got[5]["appearance"] == 0.5


def test_track_splits(spark):
    r = np.random.default_rng(0)
    rows = [(t, i, [float(x) for x in v]) for t, centres in ((1, [(1, 0, 0), (0, 1, 0)]), (2, [(1, 0, 0)])) for i in range(12) for v in [np.array(centres[i % len(centres)]) + r.normal(0, 0.02, 3)]]
    d = spark.createDataFrame(rows, "track_id int, row_id int, vector array<double>")
    out = tracks.split_candidates(d, "track_id", "vector", most_spread=0.2).collect()
    assert [(x["track_id"], x["first"], x["second"]) for x in out] == [(1, 6, 6)] and out[0]["gap"] > 0.9


def test_rounds_see_earlier_rounds_only(spark, tmp_path):
    rows = [(1, 0, "pot", [1.0, 0.0], 0.9), (2, 0, "pan", [0.0, 1.0], 0.2), (3, 1, "pot", [1.0, 0.01], 0.5), (4, 1, "pan", [0.01, 1.0], 0.5), (5, 2, "lid", [-1.0, -1.0], 0.5)]
    out = {r["row_id"]: r for r in tracks.in_rounds(spark.createDataFrame(rows, "row_id bigint, round int, label string, vector array<double>, score double"), 3, str(tmp_path / "m")).collect()}
    assert out[3]["boost"] == 0.12 and out[3]["adjusted"] == pytest.approx(0.62)
    assert 4 not in out and out[1]["boost"] == out[2]["boost"] == 0.0 and out[5]["boost"] == 0.0


def test_outlines():
    r = np.random.default_rng(2)
    for _ in range(40):
        m = masks.filled((r.random((8, 9)) < 0.5).astype(np.uint8))
        rings = masks.outlines(m, 99)
        assert len(rings) == masks.components(m)[1]
        assert sum(abs(masks.ring_area(x)) for x in rings) == m.sum()  # no holes are left
    square = masks.box_mask((2, 1, 5, 4), 6, 7)
    assert sorted(zip(masks.outlines(square)[0][::2], masks.outlines(square)[0][1::2], strict=True)) == [(2, 1), (2, 4), (5, 1), (5, 4)]
    assert masks.outlines(np.zeros((3, 3))) == []


def test_mask_shapes():
    square = masks.box_mask((2, 2, 6, 6), 9, 9)
    assert masks.tuned(square, 1).sum() == 36 and masks.tuned(square, -1).sum() == 4 and masks.tuned(square, 0).sum() == 16
    assert masks.box_if_sparse(np.zeros((9, 9)), (2, 2, 6, 6)).sum() == 16 and masks.box_if_sparse(square, (2, 2, 6, 6)).sum() == 16
    dot = square.copy()
    dot[0, 0] = 1
    assert masks.smoothed(dot)[0, 0] == 1 or masks.smoothed(dot).sum() < dot.sum()
    assert masks.refined(square).sum() >= 12
    assert masks.uncovered(square) == (65 / 81, 65) and masks.uncovered(np.ones((2, 2))) == (0.0, 0)
    assert masks.regions(np.zeros((4, 4), int), np.full((4, 4), 0.9), ["a", "b"]) == [("a", 16, pytest.approx(0.9), 0, 0, 4, 4)]
    assert masks.sample_points(square, 2) == [(2, 2), (5, 5)] and masks.sample_points(np.zeros((2, 2))) == []


def test_scene_refresh_and_mask_cache():
    refresh, state = steps.SceneRefresh(), {}
    runs = [refresh(state, [{"video_id": 0, "frame_idx": f, "change": 0.9 if f == 10 else 0.0}])[0]["run"] for f in range(75)]
    assert [i for i, x in enumerate(runs) if x] == [0, 10, 70]
    cache, state = steps.MaskCache(), {}
    assert [cache(state, [row(f, f, track=1)])[0]["cached"] for f in range(5)] == [False, True, True, False, True]


def test_snapshots_and_packets(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "cluster_id int, name string")
    for _ in range(2):
        writers.write_snapshot(one, one, one, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "instances")).count() == 1 and spark.read.json(str(tmp_path / "events")).count() == 2
    assert writers.packets(one, "cluster_id").first()["packet"] == '{"name":"a"}'
    seen = spark.sparkContext.accumulator(0)
    writers.to_connector(spark.range(10), lambda rows: seen.add(len(rows)))
    assert seen.value == 10
    assert writers.newest(one.select(F.col("name")), "name", 0).count() == 1


def test_mask_pairs_equal_the_pixels(spark):
    from frameloom.operators.perframe import mask_pairs

    r = np.random.default_rng(5)
    shapes = [(r.random((6, 11)) < 0.5).astype(np.uint8) for _ in range(6)]
    rows = [(0, i % 2, i, [(s, n) for s, n in masks.encode(m)]) for i, m in enumerate(shapes)]  # runs go across rows
    d = spark.createDataFrame(rows, "video_id int, frame_idx int, det_id int, runs array<struct<s: bigint, n: bigint>>")
    got = {(x["a_id"], x["b_id"]): (x["common"], round(x["iou"], 9)) for x in mask_pairs(d, 11).collect()}
    want = {(i, j): (int((shapes[i] & shapes[j]).sum()), round((shapes[i] & shapes[j]).sum() / (shapes[i] | shapes[j]).sum(), 9)) for i in range(6) for j in range(i + 1, 6) if i % 2 == j % 2 and (shapes[i] & shapes[j]).any()}
    assert got == want
    exact = d.alias("a").join(d.alias("b"), F.expr("a.det_id < b.det_id and a.frame_idx = b.frame_idx")).select(F.col("a.det_id").alias("p"), F.col("b.det_id").alias("q"), masks.intersection(F.col("a.runs"), F.col("b.runs")).alias("n"))
    assert {(x["p"], x["q"]): x["n"] for x in exact.collect() if x["n"]} == {k: v[0] for k, v in want.items()}
