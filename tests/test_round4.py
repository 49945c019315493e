"""Findings of the third round: long videos, many frames, many buckets."""

from __future__ import annotations

import itertools
import math
import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import homography, vectors
from frameloom.streaming import association, frames, steps
from tests.test_online import H, W, sighting


def plain_cues(t, row, known):
    """The cues of one pair, number by number."""
    looks = 0.5
    if row["vector"] is not None and known:
        looks = max(float(np.dot(v, row["vector"])) for v in known) / math.sqrt(sum(x * x for x in row["vector"]))
        looks = min(1.0, max(0.0, looks)) if t["gallery"]["best"] else looks
    side = lambda b: (b["x2"] - b["x1"], b["y2"] - b["y1"])
    middle = lambda b: ((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)
    (w1, h1), (w2, h2), now, there = side(t), side(row), middle(t), middle(row)
    ratio = max(w1 * h1, w2 * h2) / max(1e-6, min(w1 * h1, w2 * h2))
    form = math.exp(-abs(math.log(max(1e-6, w1 / max(1, h1) / max(1e-6, w2 / max(1, h2))))) / 0.8)
    extent = math.dist((w1 / W, h1 / H, t["depth_high"] - t["depth_low"]), (w2 / W, h2 / H, row["depth_high"] - row["depth_low"]))
    long = max(1.0, w2, h2)
    kinds = {t["coarse"], row["coarse"]}
    return {
        "iou": steps.iou(t, row), "centre": math.exp(-math.dist(now, there) / long), "depth": math.exp(-abs(t["depth"] - row["depth"]) / 0.12), "mask": math.exp(-abs(t["fill"] - row["fill"]) / 0.35),
        "shape": 0.45 / max(1, ratio) + 0.35 * form + 0.20 * math.exp(-extent / 0.35), "appearance": looks, "label": 1.0 if len(kinds) == 1 else 0.5 if kinds == {"cookware", "lid_or_cookware"} else 0.2,
        "motion": 0.7 if t["before"] is None else math.exp(-math.dist((2 * now[0] - t["before"][0], 2 * now[1] - t["before"][1]), there) / long),
    }


def test_cues_of_tables_are_those_of_pairs():
    r = random.Random(4)
    tracker, state = association.CueTracker(W, H), {}

    def frame(f):
        return [sighting(100 * f + k, f, (x := r.randrange(0, 250), y := r.randrange(0, 150), x + r.randrange(0, 90), y + r.randrange(0, 90)), r.random(), coarse=r.choice(["cookware", "lid_or_cookware", "hand", None]), confidence=r.random(), vector=r.choice([None, [0.0, 0.0, 0.0], [r.gauss(0.3, 1) for _ in range(3)]]), quality=r.random(), fill=r.random()) for k in range(9)]

    compared = 0
    for f in range(40):
        tracker(state, frame(f))
        for t, row in itertools.product(state["tracks"].values(), map(tracker._read, frame(f))):
            g, first = t["gallery"], t["vector"]
            known = [v for _, v in g["best"]] + g["recent"] + ([g["mean"]] if g["mean"] is not None else [])
            if not known and first is not None and first.any():
                known = [first / np.linalg.norm(first)]
            if row["vector"] is not None and not row["vector"].any():
                known = []
            assert tracker._cues(t, row) == pytest.approx(plain_cues(t, row, known), abs=1e-12)
            compared += 1
    assert compared > 1000


def test_paired_finds_most_pairs_of_the_highest_score():
    r = random.Random(9)
    clashes = 0
    for _ in range(300):
        n, m = r.randrange(1, 6), r.randrange(1, 6)
        table = {(i, j): r.random() for i in range(n) for j in range(m) if r.random() < 0.6}
        got = association.paired(*(np.array(x) for x in ([k[0] for k in table], [k[1] for k in table], list(table.values())))) if table else []
        options = [[]]
        for j in range(m):
            options += [[*o, (i, j)] for o in options for i in range(n) if (i, j) in table and all(a != i for a, _ in o)]
        best = max(options, key=lambda o: (len(o), sum(table[p] for p in o)))
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got) == len(best)
        assert all(table[i, j] == s for i, j, s in got) and sum(s for *_, s in got) == pytest.approx(sum(table[p] for p in best))
        clashes += len({max((s, i) for (i, k), s in table.items() if k == j)[1] for j in {k for _, k in table}}) < len({k for _, k in table})
    assert clashes > 50


def test_a_frame_among_many_tracks_takes_no_square_table():
    r = random.Random(2)
    tracker, state = association.CueTracker(W, H), {}
    frame = lambda f, n: [sighting(1000 * f + k, f, (x := r.randrange(0, 250), y := r.randrange(0, 150), x + 60, y + 60), r.random(), vector=[r.gauss(0, 1) for _ in range(8)]) for k in range(n)]
    tracker(state, frame(0, 400))
    assert len(state["tracks"]) == 400
    began = time.process_time()
    for f in range(1, 6):
        tracker(state, frame(f, 10))
    assert time.process_time() - began < 1  # 400 x 400 costs in Python took 42 s


@pytest.mark.parametrize("tasks", [4, 8, 32])
def test_few_videos_share_no_task(spark, tasks):
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rows = spark.range(80).selectExpr("id AS det_id", "id % 4 AS video_id", "id AS frame_idx")
        out = frames.by_frame(rows, lambda: lambda state, found: [{"video_id": r["video_id"], "frame_idx": r["frame_idx"]} for r in found], "video_id long, frame_idx long", ["video_id"], in_turn=True)
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == 80 and len({r["task"] for r in got}) == 4 == len({(r["task"], r["video_id"]) for r in got})


def test_motions_of_four_pairs_are_exact():
    r = np.random.default_rng(5)
    motion = np.eye(3) + r.normal(0, [[0.03, 0.03, 8], [0.03, 0.03, 8], [2e-5, 2e-5, 0]], (50, 3, 3))
    source = r.uniform(0, 500, (50, 4, 2))
    found = homography._of_four(source, homography.moved(motion, source))
    assert np.allclose(found / found[:, 2:, 2:], motion / motion[:, 2:, 2:], rtol=1e-6, atol=1e-8)
    draw = homography._draws(r, 20000, 6)
    assert draw.min() == 0 and draw.max() == 5 and all(len(set(d)) == 4 for d in draw.tolist())
    assert np.abs(np.bincount(draw.ravel(), minlength=6) / 80000 - 1 / 6).max() < 0.01


def test_a_frames_motion_takes_few_milliseconds():
    r = np.random.default_rng(6)
    source = r.uniform((0, 0), (640, 480), (200, 2))
    target = homography.moved(np.array([[1.01, 0.01, 5], [-0.01, 0.99, 3], [1e-5, 0, 1]]), source)
    target[:80] = r.uniform((0, 0), (640, 480), (80, 2))
    began = time.process_time()
    for seed in range(40):
        assert homography.estimated(source, target, seed=seed)[1].sum() >= 120
    assert time.process_time() - began < 0.6  # 512 decompositions a frame took 1.4 s


def test_motions_go_on_over_batches(spark):
    r = np.random.default_rng(7)
    rows = [(v, f, float(x), float(y), float(x + f), float(y - f)) for v in range(2) for f in range(6) for x, y in r.uniform(0, 400, (23, 2))] + [(2, 0, 1.0, 1.0, None, 1.0)]
    points = spark.createDataFrame(rows, "video_id long, frame_idx long, x double, y double, u double, v double")
    whole = {(m["video_id"], m["frame_idx"]): m for m in homography.motions(points).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        parts = {(m["video_id"], m["frame_idx"]): m for m in homography.motions(points).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == whole and len(whole) == 13 and whole[2, 0]["motion"] is None and whole[2, 0]["n"] == 0
    for (v, f), m in whole.items():
        assert v == 2 or (m["n"] == m["inliers"] == 23 and np.allclose(m["motion"], [1, 0, f, 0, 1, -f, 0, 0, 1], atol=1e-6))


def test_anchors_are_moved_together(monkeypatch):
    calls, moved = [], homography.moved
    monkeypatch.setattr(homography, "moved", lambda motion, points: calls.append(len(points)) or moved(motion, points))
    step, state = homography.Anchors(640, 480), {}
    shapes = {"sink": [10, 10, 90, 10, 90, 60], "wall": [100, 100, 300, 100, 300, 250, 100, 250], "none": [1, 1, 2, 2]}
    base = {"video_id": 0, "motion": None}
    step(state, [{**base, "frame_idx": 0, "label": k, "polygon": p, "confidence": 0.5} for k, p in shapes.items()])
    out = step(state, [{**base, "frame_idx": 1, "label": None, "polygon": None, "confidence": None, "motion": [1, 0, 5, 0, 1, -20, 0, 0, 1]}])
    assert calls == [7, 7]
    assert [(a["label"], a["x1"], a["y1"], a["x2"], a["y2"], len(a["polygon"])) for a in out] == [("sink", 15, 0, 96, 41, 6), ("wall", 105, 80, 306, 231, 8)]
    assert step(state, [{**base, "frame_idx": 2, "label": "none", "polygon": shapes["none"], "confidence": 0.5}]) == []


def test_labels_are_clustered_side_by_side(spark, tmp_path, monkeypatch):
    together, bucketed, parts = threading.Barrier(3), vectors.bucketed, []
    kmeans = vectors.kmeans

    def meeting(*args, **more):
        together.wait(timeout=60)  # one label after the other would never meet here
        return bucketed(*args, **more)

    monkeypatch.setattr(vectors, "bucketed", meeting)
    monkeypatch.setattr(vectors, "kmeans", lambda d, *args, **more: parts.append(d.rdd.getNumPartitions()) or kmeans(d, *args, **more))
    r = np.random.default_rng(1)
    rows = [(40 * c + i, label, r.normal(0, 1, 4).tolist()) for c, label in enumerate(("pot", "lid", None)) for i in range(40)]
    found, failed = vectors.safe_clusters(spark.createDataFrame(rows, "proposal_id bigint, coarse string, embedding array<double>"), str(tmp_path / "c"), target=10, most=20)
    got = found.collect()
    assert sorted(g["proposal_id"] for g in got) == list(range(120)) and failed.count() == 0 and not together.broken
    assert max(Counter((g["coarse"], g["bucket"]) for g in got).values()) <= 20 and set(parts) == {1}
