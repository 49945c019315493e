"""Plane motions under outliers, and anchors and masks that follow them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import homography as H
from frameloom.plans import online_queries as Q


def motion_of(r):
    return np.array([[1 + r.normal(0, 0.03), r.normal(0, 0.03), r.normal(0, 8)], [r.normal(0, 0.03), 1 + r.normal(0, 0.03), r.normal(0, 8)], [r.normal(0, 2e-5), r.normal(0, 2e-5), 1]])


@pytest.mark.parametrize("bad", [0.0, 0.4, 0.6])
def test_a_known_motion_is_found_among_outliers(bad):
    r = np.random.default_rng(int(bad * 10))
    for seed in range(10):
        motion, source = motion_of(r), r.uniform((0, 0), (640, 480), (120, 2))
        target = H.moved(motion, source)
        wrong = r.random(120) < bad
        target[wrong] += r.choice([-1, 1], (wrong.sum(), 2)) * r.uniform(20, 200, (wrong.sum(), 2))
        found, inside = H.estimated(source, target, seed=seed)
        assert (inside == ~wrong).all() and np.abs(found - motion).max() < 1e-6
        noisy, inside = H.estimated(source, target + r.normal(0, 0.5, target.shape), seed=seed)
        square = np.array([[0, 0], [640, 0], [640, 480], [0, 480.0]])
        assert np.abs(H.moved(noisy, square) - H.moved(motion, square)).max() < 3 and inside[~wrong].all()


def test_too_few_or_odd_points():
    assert H.estimated(np.zeros((3, 2)), np.zeros((3, 2)))[0] is None
    line = np.stack([np.arange(9.0), np.arange(9.0)], axis=1)
    found, inside = H.estimated(line, line + 5)  # points of one line fix no plane motion, but no error follows
    assert found is None or np.isfinite(H.moved(found, line)[inside]).all()
    scattered = np.random.default_rng(0)
    assert H.estimated(scattered.uniform(0, 500, (5, 2)), scattered.uniform(0, 500, (5, 2)))[1].sum() in (0, 4, 5)


def test_anchors_follow_products_of_motions():
    r = np.random.default_rng(3)
    step, state, total = H.Anchors(640, 480), {}, np.eye(3)
    corners = [100, 100, 300, 100, 300, 250, 100, 250]
    assert step(state, [{"video_id": 0, "frame_idx": 0, "label": None, "motion": None, "polygon": None, "confidence": None}]) == []
    first = step(state, [{"video_id": 0, "frame_idx": 1, "label": "sink", "motion": None, "polygon": corners, "confidence": 0.5}, {"video_id": 0, "frame_idx": 1, "label": "wall", "motion": None, "polygon": [1, 1, 2, 2], "confidence": 0.5}])
    assert [(a["label"], a["x1"], a["x2"], a["age"]) for a in first] == [("sink", 100, 301, 0)]
    for f in range(2, 9):
        motion = motion_of(r) if f != 5 else None
        total = total if motion is None else motion @ total
        (out,) = step(state, [{"video_id": 0, "frame_idx": f, "label": None, "motion": None if motion is None else motion.ravel().tolist(), "polygon": None, "confidence": None}])
        want = np.clip(H.moved(total, np.reshape(corners, (-1, 2)).astype(float)), 0, (639, 479))
        assert np.allclose(np.reshape(out["polygon"], (-1, 2)), want) and out["age"] == f - 1
        assert (out["x2"], out["y1"]) == (pytest.approx(want[:, 0].max() + 1), pytest.approx(want[:, 1].min()))


def test_masks_are_carried_along(spark):
    mask = np.zeros((40, 60), dtype=np.uint8)
    mask[10:20, 15:30] = 1
    shift = np.array([[1, 0, 7.0], [0, 1, 3.0], [0, 0, 1]])
    assert (H.warped(mask, shift)[13:23, 22:37] == 1).all() and H.warped(mask, shift).sum() == 150
    assert H.warped(mask, np.array([[1, 0, 40.0], [0, 1, 0], [0, 0, 1]])).sum() == 5 * 10  # beyond the border
    runs = [v for y in range(10, 20) for v in (y * 60 + 15, 15)]
    d = spark.createDataFrame([(1, runs, shift.ravel().tolist()), (2, runs, None), (3, None, shift.ravel().tolist())], "id int, mask array<long>, motion array<double>")
    got = {r["id"]: r["mask"] for r in H.warped_masks(d, 60, 40).collect()}
    assert got == {1: [v for y in range(13, 23) for v in (y * 60 + 22, 15)], 2: runs, 3: None}


def test_motions_of_a_table(spark, small):
    points = Q.matched_points(spark, small)
    found = H.motions(points.unionByName(points.limit(2).select("video_id", "frame_idx", "x", "y", F.lit(None).cast("double").alias("u"), "v")))
    rows = found.collect()
    assert len(rows) == points.select("video_id", "frame_idx").distinct().count() and all(0.5 * r["n"] < r["inliers"] < 0.8 * r["n"] for r in rows)
    again = {(r["video_id"], r["frame_idx"]): r["motion"] for r in H.motions(points.repartition(7)).collect()}
    assert again == {(r["video_id"], r["frame_idx"]): r["motion"] for r in H.motions(points).collect()}
