"""Order-dependent operators: small goldens, invariants, and equal results in batch and stream."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from frameloom.operators import masks, vectors
from frameloom.plans import stateful_queries as Q
from frameloom.streaming import frames, steps


def row(i, frame=0, box=(0, 0, 10, 10), label="pot", coarse="cookware", confidence=0.9, track=None, source="yolo_world", confirmed=True):
    return {"det_id": i, "video_id": 0, "frame_idx": frame, "raw_label": label, "coarse": coarse, "confidence": confidence, "track_id": track, "source": source, "confirmed": confirmed, **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True))}


def test_smoothing_golden():
    smooth, state, out = steps.Smooth(), {}, []
    for i, (label, c) in enumerate([("pot", 0.5)] * 4 + [("pan", 0.9)] * 3):
        out += smooth(state, [row(i, i, coarse=label, confidence=c, track=1)])
    assert [r["smoothed"] for r in out] == ["pot"] * 5 + ["pan"] * 2


def test_smoothing_ignores_unconfirmed_rows():
    smooth, state = steps.Smooth(), {}
    assert smooth(state, [row(1, track=1, confirmed=False), row(2, track=-1)]) == [{**row(1, track=1, confirmed=False), "smoothed": None}, {**row(2, track=-1), "smoothed": None}]
    assert not state


def test_matching_is_optimal():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        scores = [[r.random() for _ in range(m)] for _ in range(n)]
        got = steps.matched(scores, 0.3)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(scores[i][j] >= 0.3 for i, j in got)
        best = 0.0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    if all(scores[i][j] >= 0.3 for i, j in zip(rows, cols, strict=True)):
                        best = max(best, sum(scores[i][j] for i, j in zip(rows, cols, strict=True)))
        assert sum(scores[i][j] for i, j in got) == pytest.approx(best)


def test_persistence_ends():
    persist, state, seen = steps.Persist(), {}, []
    for f in range(3):
        persist(state, [row(f, f, track=7)])
    for f in range(3, 12):
        seen += [(r["frame_idx"], round(r["confidence"], 4), r["confirmed"]) for r in persist(state, [row(100 + f, f, box=(80, 80, 90, 90), track=8)]) if r["track_id"] == 7]
    assert seen == [(3, 0.828, True), (4, 0.7618, True), (5, 0.7008, False), (6, 0.6448, False)]


def test_reassignment_is_one_to_one():
    again, state = steps.Reassign(), {}
    again(state, [row(1, 0, track=3)])
    out = again(state, [row(2, 2, track=None), row(3, 2, track=None)])
    assert [(r["track_id"], r["reassigned"]) for r in out] == [(3, True), (None, False)]
    assert again(state, [row(4, 9, track=None)])[0]["track_id"] is None


def test_occlusion_lasts():
    state, step = {}, steps.Occlusion()
    step(state, [row(i, 0, box=(i * 10, 0, i * 10 + 10, 10), track=i) for i in range(3)])
    out = [step(state, [row(10 + f, f, box=(0, 0, 30, 10), label="hand", coarse="hand")] if f == 1 else [row(10 + f, f, box=(90, 90, 99, 99), track=50)])[0] for f in range(1, 12)]
    assert [r["occluded"] for r in out] == [True] * 9 + [False] * 2 and out[0]["affected"] == 3


@pytest.mark.parametrize(("step", "extra"), [(steps.Smooth, "smoothed string"), (steps.SimpleTracker, "assigned bigint"), (steps.TwoStageTracker, "assigned bigint"), (steps.Reassign, "track_id bigint, reassigned boolean"), (steps.Persist, "track_id bigint, source string, confidence double, persisted_age int"), (steps.MaskCache, "cached boolean")])
def test_stream_equals_batch(spark, small, tmp_path, step, extra):
    d = Q.flat(spark, small).where("frame_idx < 12")
    schema = f"{Q.IDS}, {extra}"
    last = d.selectExpr("*", "frame_idx >= 11 as last")
    source = tmp_path / "in"
    for part in range(3):  # three files, three batches
        last.where(f"frame_idx div 4 = {part}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = frames.in_stream(stream, step, schema, "video_id").writeStream.format("memory").queryName(f"s_{step.__name__}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table(f"s_{step.__name__}").collect()))
    want = sorted(map(tuple, frames.by_frame(d, step, schema, ["video_id"]).collect()))
    assert got == want and got


def test_masks_round_trip():
    r = np.random.default_rng(0)
    for _ in range(30):
        m = (r.random((9, 13)) < 0.4).astype(np.uint8)
        assert (masks.decode(masks.encode(m), 9, 13) == m).all()
        labels, n = masks.components(m)
        assert (labels > 0).sum() == m.sum() and masks.largest_part(m).sum() == (np.bincount(labels[labels > 0]).max() if n else 0)
        assert (masks.filled(m) >= m).all() and (masks.closed(m, 3) >= m).all() and (masks.without_small(m, 3) <= m).all()
    ring = np.ones((5, 5), np.uint8)
    ring[2, 2] = 0
    assert masks.filled(ring).all() and not masks.filled(ring, 0).all()
    assert masks.components(np.eye(4))[1] == 1 and masks.components(np.eye(4), diagonal=False)[1] == 4


def test_density_clusters_find_blobs():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(c, 0.05, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [r.uniform(-6, 9, (6, 2))])
    labels, strength, outlier = vectors.density_labels(points, 10, 5)
    assert [len(set(labels[i * 40 : i * 40 + 40]) - {-1}) for i in range(3)] == [1, 1, 1] and len(set(labels) - {-1}) == 3
    assert (labels[120:] == -1).sum() >= 4 and strength.max() <= 1 and outlier.min() >= 0
    assert (vectors.density_labels(points[:3], 10, 5)[0] == -1).all()
