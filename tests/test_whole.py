"""Queries cover whole tables: against SQL, or against brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from frameloom.operators import vectors
from frameloom.plans import fusion_queries, join_queries, review_queries, stateful_queries, track_queries  # noqa: F401
from frameloom.plans import views as V
from frameloom.plans.catalog import REGISTRY


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows_of(df, names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_segmented_boxes_take_every_detection(spark, duck, small):
    got = rows_of(REGISTRY["segmented_boxes"].build(spark, small), ["det_id", "pixels"])
    assert got == sorted(duck.execute(REGISTRY["segmented_boxes"].sql).fetchall())


def test_class_map_regions_take_every_detection(spark, duck, small):
    d = REGISTRY["class_map_regions"].build(spark, small).toPandas()
    assert sorted(set(d["det_id"])) == [r[0] for r in duck.execute("SELECT event_id FROM events ORDER BY 1").fetchall()]
    # the left strip is wall, the upper eight rows of the others sink, the rest floor
    right = 20 - d["det_id"] % 8
    for label, pixels in {"wall": (30 - right) * 20, "sink": right * 8, "floor": right * 12}.items():
        mine = d["label"] == label
        assert mine.sum() == d["det_id"].nunique() and (d.loc[mine, "pixels"] == pixels[mine]).all()


def test_raw_candidates_take_every_frame(spark, duck, small):
    got = {}
    for r in REGISTRY["raw_candidates"].build(spark, small).collect():
        got.setdefault((r["video_id"], r["frame_idx"]), []).append((r["seq"], r["label"], r["left_"], r["rank"]))
    sql = f"WITH {V.DET} SELECT video_id, frame_idx, det_id, {V.sql_normalize('raw_label')}, x1 / 0.5, confidence FROM det"
    found = {}
    for video, frame, seq, label, left, score in duck.execute(sql).fetchall():
        found.setdefault((video, frame), []).append((-score, seq, label, left))
    assert max(v for v, _ in found) > 0 and max(f for _, f in found) >= 20
    assert got.keys() == found.keys()
    for key, rows in found.items():
        best = sorted(r for r in rows if r[0] <= -0.9)[:2]
        want = [(seq, label, left, n) for n, (_, seq, label, left) in enumerate(best, 1)] or [(None, None, None, None)]
        assert sorted(got[key], key=str) == sorted(want, key=str)


def test_drawn_masks_take_every_detection(spark, duck, small):
    ids = [r[0] for r in duck.execute("SELECT event_id FROM events ORDER BY 1").fetchall()]
    depths = {r["det_id"]: r["area"] for r in REGISTRY["mask_depths"].build(spark, small).collect()}
    assert sorted(depths) == ids
    y, x = np.mgrid[0:24, 0:32]
    for i in ids:
        assert depths[i] == ((x - 10 - i % 8) ** 2 + (y - 12) ** 2 < 40 + i % 30).sum()
    assert sorted({r["frame_idx"] for r in REGISTRY["detected_blobs"].build(spark, small).collect()}) == ids


def test_mask_overlaps_take_every_frame(spark, duck, small):
    got = rows_of(REGISTRY["mask_overlaps"].build(spark, small), ["a_id", "b_id", "common", "iou"])
    want = sorted(duck.execute(REGISTRY["mask_overlaps"].sql).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


def test_spatial_grid_join_takes_every_frame(spark, duck, small):
    got = rows_of(REGISTRY["spatial_grid_join"].build(spark, small), ["a_id", "b_id", "iou"])
    want = sorted(duck.execute(REGISTRY["spatial_grid_join"].sql).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_replayed_review_folds_every_event(spark, duck, small):
    names = ["proposal_id", "cluster_id", "status", "label", "reason"]
    got = {r[0]: r for r in rows_of(REGISTRY["replayed_review"].build(spark, small), names)}
    head = f"WITH {V.PROP}, {review_queries.EVENTS}"
    state = {i: [i, c, "unreviewed", label, ""] for i, c, label in duck.execute(f"{head} SELECT proposal_id, cluster_id, human_label FROM prop").fetchall()}
    events = duck.execute(f"{head} SELECT kind, target, status, label, reason FROM ev ORDER BY seq").fetchall()
    assert len(events) == duck.execute("SELECT count(*) FROM events").fetchone()[0]
    for kind, target, status, label, reason in events:
        hit = [state[target]] if kind == "instance" and target in state else [s for s in state.values() if kind != "instance" and s[1] == target]
        for s in hit:
            if kind != "label":
                s[2], s[4] = status or s[2], reason or s[4]
                s[3] = (label or s[3]) if kind == "instance" else s[3]
            elif s[2] != "deleted":
                s[2], s[3] = status or "reviewed", label
    assert got == {i: tuple(s) for i, s in state.items()}


def test_density_clusters_take_copies(spark):
    r = np.random.default_rng(2)
    one, other = r.normal(size=8), r.normal(size=8)
    vectors_ = [one.tolist()] * 4100 + [(other + r.normal(0, 0.01, 8)).tolist() for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(vectors_)), "proposal_id bigint, embedding array<double>")
    rows = vectors.density_clusters(vectors.bucketed(d, "embedding", 400, 1500), ["bucket"], "embedding").collect()
    assert sorted(x["proposal_id"] for x in rows) == list(range(4130))
    assert len({(x["bucket"], x["local_cluster_id"]) for x in rows if x["proposal_id"] < 4100}) == 1
    assert all(x["local_cluster_id"] >= 0 for x in rows if x["proposal_id"] < 4100)


def test_density_labels_of_weighted_points_are_those_of_copies():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 0.3, (30, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [r.uniform(-6, 9, (8, 2))])
    weights = r.choice([1, 1, 2, 3, 9], len(points))
    copies = np.repeat(np.arange(len(points)), weights)
    plain = vectors.density_labels(points[copies], 10, 5)
    # a tie may part the copies of a vector, which a weighted point keeps together
    together = np.array([len(set(plain[0][copies == i])) == 1 for i in copies])
    assert (~together).sum() <= 3
    for whole in (4000, 10):
        for mine, theirs in zip(vectors.density_labels(points, 10, 5, weights, whole), plain, strict=True):
            assert mine[copies][together] == pytest.approx(theirs[together], abs=1e-6)
