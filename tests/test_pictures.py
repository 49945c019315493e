"""Overlays, free proposals, components and clusters against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import masks, perframe, rasters, vectors
from frameloom.plans import views as V


def test_overlays(spark):
    frames = spark.createDataFrame([(0, i, bytes(3 * 10 * 12), 10, 12) for i in range(2)], "video_id bigint, frame_idx bigint, image binary, height int, width int")
    boxes = spark.createDataFrame([(0, 0, 1, "pot", 1.0, 1.0, 6.0, 5.0), (0, 0, 2, "lid", -3.0, 3.0, 4.0, 20.0)], "video_id bigint, frame_idx bigint, det_id bigint, label string, x1 double, y1 double, x2 double, y2 double")
    got = {r["frame_idx"]: np.frombuffer(r["image"], np.uint8).reshape(10, 12, 3) for r in rasters.overlays(frames, boxes).collect()}
    assert not got[1].any()
    lit = got[0].any(axis=2)
    want = np.zeros((10, 12), dtype=bool)
    want[1, 1:6] = want[4, 1:6] = want[1:5, 1] = want[1:5, 5] = True
    want[3, 0:4] = want[3:10, 3] = True  # the second box reaches out on the left and below
    assert (lit == want).all()
    assert len(np.unique(got[0][lit], axis=0)) == 2 and tuple(got[0][3, 1]) == tuple(got[0][3, 0])  # the later box lies above
    assert rasters.overlays(frames.limit(0), boxes).count() == 0


def test_free_proposals(spark):
    r = np.random.default_rng(7)
    rows, want = [], {}
    for f in range(8):
        pictures = [(np.kron(r.random((4, 5)) < 0.45, np.ones((3, 4)))).astype(np.uint8) for _ in range(6)]
        taken = [i for i in range(6) if r.random() < 0.4]
        union = np.zeros_like(pictures[0])
        for i in taken:
            union |= pictures[i]
        sure = [float(r.integers(1, 4)) / 4 for _ in range(6)]
        rows += [(10 * f + i, 0, f, sure[i], i in taken, masks.encode(m)) for i, m in enumerate(pictures)]
        left = [(sure[i], int((m & ~union & 1).sum()), 10 * f + i) for i, m in enumerate(pictures) if i not in taken]
        left = sorted((x for x in left if x[1] >= 5), key=lambda x: (-x[0], -x[1], x[2]))
        want |= {d: (free, n) for n, (_, free, d) in enumerate(left, 1)}
    d = spark.createDataFrame(rows, f"det_id bigint, video_id bigint, frame_idx bigint, confidence double, used boolean, runs {masks.RUNS}")
    assert {x["det_id"]: (x["free"], x["rank"]) for x in perframe.free_proposals(d, F.col("used"), 5).collect()} == want


def test_components_equal_numpy(spark, small):
    p = V.proposals(spark, small)
    rows = vectors.principal(p, "embedding", 5).select("proposal_id", "embedding", "reduced").orderBy("proposal_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = np.array([r["reduced"] for r in rows])
    _, scale, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:5].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6 * scale[0])


def test_every_row_is_in_its_nearest_cluster(spark, small):
    rows = vectors.kmeans(V.proposals(spark, small), "embedding", 6).select("embedding", "cluster").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["cluster"] for r in rows])
    centres = np.stack([x[label == k].mean(axis=0) for k in range(6)])
    near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (near.argmin(axis=1) == label).mean() > 0.97  # the last step moves the centres once more
    worst = ((x - x.mean(axis=0)) ** 2).sum()
    assert near[np.arange(len(x)), label].sum() < worst


def test_layout_needs_its_library(spark, small):
    pytest.importorskip("pyspark")
    try:
        import umap  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="umap-learn"):
            vectors.layout(V.proposals(spark, small), "embedding")


def test_index_recall(spark):
    """Of the true neighbours of rows with ids divisible by 50, nine in ten are found; a third of all rows is one vector."""
    from frameloom.plans.review_queries import _neighbours

    want, _ = _neighbours(spark, "/root/testdata/sf0.1")
    got, _ = _neighbours(spark, "/root/testdata/sf0.1", search=vectors.nearest_indexed)
    true = {(r["query_id"], r["memory_id"]) for r in want.collect()}
    found = {(r["query_id"], r["memory_id"]): r["similarity"] for r in got.collect()}
    assert len(true & found.keys()) / len(true) >= 0.9
    exact = {(r["query_id"], r["memory_id"]): r["similarity"] for r in want.collect()}
    assert all(found[p] == pytest.approx(exact[p], abs=1e-8) for p in true & found.keys())


def test_index_with_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(0)
    rows = [(i, "pot", "keep", ([1.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=3).tolist())) for i in range(150)]
    m = spark.createDataFrame(rows, "memory_id bigint, label string, action string, vector array<double>")
    q = m.where("memory_id % 50 = 0").select(F.col("memory_id").alias("query_id"), F.col("label").alias("query_class"), "vector")
    plain = lambda d: sorted((x["query_id"], x["rank"], x["memory_id"]) for x in d.collect())
    assert plain(vectors.nearest_indexed(q, m, 4, lists=5, probes=5)) == plain(vectors.nearest(q, m, 4))
    assert vectors.nearest_indexed(q, m.limit(0), 4).count() == 0
