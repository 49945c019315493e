"""Density clusters against the definition, from the whole set down; deep hierarchies; principal components against a decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from frameloom.operators.vectors import density_labels
from frameloom.plans import review_queries
from frameloom.plans import views as V


def parts_below(table, members, limit):
    """Connected parts of ``members`` by distances below ``limit``."""
    left, out = set(members), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            i = todo.pop()
            part.append(i)
            near = {j for j in left if table[i, j] < limit}
            left -= near
            todo += near
        out.append(sorted(part))
    return out


def by_definition(points, min_size, min_samples):
    """Clusters by taking distances away from the largest down; no ties between levels."""
    n = len(points)
    labels, strength, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    if n < max(2, min_size):
        return labels, strength, outlier
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    core = np.sort(dist, axis=1)[:, min(min_samples, n - 1)]
    table = np.maximum(dist, np.maximum(core[:, None], core[None]))
    clusters = []

    def follow(members, birth, parent):
        me = len(clusters)
        clusters.append({"leaves": {}, "birth": birth, "kids": [], "members": list(members)})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        while members:
            limit = next((t for t in sorted({table[i, j] for i in members for j in members if i < j}, reverse=True) if len(parts_below(table, members, t)) > 1), None)
            level = 1 / max(limit, 1e-12)
            parts = parts_below(table, members, limit)
            large = [p for p in parts if len(p) >= min_size]
            for i in (i for p in parts if len(p) < min_size or len(large) > 1 for i in p):
                clusters[me]["leaves"][i] = level
            if len(large) != 1:
                for p in large:
                    follow(p, level, me)
                return
            members = large[0]

    follow(list(range(n)), 0.0, None)
    deepest = {}

    def value(c):
        own = sum(level - clusters[c]["birth"] for level in clusters[c]["leaves"].values())
        below = sum(value(k) for k in clusters[c]["kids"])
        deepest[c] = max([*clusters[c]["leaves"].values(), *[deepest[k] for k in clusters[c]["kids"]]])
        clusters[c]["take"] = not clusters[c]["kids"] or (c > 0 and below <= own)
        return own if clusters[c]["take"] else below

    value(0)

    def pick(c):
        return [c] if clusters[c]["take"] else [x for k in clusters[c]["kids"] for x in pick(k)]

    for label, c in enumerate(sorted(pick(0), key=lambda c: min(clusters[c]["members"]))):
        top = max(clusters[c]["leaves"].values())
        for i in clusters[c]["members"]:
            labels[i], strength[i] = label, clusters[c]["leaves"][i] / top
    for c, cluster in enumerate(clusters):
        for i, level in cluster["leaves"].items():
            if not any(i in clusters[k]["members"] for k in cluster["kids"]):
                outlier[i] = (deepest[c] - level) / deepest[c]
    return labels, strength, outlier


@pytest.mark.parametrize("seed", range(12))
def test_density_equals_the_definition(seed):
    r = np.random.default_rng(seed)
    points = r.normal(0, 1, (int(r.integers(2, 45)), 2)) + r.integers(0, 3, (1, 1)) + r.integers(0, 4, 1) * (r.random((1, 2)) < 0.5)
    points = np.concatenate([points, r.normal(6, 0.4, (int(r.integers(0, 15)), 2))])
    size, samples = int(r.integers(2, 7)), 1  # more samples make equal distances, whose order is free
    for got, want in zip(density_labels(points, size, samples), by_definition(points, size, samples), strict=True):
        assert np.allclose(got, want)


@pytest.mark.parametrize("seed", range(6))
def test_weights_are_copies(seed):
    r = np.random.default_rng(seed)
    points, weights = r.normal(0, 1, (30, 2)), r.choice([1, 1, 2, 6], 30)
    labels, strength, outlier = density_labels(points, 5, 3, weights)
    again = density_labels(np.repeat(points, weights, axis=0), 5, 3)
    assert np.array_equal(np.repeat(labels, weights), again[0])


def test_deep_hierarchies():
    """1,200 groups, each nested in the next one."""
    places = np.cumsum(1.01 ** np.arange(1200))
    points = np.repeat(places, 5)[:, None] + np.tile(np.array([0, 1, 2.1, 3.3, 4.6]) * 1e-3, 1200)[:, None]
    labels, strength, outlier = density_labels(points, 5, 2)
    assert (labels == np.repeat(np.arange(1200), 5)).all() and 0 < strength.min() <= 1 and 0 <= outlier.min() <= outlier.max() < 1


def test_principal_components_keep_what_a_decomposition_keeps(spark, small):
    rows = V.proposals(spark, small).select("proposal_id", "embedding").collect()
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    centred = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    length = dict(zip([r["proposal_id"] for r in rows], np.linalg.norm(centred @ axes[:8].T, axis=1), strict=True))
    got = review_queries.principal_components(spark, small).collect()
    assert len(got) == len(rows) and all(r["size"] == 8 and r["length"] == pytest.approx(length[r["proposal_id"]], abs=1e-4) for r in got)
