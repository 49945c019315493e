"""Masks as runs: array of (start, length) of set pixels in row order, in Column expressions.

Runs of one mask are apart and ascending; a mask keeps its height and width in
other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<s: bigint, n: bigint>>"


def of_box(bbox: Column, width: int) -> Column:
    """The runs of a box's pixels."""
    x1, x2 = F.floor(bbox["x1"]).cast("bigint"), F.floor(bbox["x2"]).cast("bigint")
    y1, y2 = F.floor(bbox["y1"]).cast("bigint"), F.floor(bbox["y2"]).cast("bigint")
    rows = F.when(y2 > y1, F.sequence(y1, y2 - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(rows, lambda y: F.struct((y * width + x1).alias("s"), (x2 - x1).alias("n")))


def area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["n"])


def intersection(a: Column, b: Column) -> Column:
    """Common pixels: each run of one against the runs of the other that reach it."""
    zero = F.lit(0).cast("bigint")
    common = lambda p, q: F.greatest(zero, F.least(p["s"] + p["n"], q["s"] + q["n"]) - F.greatest(p["s"], q["s"]))
    return F.aggregate(a, zero, lambda total, p: total + F.aggregate(F.filter(b, lambda q: (q["s"] < p["s"] + p["n"]) & (q["s"] + q["n"] > p["s"])), zero, lambda t, q: t + common(p, q)))


def iou(a: Column, b: Column) -> Column:
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def tight_box(runs: Column, width: int) -> Column:
    """Box around the set pixels; null for an empty mask. Runs must not cross rows."""
    first = lambda r: r["s"] % width
    return F.when(
        F.size(runs) > 0,
        F.struct(
            F.array_min(F.transform(runs, first)).cast("double").alias("x1"),
            F.floor(F.array_min(F.transform(runs, lambda r: r["s"])) / width).cast("double").alias("y1"),
            F.array_max(F.transform(runs, lambda r: first(r) + r["n"])).cast("double").alias("x2"),
            (F.floor(F.array_max(F.transform(runs, lambda r: r["s"])) / width) + 1).cast("double").alias("y2"),
        ),
    )


def encode(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of an array of zero and other values."""
    flat = np.r_[False, np.asarray(mask).ravel() > 0, False]
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def once(f: Callable, most: int = 1024) -> Callable:
    """f of arrays, worked out once for equal ones (type, shape and bytes); the last ``most`` results stay. f changes no array."""

    @lru_cache(maxsize=most)
    def of(*parts):
        return f(*[np.frombuffer(raw, kind).reshape(shape) for raw, kind, shape in parts])

    return lambda *arrays: of(*[(a.tobytes(), a.dtype.str, a.shape) for a in arrays])


def decode(runs, height: int, width: int) -> np.ndarray:
    out = np.zeros(height * width, dtype=np.uint8)
    for start, n in runs:
        out[start : start + n] = 1
    return out.reshape(height, width)


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Numbered connected parts (from 1) and how many, by the runs of neighbouring rows."""
    mask = np.asarray(mask) > 0
    labels = np.zeros(mask.shape, dtype=np.int32)
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    reach = 1 if diagonal else 0
    for y, row in enumerate(mask):
        now = []
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            touching = [find(i) for s, e, i in before if s < b + reach and e > a - reach]
            if touching:
                name = min(touching)
                for i in touching:
                    parent[i] = name
            else:
                name = len(parent)
                parent.append(name)
            labels[y, a:b] = name
            now.append((int(a), int(b), name))
        before = now
    roots = np.array([find(i) for i in range(len(parent))])
    known, numbered = np.unique(roots, return_inverse=True)
    return numbered[labels], len(known) - 1


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """Grown by a square of odd size; shrunk is the complement of the grown complement."""
    mask, half = np.asarray(mask) > 0, size // 2
    padded = np.pad(mask, half)
    out = np.zeros_like(mask)
    for dy in range(size):
        for dx in range(size):
            out |= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out.astype(np.uint8)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    """Gaps narrower than the square filled."""
    half = size // 2
    grown = dilated(np.pad(np.asarray(mask) > 0, half), size)
    return (1 - dilated(1 - grown, size))[half:-half or None, half:-half or None].astype(np.uint8)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels, n = components(mask)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    keep = sizes >= least
    keep[0] = False
    return keep[labels].astype(np.uint8)


def largest_part(mask: np.ndarray) -> np.ndarray:
    labels, n = components(mask)
    if not n:
        return np.zeros(np.shape(mask), np.uint8)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    sizes[0] = 0
    return (labels == sizes.argmax()).astype(np.uint8)


def filled(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """Holes (parts of the background that don't touch the border) of ``most`` pixels or fewer filled."""
    mask = np.asarray(mask) > 0
    labels, n = components(~mask, diagonal=False)
    border = np.unique(np.r_[labels[0], labels[-1], labels[:, 0], labels[:, -1]])
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    hole = np.ones(n + 1, dtype=bool)
    hole[border] = hole[0] = False
    if most is not None:
        hole &= sizes <= most
    return (mask | hole[labels]).astype(np.uint8)


def outlines(mask: np.ndarray, most: int = 8) -> list[list[float]]:
    """Outer outlines of a mask's parts as flat x y rings along pixel borders, the largest first."""
    labels, n = components(mask)
    rings = []
    for part in range(1, n + 1):
        cell = np.pad(labels == part, 1)
        turns: dict[tuple[int, int], list[tuple[int, int]]] = {}
        ys, xs = np.nonzero(cell)
        for y, x in zip(ys.tolist(), xs.tolist(), strict=True):  # borders, the part on the right hand
            if not cell[y - 1, x]:
                turns.setdefault((x - 1, y - 1), []).append((x, y - 1))
            if not cell[y, x + 1]:
                turns.setdefault((x, y - 1), []).append((x, y))
            if not cell[y + 1, x]:
                turns.setdefault((x, y), []).append((x - 1, y))
            if not cell[y, x - 1]:
                turns.setdefault((x - 1, y), []).append((x - 1, y - 1))
        loops = []
        while turns:
            start = min(turns)
            at, before, ring = start, None, []
            while True:
                ways = turns[at]
                if before is not None and len(ways) > 1:  # where corners touch, keep to the left, so that the part stays whole
                    dx, dy = at[0] - before[0], at[1] - before[1]
                    ways.sort(key=lambda p: (p[0] - at[0]) * dy - (p[1] - at[1]) * dx)
                nxt = ways.pop()
                if not ways:
                    del turns[at]
                if before is None or (at[0] - before[0], at[1] - before[1]) != (nxt[0] - at[0], nxt[1] - at[1]):
                    ring.append(at)
                before, at = at, nxt
                if at == start:
                    break
            loops.append(ring)
        rings.append(max(loops, key=lambda r: abs(ring_area(r))))
    rings.sort(key=lambda r: -abs(ring_area(r)))
    return [[float(v) for point in r for v in point] for r in rings[:most]]


def ring_area(ring) -> float:
    """Signed area of (x, y) points."""
    points = np.asarray(ring, dtype=np.float64).reshape(-1, 2)
    x, y = points.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def tuned(mask: np.ndarray, grow: int) -> np.ndarray:
    """Grown or (negative) shrunk by so many pixels."""
    if not grow:
        return (np.asarray(mask) > 0).astype(np.uint8)
    size = 2 * abs(grow) + 1
    return dilated(mask, size) if grow > 0 else (1 - dilated(1 - (np.asarray(mask) > 0), size)).astype(np.uint8)


def smoothed(mask: np.ndarray, size: int = 3) -> np.ndarray:
    """The majority of each square."""
    half, m = size // 2, np.asarray(mask) > 0
    padded = np.pad(m, half, mode="edge")
    votes = sum(padded[dy : dy + m.shape[0], dx : dx + m.shape[1]].astype(np.int32) for dy in range(size) for dx in range(size))
    return (2 * votes > size * size).astype(np.uint8)


def refined(mask: np.ndarray, close: int = 5, smooth: int = 3, hole: int = 600) -> np.ndarray:
    """Gaps closed, edges smoothed, small holes filled."""
    return filled(smoothed(closed(mask, close), smooth), hole)


def box_mask(bbox, height: int, width: int) -> np.ndarray:
    x1, y1, x2, y2 = (int(v) for v in bbox)
    out = np.zeros((height, width), np.uint8)
    out[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = 1
    return out


def box_if_sparse(mask: np.ndarray, bbox, least: float = 0.05) -> np.ndarray:
    """The box instead of a mask that fills too little of it."""
    box = box_mask(bbox, *np.shape(mask))
    return box if (np.asarray(mask) > 0).sum() < least * max(1, box.sum()) else (np.asarray(mask) > 0).astype(np.uint8)


def uncovered(mask: np.ndarray) -> tuple[float, int]:
    """Share of pixels that are not set, and the size of their largest part."""
    empty = np.asarray(mask) == 0
    labels, n = components(empty)
    return float(empty.mean()) if empty.size else 0.0, int(np.bincount(labels[labels > 0]).max()) if n else 0


def regions(classes: np.ndarray, probability: np.ndarray, names: list[str], least_area: float = 0.03, least_confidence: float = 0.35) -> list[tuple]:
    """(label, pixels, mean probability, x1, y1, x2, y2) of each class of a map that is large and sure enough."""
    out = []
    for i, name in enumerate(names):
        there = classes == i
        n = int(there.sum())
        if n < max(1, least_area * classes.size) or probability[there].mean() < least_confidence:
            continue
        ys, xs = np.nonzero(there)
        out.append((name, n, float(probability[there].mean()), int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1))
    return out


def sample_points(mask: np.ndarray, most: int = 5) -> list[tuple[int, int]]:
    """Set pixels spread evenly over the mask, in row order."""
    ys, xs = np.nonzero(mask)
    if not len(xs):
        return []
    at = np.unique(np.linspace(0, len(xs) - 1, min(most, len(xs))).round().astype(int))
    return [(int(xs[i]), int(ys[i])) for i in at]
