"""Proposals from a frame's contours, where no detector is at hand.

Edges are found as by Canny: differences of neighbouring rows and columns
(Sobel), only the ridges of their strength across the edge, strong ones (above
``high``) and weak ones (above ``low``) that touch a strong one through others.
Each connected run of edge pixels is a contour. The twelve of the largest
enclosed area become boxes, small ones go, and labels are dealt in turn by rank.

Pictures are grey values in a binary column with height and width; a task reads
its own rows, and what leaves it are a few boxes of a frame. Scores and labels
are Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.masks import components, filled


def gradients(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences along x and y, weighted 1 2 1 across; the border repeats its pixels mirrored."""
    g = np.pad(np.asarray(grey, dtype=np.int64), 1, mode="reflect") if min(np.shape(grey)) > 1 else np.pad(np.asarray(grey, dtype=np.int64), 1, mode="edge")
    dx, dy = g[:, 2:] - g[:, :-2], g[2:, :] - g[:-2, :]
    return dx[:-2] + 2 * dx[1:-1] + dx[2:], dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]


def edges(grey: np.ndarray, low: int = 80, high: int = 160) -> np.ndarray:
    """Edge pixels: ridges of |dx| + |dy| above ``low`` that belong to a run with one above ``high``."""
    dx, dy = gradients(grey)
    size = np.abs(dx) + np.abs(dy)
    s = np.pad(size, 1)
    at = lambda y, x: s[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]]
    ax, ay = np.abs(dx), np.abs(dy)
    # sectors by the tangents of 22.5 and 67.5 degrees
    flat, steep = ay < ax * 0.41421356237309503, ay > ax * 2.414213562373095
    same = (dx ^ dy) >= 0
    # of two equal neighbours one stays: the test is strict on one side
    ridge = np.select(
        [flat, steep, same],
        [(size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0)), (size > at(-1, -1)) & (size > at(1, 1))],
        (size > at(-1, 1)) & (size > at(1, -1)),
    )
    weak = ridge & (size > low)
    labels, n = components(weak)
    strong = np.zeros(n + 1, dtype=bool)
    strong[np.unique(labels[weak & (size > high)])] = True
    strong[0] = False
    return strong[labels]


def contours(grey: np.ndarray, low: int = 80, high: int = 160) -> list[tuple[float, int, int, int, int]]:
    """(enclosed area, x1, y1, x2, y2) of every outer contour, the largest area first; contours inside another are no outer ones."""
    found = edges(grey, low, high)
    solid = filled(found) > 0
    labels, n = components(solid)
    ys, xs = np.nonzero(labels)
    names, size = labels[ys, xs], max(labels.shape)
    x1, y1, x2, y2 = np.full(n + 1, size), np.full(n + 1, size), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for ends, at, values in ((x1, np.minimum, xs), (y1, np.minimum, ys), (x2, np.maximum, xs + 1), (y2, np.maximum, ys + 1)):
        at.at(ends, names, values)
    out = zip(_enclosed(labels, n)[1:].tolist(), *(e[1:].tolist() for e in (x1, y1, x2, y2)), strict=True)
    return sorted(out, key=lambda c: (-c[0], c[2], c[1]))


def _enclosed(labels: np.ndarray, n: int) -> np.ndarray:
    """For each part (without holes) the area of the polygon through the middles of its border pixels: squares of four pixels count one, of three a half. The pixels of a square touch, so they are one part's."""
    p = np.pad(labels, 1)
    corners = np.stack([p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]])
    four = (corners > 0).sum(axis=0)
    return np.bincount(corners.max(axis=0).ravel(), weights=((four == 4) + 0.5 * (four == 3)).ravel(), minlength=n + 1)


def boxes(frames: DataFrame, low: int = 80, high: int = 160, most: int = 12, least_area: int = 300, least_side: int = 8) -> DataFrame:
    """(video_id, frame_idx, rank, x1, y1, x2, y2, area): boxes of a frame's largest contours; ``rank`` counts from 0 and includes small ones that went."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for video, frame, image, h, w in zip(batch["video_id"], batch["frame_idx"], batch["image"], batch["height"], batch["width"], strict=True):
                if image is None or h * w == 0:
                    continue
                grey = np.frombuffer(image, dtype=np.uint8).reshape(h, w)
                for rank, (area, x1, y1, x2, y2) in enumerate(contours(grey, low, high)[:most]):
                    if (x2 - x1) * (y2 - y1) >= least_area and x2 - x1 >= least_side and y2 - y1 >= least_side:
                        rows.append((video, frame, rank, float(x1), float(y1), float(x2), float(y2), area))
            yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "rank", "x1", "y1", "x2", "y2", "area"])

    return frames.select("video_id", "frame_idx", "image", "height", "width").mapInPandas(run, "video_id long, frame_idx long, rank int, x1 double, y1 double, x2 double, y2 double, area double")


def score(x1: Column, y1: Column, x2: Column, y2: Column, frame_area: Column, threshold: float = 0.2) -> Column:
    """.2 and five times the share of the frame, between the threshold and .95."""
    return F.least(F.lit(0.95), F.greatest(F.lit(threshold), 0.2 + (x2 - x1) * (y2 - y1) / F.greatest(F.lit(1.0), frame_area) * 5.0))


def proposals(frames: DataFrame, labels: list[str], threshold: float = 0.2, **options) -> DataFrame:
    """Boxes with a label (in turn by rank; blank ones don't count, ``object`` without any) and a score."""
    names = [x.strip() for x in labels if x.strip()] or ["object"]
    areas = frames.select("video_id", "frame_idx", (F.col("height") * F.col("width")).cast("double").alias("_size"))
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("rank") % len(names) + 1).cast("int"))
    rows = boxes(frames, **options).join(areas, ["video_id", "frame_idx"])
    return rows.withColumns({"label": named, "score": score(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("_size"), threshold), "source": F.lit("mock_groundingdino")}).drop("_size")
