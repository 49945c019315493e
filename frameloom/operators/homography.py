"""The plane motion between two frames from matched points, and scene anchors that follow it.

Points are matched elsewhere (a plug-in); a frame has a few hundred at most. A
motion is a 3 x 3 matrix on homogeneous points. It is estimated robustly: many
samples of four pairs are solved at once, the one whose motion carries the most
points to within ``reach`` pixels wins (ties: the least total distance), and
its inliers give the motion by least squares, as long as that gains inliers.
Samples come from a generator seeded by the frame, so a rerun gives the same.

Between two runs of the scene model anchors are carried along: the motions
since the run are multiplied frame by frame, and every corner of an anchor's
outline goes through the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import runlists


def _balance(points: np.ndarray) -> np.ndarray:
    """The matrix that moves points to mean 0 and mean distance sqrt(2), for stable solutions."""
    middle = points.mean(axis=-2)
    size = np.maximum(np.linalg.norm(points - middle[..., None, :], axis=-1).mean(axis=-1), 1e-9)
    s = np.sqrt(2) / size
    out = np.zeros((*points.shape[:-2], 3, 3))
    out[..., 0, 0] = out[..., 1, 1] = s
    out[..., :2, 2] = -s[..., None] * middle
    out[..., 2, 2] = 1
    return out


def moved(motion: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through one motion or a stack of them; points at infinity become NaN."""
    flat = points @ np.swapaxes(motion[..., :2], -1, -2) + motion[..., None, :, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(flat[..., 2:]) > 1e-12, flat[..., :2] / flat[..., 2:], np.nan)


def solved(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares motions of stacks of pairs (four or more each): stack x pairs x 2."""
    a, b = _balance(source), _balance(target)
    p, q = moved(a, source), moved(b, target)
    one, zero = np.ones(p.shape[:-1]), np.zeros(p.shape[:-1])
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=-1)], axis=-2)
    _, _, vt = np.linalg.svd(rows, full_matrices=rows.shape[-2] < 9)  # four pairs leave the last direction open
    h = np.linalg.inv(b) @ vt[..., -1, :].reshape(*rows.shape[:-2], 3, 3) @ a
    scale = h[..., 2:, 2:]
    return h / np.where(np.abs(scale) > 1e-12, scale, 1.0)


def _of_four(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Exact motions of stacks of four pairs: stack x 4 x 2. Three points on a line fix none; such motions hold no finite numbers or odd ones."""

    def basis(points: np.ndarray) -> np.ndarray:
        """The three first points as columns, weighed so that their sum is the fourth."""
        x, y = points[..., 0].T, points[..., 1].T
        turn = lambda i, j, k: (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
        weights = np.stack([turn(3, 1, 2), turn(0, 3, 2), turn(0, 1, 3)])
        return np.stack([x[:3] * weights, y[:3] * weights, weights])  # row, point, stack

    def adjugate(m: np.ndarray) -> np.ndarray:
        minor = lambda r, c: m[(r + 1) % 3, (c + 1) % 3] * m[(r + 2) % 3, (c + 2) % 3] - m[(r + 1) % 3, (c + 2) % 3] * m[(r + 2) % 3, (c + 1) % 3]
        return np.stack([np.stack([minor(r, c) for r in range(3)]) for c in range(3)])

    h = np.einsum("rks,kcs->src", basis(target), adjugate(basis(source)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return h / np.abs(h).max(axis=(1, 2), keepdims=True)


def _draws(r: np.random.Generator, samples: int, n: int) -> np.ndarray:
    """Four different numbers below n, as often as asked for."""
    out = np.floor(r.random((samples, 4)) * (n - np.arange(4))).astype(np.int64)
    for k in range(1, 4):  # the so-manieth of those that are left
        before = np.sort(out[:, :k], axis=1)
        for c in range(k):
            out[:, k] += out[:, k] >= before[:, c]
    return out


def estimated(source: np.ndarray, target: np.ndarray, reach: float = 5.0, samples: int = 512, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The motion that most pairs agree on and which do; None for fewer than four pairs or no agreement of four.

    512 samples find four good pairs among 40 % bad ones with a probability of
    1 - 5e-32, among 60 % bad ones still of 0.999998.
    """
    n = len(source)
    if n < 4:
        return None, np.zeros(n, dtype=bool)
    draw = _draws(np.random.default_rng(seed), samples, n)
    a, b = _balance(source), _balance(target)
    p, q = moved(a, source), moved(b, target)
    tried = np.linalg.inv(b) @ _of_four(p[draw], q[draw]) @ a
    tried = tried.transpose(1, 0, 2)  # row, motion, column
    points = np.concatenate([source, np.ones((n, 1))], axis=1).T
    most, least, best, inside = -1, np.inf, 0, np.zeros(n, dtype=bool)
    some = max(1, 8192 // n)  # at once: small tables, whose memory is used again
    for first in range(0, samples, some):
        x, y, z = (tried[:, first : first + some].reshape(-1, 3) @ points).reshape(3, -1, n)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            far = (x / z - target[:, 0]) ** 2 + (y / z - target[:, 1]) ** 2
            near = far <= reach * reach  # not where a place is no number
        hits = near.sum(axis=1)
        if (top := int(hits.max())) >= most:
            rows = np.flatnonzero(hits == top)
            close = np.sqrt(np.where(near[rows], far[rows], 0)).sum(axis=1)
            k = int(close.argmin())
            if top > most or close[k] < least:
                most, least, best, inside = top, close[k], first + int(rows[k]), near[rows[k]]
    if inside.sum() < 4:
        return None, np.zeros(n, dtype=bool)
    motion = tried[:, best] / (tried[2, best, 2] if abs(tried[2, best, 2]) > 1e-12 else 1.0)
    for _ in range(10):
        again = solved(source[inside][None], target[inside][None])[0]
        off = np.linalg.norm(moved(again, source) - target, axis=-1)
        now = np.where(np.isfinite(off), off, np.inf) <= reach
        if now.sum() < inside.sum():
            break
        motion = again
        if (now == inside).all():
            break
        inside = now
    return motion, inside


def motions(points: DataFrame, reach: float = 5.0, samples: int = 512) -> DataFrame:
    """(video_id, frame_idx, motion, inliers, n): from the frame before to this one; ``motion`` is null where none is found.

    ``points``: video_id, frame_idx, x, y (in the frame before), u, v (in this
    one). Rows with a null coordinate are left out. Frames are streamed in
    order of their keys, many to a batch.
    """
    names = ("x", "y", "u", "v")
    keys = ["video_id", "frame_idx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # of the newest frame, which the next batch may go on with
        at: tuple | None = None

        def ended() -> tuple:
            m = np.concatenate(held)
            m = m[~np.isnan(m).any(axis=1)]
            m = m[np.lexsort(m.T[::-1])]
            found, inside = estimated(m[:, :2], m[:, 2:], reach, samples, seed=abs(hash(at)) % 2**32)
            return *at, None if found is None else found.ravel().tolist(), int(inside.sum()), len(m)

        columns = [*keys, "motion", "inliers", "n"]
        for batch in batches:
            out = []
            ids, values = batch[keys].to_numpy(dtype=np.int64), batch[list(names)].to_numpy(dtype=np.float64)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else []
            for start, end in zip(starts, [*starts[1:], len(ids)], strict=True):
                here = tuple(ids[start].tolist())
                if here != at:
                    if held:
                        out.append(ended())
                    held, at = [], here
                held.append(values[start:end])
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([ended()], columns=columns)

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # long work on few bytes: small tasks are not put together
    dealt = points.select(*keys, *names).repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "video_id long, frame_idx long, motion array<double>, inliers int, n int")


class Anchors:
    """A step: outlines of the scene, replaced where the model ran and carried along elsewhere.

    A frame has one row without ``label`` that holds its ``motion`` (nine
    numbers; null: nothing moved), and, where the model ran, one row for each
    of its labels with ``polygon`` (x, y, x, y, …) and ``confidence``. Outlines
    of fewer than three corners are no anchors. Out come the anchors, their
    corners moved and kept inside the frame, with their boxes; ``age`` counts
    frames since the run.
    """

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        fresh = [r for r in rows if r["label"] is not None]
        now = rows[0]["frame_idx"]
        if fresh:
            kept = {r["label"]: (np.reshape(np.asarray(r["polygon"], dtype=np.float64), (-1, 2)), r["confidence"]) for r in fresh if r["polygon"] is not None and len(r["polygon"]) >= 6}
            state["anchors"] = [(label, confidence) for label, (_, confidence) in kept.items()]
            outlines = [points for points, _ in kept.values()]  # all corners are one table, which is moved at once
            state["corners"], state["starts"] = np.concatenate(outlines) if outlines else None, np.cumsum([0, *map(len, outlines)]).tolist()
            state["motion"], state["since"] = np.eye(3).ravel().tolist(), now
        else:
            motion = next((r["motion"] for r in rows if r["motion"] is not None), None)
            if motion is not None and "motion" in state:
                state["motion"] = (np.reshape(motion, (3, 3)) @ np.reshape(state["motion"], (3, 3))).ravel().tolist()
        if not state.get("anchors"):
            return []
        points, starts = moved(np.reshape(state["motion"], (3, 3)), state["corners"]), state["starts"]
        points = np.minimum(np.maximum(np.nan_to_num(points), 0), (self.width - 1, self.height - 1))
        low, high = np.minimum.reduceat(points, starts[:-1], axis=0).tolist(), (np.maximum.reduceat(points, starts[:-1], axis=0) + 1).tolist()
        flat, fixed = points.ravel().tolist(), {"video_id": rows[0]["video_id"], "frame_idx": now}
        out = []
        for k, (label, confidence) in enumerate(state["anchors"]):
            (x1, y1), (x2, y2) = low[k], high[k]
            out.append({**fixed, "label": label, "confidence": confidence, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "polygon": flat[2 * starts[k] : 2 * starts[k + 1]], "age": now - state["since"]})
        return out


ANCHORS = "video_id long, frame_idx long, label string, confidence double, x1 double, y1 double, x2 double, y2 double, polygon array<double>, age long"


def warped(mask: np.ndarray, motion: np.ndarray) -> np.ndarray:
    """A mask carried along: every pixel takes the value of the place it came from, rounded; 0 from outside."""
    h, w = mask.shape
    places = np.stack(np.meshgrid(np.arange(w), np.arange(h)), axis=-1).reshape(-1, 2).astype(np.float64)
    back = moved(np.linalg.inv(motion), places)
    back = np.rint(np.where(np.isfinite(back), back, -1)).astype(np.int64)
    inside = (back >= 0).all(axis=1) & (back[:, 0] < w) & (back[:, 1] < h)
    out = np.zeros(h * w, dtype=mask.dtype)
    out[inside] = mask[back[inside, 1], back[inside, 0]]
    return out.reshape(h, w)


def warped_masks(masks: DataFrame, width: int, height: int) -> DataFrame:
    """Masks (start, length, start, …, one mask after the other in column ``mask``) carried by the row's ``motion``; null motions change nothing. Other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for mask, motion in zip(batch["mask"], batch["motion"], strict=True):
                if mask is None or motion is None or not len(mask):
                    out.append(mask)
                    continue
                pixels = np.zeros(width * height, dtype=np.uint8)
                for s, n in zip(mask[::2], mask[1::2], strict=True):
                    pixels[s : s + n] = 1
                flat = np.r_[0, warped(pixels.reshape(height, width), np.reshape(motion, (3, 3))).ravel(), 0]
                turns = np.flatnonzero(np.diff(flat))
                parts = runlists.by_row(list(zip(turns[::2].tolist(), (turns[1::2] - turns[::2]).tolist(), strict=True)), width)
                out.append([v for run_ in parts for v in run_])
            yield batch.assign(mask=out)

    return masks.mapInPandas(run, masks.schema)


def needs_run(frames: DataFrame) -> DataFrame:
    """Frames with whether the scene model must run: the frame's ``change`` and its distance from the last run decide (see steps.SceneRefresh)."""
    from frameloom.streaming import steps
    from frameloom.streaming.frames import by_frame

    rows = frames.withColumn("det_id", F.lit(0).cast("long"))
    return by_frame(rows, steps.SceneRefresh, "video_id bigint, frame_idx bigint, run boolean, age bigint", ["video_id"])
