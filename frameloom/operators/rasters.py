"""Pixel work behind Arrow batches: depth under masks, histograms, image enhancement, mask cleanup.

Images are arrays of bytes; rows carry them as binary with height and width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators import masks


def _ring(mask: np.ndarray, radius: int = 9) -> np.ndarray:
    return masks.dilated(mask, 2 * radius + 1) - (np.asarray(mask) > 0).astype(np.uint8)


def normalized_depth(depth: np.ndarray) -> np.ndarray:
    """Between the 1st and 99th percentile, inside [0, 1]; zeros for a flat map."""
    finite = depth[np.isfinite(depth)]
    if not finite.size:
        return np.zeros(depth.shape, np.float32)
    low, high = np.percentile(finite, [1, 99])
    if high <= low:
        low, high = finite.min(), finite.max()
    if high <= low:
        return np.zeros(depth.shape, np.float32)
    return np.clip((np.nan_to_num(depth, nan=low) - low) / (high - low), 0, 1).astype(np.float32)


def depth_edges(depth: np.ndarray) -> np.ndarray:
    """Length of the gradient, its 95th percentile as 1."""
    gy, gx = np.gradient(depth.astype(np.float64))
    length = np.hypot(gx, gy)
    top = np.percentile(length, 95)
    return np.clip(length / top, 0, 1) if top > 0 else np.zeros_like(length)


def depth_metrics(mask: np.ndarray, depth: np.ndarray) -> dict[str, float]:
    """Percentiles of the depth under a mask, compactness, separation from its ring, edge alignment, parts."""
    mask = (np.asarray(mask) > 0).astype(np.uint8)
    values, area = depth[mask > 0], int(mask.sum())
    labels, parts = masks.components(mask)
    if not area:
        return {"area": 0, "parts": 0, "largest_ratio": 0.0, "median": float("nan"), "std": float("nan"), "range": float("nan"), "compactness": 0.0, "separation": 0.0, "edge_alignment": 0.0}
    p20, p80 = np.percentile(values, [20, 80])
    around = depth[_ring(mask) > 0]
    gap = abs(float(np.median(values)) - float(np.median(around))) if around.size else 0.0
    boundary = mask - (1 - masks.dilated(1 - mask, 3))
    near = masks.dilated(boundary, 5) > 0
    return {
        "area": area,
        "parts": parts,
        "largest_ratio": float(np.bincount(labels[labels > 0]).max() / area),
        "median": float(np.median(values)),
        "std": float(values.std()),
        "range": float(p80 - p20),
        "compactness": float(np.clip(1.0 - (0.55 * values.std() / 0.18 + 0.45 * (p80 - p20) / 0.35), 0, 1)),
        "separation": float(np.clip(gap / 0.18, 0, 1)),
        "edge_alignment": float(np.clip(depth_edges(depth)[near].mean(), 0, 1)) if near.any() else 0.0,
    }


def two_layers(values: np.ndarray, rounds: int = 20) -> tuple[float, float, float]:
    """Two means of numbers: both centres and the smaller share."""
    low, high = np.percentile(values, [10, 90])
    for _ in range(rounds):
        upper = np.abs(values - high) < np.abs(values - low)
        if upper.all() or not upper.any():
            break
        low, high = values[~upper].mean(), values[upper].mean()
    share = float(min(upper.mean(), 1 - upper.mean()))
    return float(low), float(high), share


def boundary_trim(mask: np.ndarray, depth: np.ndarray, most: float = 0.15) -> tuple[np.ndarray, bool, float]:
    """The mask without boundary pixels whose depth is far from the core's; whether that is safe; the share of such pixels."""
    mask = (np.asarray(mask) > 0).astype(np.uint8)
    core = 1 - masks.dilated(1 - mask, 5)
    edge = (mask == 1) & (core == 0)
    if not core.any() or not edge.any():
        return mask, False, 0.0
    middle, spread = np.median(depth[core > 0]), max(float(depth[core > 0].std()), 0.02)
    far = edge & (np.abs(depth - middle) > 2.5 * spread)
    trimmed = mask.copy()
    trimmed[far] = 0
    share = float(far.sum() / edge.sum())
    return trimmed, bool(far.any()) and trimmed.sum() >= (1 - most) * mask.sum(), share


def histogram_embedding(image: np.ndarray, bins: tuple[int, int, int] = (8, 4, 4)) -> np.ndarray:
    """Unit-length histogram of hue, saturation and value."""
    rgb = image[..., ::-1].astype(np.float64) / 255.0
    top, low = rgb.max(-1), rgb.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    hue = np.where(top > low, hue, 0)
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    counts, _ = np.histogramdd(np.stack([hue.ravel(), saturation.ravel(), top.ravel()], axis=1), bins=bins, range=[(0, 1)] * 3)
    flat = counts.ravel()
    return flat / max(float(np.linalg.norm(flat)), 1e-12)


def gamma(image: np.ndarray, value: float = 1.1) -> np.ndarray:
    table = (np.power(np.arange(256) / 255.0, 1.0 / max(value, 1e-6)) * 255).astype(np.uint8)
    return table[image]


def sharpened(image: np.ndarray, amount: float = 0.35) -> np.ndarray:
    """Unsharp masking with a Gaussian of deviation 1."""
    kernel = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(3, 3) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect")
        out = sum(k * np.take(padded, np.arange(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return np.clip(np.rint(image * (1.0 + amount) - out * amount), 0, 255).astype(np.uint8)


def compressed_highlights(image: np.ndarray, threshold: int = 235, strength: float = 0.25) -> np.ndarray:
    """Pixels brighter than the threshold pulled toward it, hue and saturation kept."""
    top = image.max(-1, keepdims=True).astype(np.float64)
    wanted = np.where(top > threshold, threshold + (top - threshold) * (1.0 - strength), top)
    return np.clip(image * (wanted / np.maximum(top, 1)), 0, 255).astype(np.uint8)


def equalized(image: np.ndarray, clip: float = 1.5, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the brightness, tile by tile, blended between tiles."""
    light = image.mean(-1)
    h, w = light.shape
    ys, xs = (np.linspace(0, n, tiles + 1).astype(int) for n in (h, w))
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = light[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].astype(np.uint8)
            counts = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            limit = max(clip * part.size / 256.0, 1.0)
            spare = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + spare / 256.0
            maps[i, j] = np.cumsum(counts) / counts.sum() * 255
    fy = np.clip((np.arange(h) + 0.5) / h * tiles - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) / w * tiles - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = light.astype(int)
    new = (1 - wy) * ((1 - wx) * maps[y0[:, None], x0[None], at] + wx * maps[y0[:, None], x1[None], at]) + wy * ((1 - wx) * maps[y1[:, None], x0[None], at] + wx * maps[y1[:, None], x1[None], at])
    return np.clip(image * (new / np.maximum(light, 1))[..., None], 0, 255).astype(np.uint8)


#: Named chains of enhancement.
CHAINS: dict[str, list[Callable[[np.ndarray], np.ndarray]]] = {
    "light": [lambda x: gamma(x, 1.1), lambda x: equalized(x, 1.5)],
    "edge": [lambda x: gamma(x, 1.05), lambda x: sharpened(x, 0.35)],
    "glare_light": [compressed_highlights, lambda x: equalized(x, 1.2)],
}


def enhanced(image: np.ndarray, steps: list[str]) -> np.ndarray:
    for step in steps:
        for f in CHAINS.get(step, []):
            image = f(image)
    return image


def cleaned(mask: np.ndarray, label: str) -> np.ndarray:
    """Gaps closed, small parts dropped, holes filled; tools may be in several parts, others keep the largest."""
    out = masks.closed(mask, 5)
    thin = label.strip().lower() in ("knife", "fork", "spoon", "spatula", "tongs", "ladle", "whisk", "utensil")
    out = masks.without_small(out, 20 if thin else 50)
    return masks.filled(out if thin else masks.largest_part(out))


def overlays(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(video_id, frame_idx, image, height, width): RGB frames with the outlines of their boxes.

    ``boxes`` has video_id, frame_idx, det_id, label, x1, y1, x2, y2; a label's
    colour is fixed, later ids are drawn over earlier ones, parts outside the
    frame are left out. Frames without boxes stay as they are.
    """
    from frameloom.sinks.writers import display_color

    drawn = boxes.select("video_id", "frame_idx", F.struct("det_id", *[F.round(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], display_color(F.col("label")).alias("colour")).alias("b"))
    listed = drawn.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list("b")).alias("boxes"))

    @F.pandas_udf("binary")
    def draw(image: pd.Series, height: pd.Series, width: pd.Series, boxes: pd.Series) -> pd.Series:
        out = []
        for raw, h, w, found in zip(image, height, width, boxes, strict=True):
            if found is None:
                out.append(raw)
                continue
            picture = np.frombuffer(raw, np.uint8).reshape(h, w, 3).copy()
            for b in found:
                x1, y1, x2, y2 = (b[k] for k in ("x1", "y1", "x2", "y2"))
                inside = np.zeros((h, w), dtype=bool)
                inside[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = True
                inside[max(0, y1 + 1) : max(0, y2 - 1), max(0, x1 + 1) : max(0, x2 - 1)] = False
                picture[inside] = b["colour"]
            out.append(picture.tobytes())
        return pd.Series(out)

    rows = frames.join(listed, ["video_id", "frame_idx"], "left")
    return rows.select("video_id", "frame_idx", draw("image", "height", "width", "boxes").alias("image"), "height", "width")


def pandas_metrics(mask: str, depth: str, height: str, width: str) -> Column:
    """depth_metrics() of binary columns (bytes, and doubles in native order), one Arrow batch at a time."""
    schema = "area long, parts int, largest_ratio double, median double, std double, range double, compactness double, separation double, edge_alignment double"

    @F.pandas_udf(schema)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        measured = masks.once(depth_metrics)  # equal pictures are measured once
        for m, d, h, w in parts:
            yield pd.DataFrame([measured(np.frombuffer(a, np.uint8).reshape(y, x), np.frombuffer(b, np.float64).reshape(y, x)) for a, b, y, x in zip(m, d, h, w, strict=True)])

    return run(mask, depth, height, width)
