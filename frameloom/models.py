"""Plug-in points for models: rows in, rows out, one Arrow batch at a time.

A detector takes frames (video_id, frame_idx, image) and a list of prompt
labels, and gives rows of DETECTED; a segmenter adds masks to boxes; an embedder
adds vectors to crops; a reviewer answers with JSON. Backends register under a
name; unknown names give the default, as do missing models the stubs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTED = "video_id bigint, frame_idx bigint, seq int, label string, x1 double, y1 double, x2 double, y2 double, confidence double, source string"
Backend = Callable[[pd.DataFrame, list[str]], pd.DataFrame]

_DETECTORS: dict[str, Backend] = {}
_EMBEDDERS: dict[str, Callable[[pd.DataFrame], np.ndarray]] = {}


def detector(name: str):
    """Register a detector backend."""

    def add(f: Backend) -> Backend:
        _DETECTORS[name] = f
        return f

    return add


def embedder(name: str):
    def add(f):
        _EMBEDDERS[name] = f
        return f

    return add


@detector("none")
def _nothing(frames: pd.DataFrame, labels: list[str]) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in DETECTED.split(", ")])


@detector("blobs")
def _blobs(frames: pd.DataFrame, labels: list[str]) -> pd.DataFrame:
    """Bright parts of grey images (height, width, image), the largest first, labels dealt in turn."""
    from frameloom.operators import masks

    def parts(image: np.ndarray) -> list[tuple]:
        found, n = masks.components(image > 127)
        sizes = np.bincount(found.ravel(), minlength=n + 1)[1:]
        out = []
        for rank, part in enumerate(sorted(range(1, n + 1), key=lambda i: (-sizes[i - 1], i))[:12]):
            y, x = np.nonzero(found == part)
            score = min(0.95, max(0.2, 0.2 + 5.0 * sizes[part - 1] / image.size))
            out.append((rank, labels[rank % len(labels)] if labels else "object", float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1), score, "blobs"))
        return out

    of_image = masks.once(parts)  # equal images of a batch are searched once
    rows = [(f.video_id, f.frame_idx, *part) for f in frames.itertuples() for part in of_image(np.frombuffer(f.image, np.uint8).reshape(f.height, f.width))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTED.split(", ")])


@detector("recorded")
def _recorded(frames: pd.DataFrame, labels: list[str]) -> pd.DataFrame:
    """Detections that the image column holds as JSON: label, and whether it is a scene region."""
    rows = []
    for f in frames.itertuples():
        found = json.loads(f.image)
        rows.append((f.video_id, f.frame_idx, 0, found["raw_label"], 0.0, 0.0, 1.0, 1.0, 1.0, "segformer_scene" if found["scene"] else "yolo_world"))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTED.split(", ")])


@embedder("histogram")
def _histogram(crops: pd.DataFrame) -> np.ndarray:
    from frameloom.operators.rasters import histogram_embedding

    return np.stack([histogram_embedding(np.frombuffer(c.image, np.uint8).reshape(c.height, c.width, 3)) for c in crops.itertuples()])


def detected(frames: DataFrame, backend: str, labels: list[str], default: str = "none", every: int = 1) -> DataFrame:
    """Detections of frames; only every so many-th frame reaches the model."""
    run = _DETECTORS.get(backend, _DETECTORS[default])
    if run is _nothing:  # no frame need be read or drawn
        frames = frames.where(F.lit(False))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield run(part, labels)

    return frames.where(F.col("frame_idx") % every == 0).mapInPandas(batches, DETECTED)


def hybrid(frames: DataFrame, foreground: str, scene: str, labels: list[str], scene_labels: list[str]) -> DataFrame:
    """Union of two detectors."""
    return detected(frames, foreground, labels).unionByName(detected(frames, scene, scene_labels))


def detected_apart(frames: DataFrame, backend: str, labels: list[str], scene_sources: tuple[str, ...] = ("segformer_scene", "secondary_scene_anchor")) -> tuple[DataFrame, DataFrame]:
    """One run of a detector over all frames, its rows told apart by source: objects, and scene regions."""
    rows = detected(frames, backend, labels)
    scene = F.coalesce(F.col("source").isin(*scene_sources), F.lit(False))
    return rows.where(~scene), rows.where(scene)


def embedded(crops: DataFrame, backend: str = "histogram", key: str = "proposal_id") -> DataFrame:
    """(key, embedding) of crops with an image; the others are left out."""
    run = _EMBEDDERS[backend]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({key: part[key], "embedding": list(run(part).astype(np.float32))})

    return crops.where("image is not null").mapInPandas(batches, f"{key} {crops.schema[key].dataType.simpleString()}, embedding array<float>")


def reviewed(packets: DataFrame, review: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Adds ``response``: a reviewing model's JSON; the stub is unsure."""
    if review is None:
        return packets.withColumn("response", F.lit('{"decision": "uncertain", "confidence": 0.0}'))
    return packets.withColumn("response", F.pandas_udf(review, "string")(F.struct(*packets.columns) if len(packets.columns) > 1 else F.col(packets.columns[0])))


def capabilities(names: list[str]) -> list[tuple[str, str]]:
    """Which modules can be imported: (name, OK or missing)."""
    from importlib.util import find_spec

    return [(n, "OK" if find_spec(n) else "missing") for n in names]


_SEGMENTERS: dict[str, Callable[[pd.DataFrame], list]] = {}
SEGMENTED = "det_id bigint, runs array<struct<s: bigint, n: bigint>>"


def segmenter(name: str):
    """Register a segmenter: rows with a box in, runs of pixels out (null without a mask)."""

    def add(f):
        _SEGMENTERS[name] = f
        return f

    return add


@segmenter("none")
def _no_masks(boxes: pd.DataFrame) -> list:
    return [None] * len(boxes)


@segmenter("box")
def _box_masks(boxes: pd.DataFrame) -> list:
    """The box itself, at the frame's width."""
    return [[{"s": int(y) * int(b.width) + int(b.x1), "n": int(b.x2) - int(b.x1)} for y in range(int(b.y1), int(b.y2))] for b in boxes.itertuples()]


def segmented(boxes: DataFrame, backend: str, default: str = "none", floor: float = 0.30) -> DataFrame:
    """(det_id, runs) of boxes (det_id, x1 … y2, width, confidence); those below the floor are not given to the model."""
    run = _SEGMENTERS.get(backend, _SEGMENTERS[default])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({"det_id": part["det_id"], "runs": run(part)})

    return boxes.where(F.col("confidence") >= floor).mapInPandas(batches, SEGMENTED)
