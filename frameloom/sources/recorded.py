"""Recorded frames as a data source: stride and time range are pushed into the reader.

A recording is a folder with one file per video, ``<video_id>.frames``: a
header (height, width, frames a second, number of frames) and grey frames one
after the other, so any frame is read by its place. The source knows the files'
sizes, cuts the frames that are asked for into partitions, and reads nothing
else. ``readStream`` follows the recording: new frames of growing files are
read as they come; its offset is a number of frames per video.

Options: ``path``; ``stride`` (1); ``start`` and ``end`` in seconds (both
included; all without); ``fps`` (where given, the stride is the rounded ratio
of the recording's rate to it); ``per_partition`` (frames of a partition, 64).
Frames have the number that they have in the video. A cut-off last frame is not
read. Files are opened through pyarrow's file systems, so the path must be one
that driver and executors see.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEADER = struct.Struct("<IIdQ")
SCHEMA = "video_id long, frame_idx long, timestamp double, height int, width int, image binary"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def write(path: str, video_id: int, frames: np.ndarray, fps: float) -> None:
    """One video: frames x height x width of bytes (a helper for tests and converters)."""
    where, folder = _at(path)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/{video_id}.frames") as out:
        out.write(HEADER.pack(frames.shape[1], frames.shape[2], fps, len(frames)))
        out.write(np.ascontiguousarray(frames, dtype=np.uint8).tobytes())


class _Part(InputPartition):
    def __init__(self, file: str, video: int, first: int, last: int, stride: int):
        self.file, self.video, self.first, self.last, self.stride = file, video, first, last, stride


class _Frames:
    """What batch and stream readers share."""

    def __init__(self, options):
        self.path = options["path"]
        self.stride, self.per_partition = int(options.get("stride", 1)), int(options.get("per_partition", 64))
        self.fps = float(options["fps"]) if "fps" in options else None
        self.start, self.end = float(options.get("start", 0.0)), float(options.get("end", "inf"))
        if self.stride < 1 or self.per_partition < 1:
            raise ValueError("stride and per_partition must be 1 or more")

    def _videos(self) -> list[tuple[int, str, int, float]]:
        """(video, file, whole frames, frames a second)."""
        where, folder = _at(self.path)
        out = []
        for info in where.get_file_info(fs.FileSelector(folder)):
            if info.is_file and info.path.endswith(".frames"):
                with where.open_input_file(info.path) as f:
                    h, w, rate, _ = HEADER.unpack(f.read(HEADER.size))
                out.append((int(info.base_name.removesuffix(".frames")), info.path, (info.size - HEADER.size) // max(1, h * w), rate))
        return sorted(out)

    def _parts(self, video: int, file: str, first: int, last: int, rate: float) -> list[_Part]:
        """Partitions of the wanted frames of first <= number < last."""
        step = max(1, round(rate / self.fps)) if self.fps else self.stride
        low = max(first, int(np.ceil(self.start * rate - 1e-9)))
        high = min(last, int(np.floor(self.end * rate + 1e-9)) + 1 if np.isfinite(self.end) else last)
        low += -low % step
        span = step * self.per_partition
        return [_Part(file, video, a, min(a + span, high), step) for a in range(low, high, span)]

    def read(self, part: _Part) -> Iterator[tuple]:
        where, _ = _at(self.path)
        with where.open_input_file(part.file) as f:
            h, w, rate, _ = HEADER.unpack(f.read(HEADER.size))
            for n in range(part.first, part.last, part.stride):
                f.seek(HEADER.size + n * h * w)
                yield part.video, n, n / rate if rate else 0.0, h, w, f.read(h * w)


class _Batch(_Frames, DataSourceReader):
    def partitions(self) -> list[_Part]:
        return [p for video, file, n, rate in self._videos() for p in self._parts(video, file, 0, n, rate)] or [_Part("", 0, 0, 0, 1)]

    def read(self, part: _Part) -> Iterator[tuple]:
        return super().read(part) if part.last > part.first else iter(())


class _Stream(_Frames, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps({str(v): n for v, _, n, _ in self._videos()})}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        seen, now = json.loads(start["frames"]), json.loads(end["frames"])
        return [p for v, file, _, rate in self._videos() if str(v) in now for p in self._parts(v, file, seen.get(str(v), 0), now[str(v)], rate)]

    def commit(self, end: dict) -> None:
        pass


class RecordedFrames(DataSource):
    """``spark.read.format("recorded_frames")`` after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFrames)


def changes(frames: DataFrame) -> DataFrame:
    """Frames (without their pictures) with the mean absolute difference from the one before; null for the first one and after a change of size.

    Pictures meet their predecessors by a window over each video, and leave
    again in the next task, which compares them.
    """
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    pairs = frames.withColumns({"_before": F.lag("image").over(order)})

    @F.pandas_udf("double")
    def difference(now: pd.Series, before: pd.Series) -> pd.Series:
        each = lambda a, b: float(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).mean()) if a is not None and b is not None and len(a) == len(b) > 0 else None
        return pd.Series([each(a, b) for a, b in zip(now, before, strict=True)], dtype="float64")

    return pairs.select(*[c for c in frames.columns if c != "image"], difference("image", "_before").alias("change"))


def sampled(frames: DataFrame, stride: int, dense: int, least_change: float = 14.0, most: int | None = None) -> DataFrame:
    """Adaptive sampling: every ``stride``-th frame, and every ``dense``-th one for ``stride`` frames after a change above ``least_change``.

    ``frame_id`` counts the kept frames of a video; ``most`` ends each video
    after so many.
    """
    from frameloom.operators.windows import motion_hold

    out = motion_hold(changes(frames).withColumn("change", F.coalesce("change", F.lit(0.0))), "change", least_change, stride, dense)
    return out.where(F.col("frame_id") < most) if most is not None else out
