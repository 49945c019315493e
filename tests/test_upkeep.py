"""Changes against a plain loop; pictures of every filter; recorded frames and their edges."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import contours
from frameloom.operators.history import History
from frameloom.sources import pictures, recorded


def test_history_equals_a_plain_loop(spark, tmp_path):
    r = random.Random(4)
    base = spark.createDataFrame([(i, f"l{i % 3}", 0, "x") for i in range(12)], "id int, label string, status int, other string")
    h = History(base, str(tmp_path), "id", ["label", "status"], most_rows=4, most_changes=3)
    state = {i: (f"l{i % 3}", 0) for i in range(12)}
    images, stack = {}, []
    version = 0
    assert h.undo() is None and h.rollback(1) == 0 and h.log().count() == 0
    for step in range(14):
        kind = r.choice(["change", "change", "change", "undo", "rollback"])
        if kind == "change":
            ids = r.sample(range(14), r.choice([1, 3, 4, 6]))  # some are unknown, some changes too large for the stack
            rows = [(i, f"s{step}", step) for i in ids]
            version += 1
            assert h.change(spark.createDataFrame(rows, "id int, label string, status int"), f"n{step}") == version
            images[version] = {i: state[i] for i in ids if i in state}
            state |= {i: (f"s{step}", step) for i in images[version]}
            if 0 < len(images[version]) <= 4:
                stack = [*stack, version][-3:]
        elif kind == "undo":
            got = h.undo()
            if stack:
                assert got == stack[-1]
                version += 1
                state |= images[stack.pop()]
            else:
                assert got is None
        elif images:
            of = r.choice(list(images))
            assert h.rollback(of) == len(images[of])
            if images[of]:
                version += 1
                state |= images[of]
        assert h.stack() == stack[::-1]
    assert {x["id"]: (x["label"], x["status"]) for x in h.current().collect()} == state
    assert h.current().columns == base.columns and h.log().count() == version
    assert {x["id"]: x["label"] for x in h.current(0).collect()} == {i: f"l{i % 3}" for i in range(12)}
    with pytest.raises(ValueError, match="no columns"):
        History(base, str(tmp_path), "id", ["nothing"])


def filtered(values: np.ndarray, kind: int, how: int) -> bytes:
    """A picture whose lines all use one filter; values: height x width x channels."""
    h, w, k = values.shape
    flat, body = values.reshape(h, w * k).astype(int), b""
    for y in range(h):
        line = bytearray([how])
        for x in range(w * k):
            a, b, c = (flat[y, x - k] if x >= k else 0), (flat[y - 1, x] if y else 0), (flat[y - 1, x - k] if y and x >= k else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        body += bytes(line)
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    packed = zlib.compress(body)
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
@pytest.mark.parametrize("kind", [0, 2, 4, 6])
def test_pictures_of_every_filter(kind, how):
    values = np.random.default_rng(how).integers(0, 256, (7, 9, pictures.CHANNELS[kind]))
    got = pictures.decoded(filtered(values, kind, how))
    assert (got == (values[:, :, 0] if kind in (0, 4) else np.rint(values[:, :, :3] @ [0.299, 0.587, 0.114]))).all()


def test_masks_of_files(spark, tmp_path):
    grey = np.zeros((6, 8), dtype=np.uint8)
    grey[2:5, 3:7] = [[1, 200, 0, 9]] * 3
    whole = pictures.encoded(grey)
    for name, content in {"a.png": whole, "b.png": whole[:-30], "c.png": b"text"}.items():
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.substring_index("path", "/", -1).alias("name"), "content")
    got = {r["name"]: r for r in pictures.masks(files).collect()}
    assert [tuple(x) for x in got["a.png"]["runs"]] == [(19, 2), (22, 1), (27, 2), (30, 1), (35, 2), (38, 1)] and (got["a.png"]["height"], got["a.png"]["width"]) == (6, 8)
    assert all(got[n]["runs"] is None for n in ("b.png", "c.png"))
    twice = {r["name"]: r["runs"] for r in pictures.masks(files, 12, 16).collect()}
    assert sum(n for _, n in twice["a.png"]) == 4 * sum(n for _, n in got["a.png"]["runs"])


def slow_edges(grey, low, high):
    """Pixel by pixel."""
    h, w = grey.shape
    g = lambda y, x: int(grey[min(abs(y), 2 * (h - 1) - y) if y >= h else abs(y), min(abs(x), 2 * (w - 1) - x) if x >= w else abs(x)])
    size, dirs = np.zeros((h + 2, w + 2), int), {}
    for y in range(h):
        for x in range(w):
            dx = sum(k * (g(y + j, x + 1) - g(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (g(y + 1, x + j) - g(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            size[y + 1, x + 1], dirs[y, x] = abs(dx) + abs(dy), (dx, dy)
    weak = set()
    for (y, x), (dx, dy) in dirs.items():
        m = size[y + 1, x + 1]
        angle = np.degrees(np.arctan2(abs(dy), abs(dx)))
        if angle < 22.5 or (dx == dy == 0 and False):
            ridge = m > size[y + 1, x] and m >= size[y + 1, x + 2]
        elif angle > 67.5:
            ridge = m > size[y, x + 1] and m >= size[y + 2, x + 1]
        else:
            s = 1 if (dx < 0) == (dy < 0) else -1
            ridge = m > size[y, x + 1 - s] and m > size[y + 2, x + 1 + s]
        if ridge and m > low:
            weak.add((y, x))
    keep, todo = set(), [p for p in weak if size[p[0] + 1, p[1] + 1] > high]
    while todo:
        p = todo.pop()
        if p not in keep:
            keep.add(p)
            todo += [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (p[0] + dy, p[1] + dx)) in weak]
    out = np.zeros((h, w), bool)
    for p in keep:
        out[p] = True
    return out


@pytest.mark.parametrize("seed", range(8))
def test_edges_equal_a_loop_over_pixels(seed):
    r = np.random.default_rng(seed)
    grey = r.integers(0, 256, (9, 13)) if seed % 2 else np.kron(r.integers(0, 200, (3, 4)), np.ones((5, 4), int))
    assert (contours.edges(grey.astype(np.uint8), 80, 160) == slow_edges(grey, 80, 160)).all()


def test_known_shapes_give_their_contours(spark):
    grey = np.full((120, 160), 30, dtype=np.uint8)
    grey[10:60, 10:70] = 200
    yy, xx = np.mgrid[:120, :160]
    grey[(yy - 85) ** 2 + (xx - 110) ** 2 <= 25**2] = 180
    grey[70:74, 20:24] = 250  # too small for a box
    grey[25:40, 25:45] = 90  # inside the first, so no outer contour
    found = contours.contours(grey)
    boxes = [c[1:] for c in found]
    assert len(found) == 3
    assert np.abs(np.array(boxes[0]) - (10, 10, 70, 60)).max() <= 1 and np.abs(np.array(boxes[1]) - (85, 60, 136, 111)).max() <= 1
    assert abs(found[0][0] - 49 * 59) < 120 and abs(found[1][0] - np.pi * 25**2) < 160
    frames = spark.createDataFrame([(1, 7, bytearray(grey.tobytes()), 120, 160), (1, 8, bytearray(bytes(120 * 160)), 120, 160), (2, 1, None, 120, 160)], "video_id long, frame_idx long, image binary, height int, width int")
    got = contours.proposals(frames, ["pot", "", "cup"]).orderBy("rank").collect()
    assert [(r["frame_idx"], r["rank"], r["label"]) for r in got] == [(7, 0, "pot"), (7, 1, "cup")]
    assert got[0]["score"] == pytest.approx(min(0.95, 0.2 + 5 * (got[0]["x2"] - got[0]["x1"]) * (got[0]["y2"] - got[0]["y1"]) / 19200))
    assert {r["label"] for r in contours.proposals(frames, [" "]).collect()} == {"object"}


def recording(tmp_path, n=200, h=4, w=5):
    frames = np.random.default_rng(1).integers(0, 256, (n, h, w)).astype(np.uint8)
    frames[50:120] = frames[50]
    for video in (3, 11):
        recorded.write(str(tmp_path / "rec"), video, np.roll(frames, video, axis=0), 10.0)
    return {v: np.roll(frames, v, axis=0) for v in (3, 11)}


def test_frames_are_read_by_place(spark, tmp_path):
    videos = recording(tmp_path)
    recorded.register(spark)
    read = lambda **o: spark.read.format("recorded_frames").options(path=str(tmp_path / "rec"), **o).load()
    every = read(stride="7").collect()
    assert sorted((r["video_id"], r["frame_idx"]) for r in every) == [(v, n) for v in (3, 11) for n in range(0, 200, 7)]
    assert all(bytes(r["image"]) == videos[r["video_id"]][r["frame_idx"]].tobytes() and r["timestamp"] == r["frame_idx"] / 10 for r in every)
    some = read(fps="2.5", start="3.05", end="6.0", per_partition="4")
    assert sorted((r["video_id"], r["frame_idx"]) for r in some.collect()) == [(v, n) for v in (3, 11) for n in range(32, 61, 4)]
    reader = recorded._Batch({"path": str(tmp_path / "rec"), "fps": "2.5", "start": "3.05", "end": "6.0", "per_partition": "4"})
    parts = reader.partitions()
    assert len(parts) == 4 and all(32 <= p.first < p.last <= 61 for p in parts)  # nothing outside the range is asked for
    assert some.rdd.getNumPartitions() == 4
    with open(tmp_path / "rec" / "3.frames", "r+b") as f:
        f.truncate(recorded.HEADER.size + 10 * 20 + 7)  # cut off within the eleventh frame
    assert read().where("video_id = 3").count() == 10 and read(start="99").count() == 0


def test_frames_of_a_growing_recording(spark, tmp_path):
    videos = recording(tmp_path, 60)
    recorded.register(spark)
    whole = {v: (tmp_path / "rec" / f"{v}.frames").read_bytes() for v in videos}
    cut = lambda v, n: (tmp_path / "rec" / f"{v}.frames").write_bytes(whole[v][: recorded.HEADER.size + n * 20 + 3])
    for n in (20, 35, 60):
        for v in videos:
            cut(v, n)
        stream = spark.readStream.format("recorded_frames").options(path=str(tmp_path / "rec"), stride="3").load()
        query = stream.select("video_id", "frame_idx", "image").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((r["video_id"], r["frame_idx"]) for r in got) == [(v, k) for v in (3, 11) for k in range(0, n, 3)]
    assert all(bytes(r["image"]) == videos[r["video_id"]][r["frame_idx"]].tobytes() for r in got)


def test_sampling_by_change_equals_a_loop(spark, tmp_path):
    videos = recording(tmp_path, 90)
    recorded.register(spark)
    frames = spark.read.format("recorded_frames").options(path=str(tmp_path / "rec")).load()
    got = sorted((r["video_id"], r["frame_idx"], r["frame_id"]) for r in recorded.sampled(frames, 10, 3, least_change=14.0, most=12).collect())
    want = []
    for v, pictures_ in videos.items():
        until, count = -1, 0
        for n in range(len(pictures_)):
            if n and np.abs(pictures_[n].astype(int) - pictures_[n - 1]).mean() > 14:
                until = n + 10
            if count < 12 and (n % 10 == 0 or (n <= until and n % 3 == 0)):
                want.append((v, n, count))
                count += 1
    assert got == sorted(want)
