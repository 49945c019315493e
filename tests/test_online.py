"""The online memory of tracks: a golden for each rule, and the same rows in batch and stream."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import runlists as RL
from frameloom.operators import masks, runs
from frameloom.plans import online_queries as Q
from frameloom.streaming import association, frames, growing, online, steps

W, H = 400, 300


def shape(x1, y1, x2, y2):
    """A rhombus in a box, on a grid of 4."""
    out = []
    a, b, c, d = x1 // 4, y1 // 4, x2 // 4, y2 // 4
    for y in range(b, d):
        inset = abs(2 * y - (b + d - 1)) * (c - a) // (3 * (d - b))
        out += [y * (W // 4) + a + inset, c - a - 2 * inset]
    return out


def row(i, f, track=None, box=(100, 100, 180, 180), label="pot", coarse="cookware", confidence=0.9, source="yolo_world", mask=True, fine=None, **more):
    return {"det_id": i, "video_id": 0, "frame_idx": f, "raw_label": label, "coarse": coarse, "fine": fine or label, "confidence": confidence, "track_id": track, "source": source,
            **dict(zip(online.BOX, map(float, box), strict=True)), "mask": shape(*box) if mask is True else mask, **more}


FILL = (10**6, "appliance", (300, 20, 380, 60))


def played(rows, last):
    """Rows by frame; a lone appliance fills the frames without rows."""
    step, state, out = online.OnlineTracks(W, H, 4), {}, {}
    for f in range(last + 1):
        now = [r for r in rows if r["frame_idx"] == f] or [row(10**6 + f, f, None, FILL[2], "oven", "other", source="segformer_scene")]
        out[f] = step(state, now)
    return out, state


def one(rows, track):
    found = [r for r in rows if r["track_id"] == track]
    return found[0] if found else None


def test_tracker_rows_are_judged():
    first = [row(1, 0, 5), row(2, 0, 6, label="knife", coarse="utensil", confidence=0.4, box=(10, 200, 60, 260)), row(3, 0, None, label="spoon"), row(4, 0, None, label="sink", coarse="sink"), row(5, 0, -2, label="cup", coarse="dishware", box=(200, 20, 260, 70))]
    out, state = played([*first, row(6, 1, 5, label="cup", coarse="dishware"), row(7, 1, 5, source="yolo11_seg", label="cup", coarse="dishware", box=(210, 200, 290, 280))], 1)
    assert [(r["det_id"], r["track_id"], r["confirmed"], r["reason"]) for r in out[0]] == [(4, None, True, ""), (1, 5, True, ""), (2, None, False, "low_confidence_new_track"), (5, -2, False, "negative_track_id")]
    assert [(r["det_id"], r["track_id"], r["reason"]) for r in out[1] if r["det_id"]] == [(6, None, "coarse_label_mismatch"), (7, 5, "")]
    assert set(state["tracks"]) == {5}


def test_terms_of_persistence():
    def frames_of(label, coarse, sightings=2, **more):
        out, _ = played([row(f, f, 7, label=label, coarse=coarse, **more) for f in range(sightings)], sightings + 9)
        found = [one(out[f], 7) for f in range(sightings, sightings + 10)]
        return [(r["age"], r["confirmed"]) for r in found if r]

    # a row that loses its confirmation is not remembered, so it is the last
    assert frames_of("pot", "cookware") == [(1, True), (2, True), (3, False)]
    assert frames_of("hand", "hand") == [(1, True), (2, True), (3, True), (4, True), (5, False)]
    assert frames_of("pot", "cookware", 1) == [(1, True), (2, True), (3, False)]
    assert frames_of("plate", "dishware", 1) == [(1, True), (2, True), (3, False)]
    assert frames_of("knife", "utensil", 2, confidence=0.17) == []
    assert frames_of("oven", "appliance") == []
    assert frames_of("jar", "jar", 1, source="grounding_dino_rescue") == []  # not among the labels that persist
    decayed, _ = played([row(f, f, 7) for f in range(2)], 2)
    assert one(decayed[2], 7)["confidence"] == pytest.approx(0.9 * 0.92)


def test_handheld_objects_persist_for_longer_and_lids_follow_the_hand():
    hand = lambda f, x: row(100 + f, f, 50, (x, 100, x + 90, 190), "hand", "hand")
    rows = [row(f, f, 7, label="lid", coarse="cookware", fine="lid") for f in range(2)] + [hand(f, 110 + 10 * max(0, f - 1)) for f in range(9)]
    out, state = played(rows, 8)
    found = [one(out[f], 7) for f in range(2, 9)]
    # memory keeps such a track for six frames, four of them confirmed; the rule on stale rows ends that after two
    assert online.OnlineTracks(W, H, 4)._terms({**state["tracks"][50], "coarse": "cookware", "fine": "lid", "attached": True, "stable": 2}) == (2, pytest.approx(0.12), 6, 4)
    assert [(r["age"], r["confirmed"]) for r in found if r] == [(1, True), (2, True), (3, False)]
    # the hand moved by 10 from the place where memory knew it
    assert [found[0]["x1"], found[0]["x2"], found[0]["y1"]] == [110, 190, 100]
    assert found[0]["visibility"] == "temporarily_occluded_or_handheld" and found[0]["coarse"] == "cookware"
    plain_, _ = played(rows[:2], 8)
    assert one(plain_[4], 7)["age"] == 3 and one(plain_[5], 7) is None


def test_budgets_fall_and_masks_take_their_pixels():
    seen = [row(f, f, 7, label="oven", coarse="appliance") for f in range(2)] + [row(20 + f, f, 8, (104, 100, 184, 180), label="stove", coarse="appliance") for f in range(2)]
    out, state = played([*seen, row(90, 2, None, source="memory_sam", label="?", coarse="?", confidence=0.5), row(91, 2, None, (20, 20, 60, 60), source="memory_sam", confidence=0.9)], 3)
    found = one(out[2], 7)
    assert found["source"] == "memory_sam" and found["recovery_quality"] == pytest.approx(1.0) and found["confidence"] == 0.45 and found["confirmed"]
    assert state["tracks"][7]["recovery_age"] == 1
    # the first mask left next to nothing for the second track
    assert one(out[2], 8) is None
    assert found["budget"] == 5  # spent one of five, then earned five by its quality
    weak = online.OnlineTracks(W, H, 4)
    memory = {"tracks": {}, "event": {"active": False, "last": None, "affected": [], "frozen": {}}}
    for f in range(2):
        weak(memory, [row(f, f, 7, label="oven", coarse="appliance")])
    moved = row(90, 2, None, (112, 112, 180, 180), source="memory_sam")
    got = weak(memory, [moved])
    assert 0.55 <= got[0]["recovery_quality"] < 0.92 and memory["tracks"][7]["budget"] == 4 and memory["tracks"][7]["last_seen"] == 2
    assert weak.candidates({7: {**memory["tracks"][7], "budget": 0}}, set(), 3) == []
    ages = [weak.candidates({7: {**memory["tracks"][7], "recovery_age": k}}, set(), 3) for k in (0, 1, 2, 6, 7)]
    assert [a[0][2] if a else None for a in ages] == [0.55, 0.68, 0.80, 0.80, None]
    second = weak(memory, [{**moved, "frame_idx": 3}])
    assert second[0]["age"] == 2 and not second[0]["confirmed"] and second[0]["reason"] == "stale_persistence"


def test_recovery_quality_equals_pixels():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = (r.random((12, 20)) < 0.4 for _ in range(2))
        ra, rb = masks.encode(a), masks.encode(b)
        shift = np.linalg.norm(np.argwhere(a).mean(axis=0) - np.argwhere(b).mean(axis=0)) / max(1.0, np.hypot(12, 20) * 0.2)
        want = 0.35 * min(a.sum(), b.sum()) / max(a.sum(), b.sum()) + 0.40 * (a & b).sum() / (a | b).sum() + 0.25 * max(0, 1 - shift)
        assert online.recovery_quality(ra, {"mask": rb}, 20, 12) == pytest.approx(want)
    assert online.recovery_quality([(0, 10)], {"mask": None, "x1": 0, "y1": 0, "x2": 20, "y2": 1}, 20, 12) == 0.5


def test_occluded_tracks_stay_frozen():
    boxes = {1: (100, 100, 140, 140), 2: (150, 100, 190, 140), 3: (100, 150, 140, 190)}
    at = lambda f, d=0: [row(10 * f + t, f, t, tuple(v + d for v in b), confidence=0.9 - f / 100) for t, b in boxes.items()]
    hand = lambda f: row(500 + f, f, 9, (90, 90, 200, 200), "hand", "hand")
    rows = [*at(0), *at(1), *at(2, 8), hand(2), *at(3, 8), hand(3)] + [r for f in range(4, 14) for r in at(f, 8)]
    out, state = played(rows, 13)
    assert [out[f][0]["occluded"] for f in range(14)] == [False] * 2 + [True] * 9 + [False] * 3
    assert [one(out[f], 1)["frozen"] for f in (1, 2, 3, 10, 11)] == [False, True, True, True, False]
    held, after = played([r for r in rows if r["frame_idx"] <= 10], 10)[1], state
    assert held["tracks"][1]["x1"] == 100 and held["tracks"][1]["last_seen"] == 10 and held["tracks"][1]["reliability"] == "occlusion_frozen"
    assert after["tracks"][1]["x1"] == 108 and after["tracks"][1]["reliability"] == "confirmed"


def test_bad_masks_leave_the_last_good_one():
    box = [v for y in range(25, 45) for v in (y * 100 + 25, 20)]
    out, state = played([row(0, 0, 7), row(1, 1, 7, mask=box), row(2, 1, 8, (200, 200, 280, 280), mask=None)], 1)
    assert state["tracks"][7]["mask"] == online.pairs(shape(100, 100, 180, 180)) and state["tracks"][7]["mask_fault"] == "like its box"
    assert 8 not in state["tracks"]


def test_hands_at_the_border_and_reentry():
    rows = [row(0, 0, 3, (0, 100, 60, 160), "hand", "hand"), row(1, 1, 3, (0, 100, 60, 160), "hand", "hand", 0.45), row(2, 3, 77, (0, 150, 60, 210), "hand", "hand", 0.7)]
    out, _ = played(rows, 3)
    assert (one(out[0], 3)["confirmed"], one(out[0], 3)["visibility"]) == (True, "partial_offscreen")
    assert (out[1][0]["confirmed"], out[1][0]["reason"]) == (False, "partial_offscreen")
    assert [(r["track_id"], r["reason"]) for r in out[3] if r["det_id"] == 2] == [(3, "reassigned")]


def random_parts(r, n):
    return [(k % 3, "ab"[int(r.integers(2))], masks.encode(r.random((6, 9)) < 0.3)) for k in range(n)]


def cut_rows(found, width):
    return RL.by_row(found, width)


def test_set_algebra_equals_pixels(spark):
    r = np.random.default_rng(2)
    parts = [(k, s, cut_rows(m, 9)) for k, s, m in random_parts(r, 14)] + [(7, "a", []), (8, "b", [(0, 5)])]
    d = spark.createDataFrame(parts, f"key int, side string, runs {masks.RUNS}")
    pixels = {(k, s): np.any([masks.decode(m, 6, 9) for q, t, m in parts if (q, t) == (k, s)] or [np.zeros((6, 9))], axis=0) for k in (0, 1, 2, 7, 8) for s in "ab"}
    for keep, on in ((lambda a, b: a | b, np.logical_or), (lambda a, b: a & b, np.logical_and), (lambda a, b: a & ~b, lambda a, b: a & ~b)):
        got = {x["key"]: masks.decode([tuple(q) for q in x["runs"]], 6, 9) for x in runs.combined(d, ["key"], 9, keep).collect()}
        for k in (0, 1, 2, 7, 8):
            assert (got.get(k, np.zeros((6, 9))) == on(pixels[k, "a"], pixels[k, "b"])).all()
    for a, b in itertools.combinations([m for _, _, m in parts], 2):
        x, y = masks.decode(a, 6, 9) > 0, masks.decode(b, 6, 9) > 0
        assert (masks.decode(RL.union(a, b), 6, 9) == (x | y)).all() and (masks.decode(RL.common(a, b), 6, 9) == (x & y)).all() and (masks.decode(RL.without(a, b), 6, 9) == (x & ~y)).all()


def test_growing_by_a_disc(spark):
    r = np.random.default_rng(3)
    mask = r.random((20, 30)) < 0.05
    want = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        for dy, half in RL.reach(4):
            if 0 <= y + dy < 20:
                want[y + dy, max(0, x - half) : x + half + 1] = True
    cut = cut_rows(masks.encode(mask), 30)
    assert (masks.decode(RL.dilated(cut, 4, 30, 20), 20, 30) == want).all()
    d = spark.createDataFrame([(1, cut, "a")], f"key int, runs {masks.RUNS}, side string").withColumn("runs", runs.dilated(F.col("runs"), 4, 30, 20))
    assert (masks.decode([tuple(q) for q in runs.union(d, ["key"], 30).first()["runs"]], 20, 30) == want).all()
    box = spark.range(1).select(F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(online.BOX, (3, 2, 9, 7), strict=True)]).alias("b")).select(runs.of_box(F.col("b"), 30, 20, 1, 4).alias("runs")).first()
    assert masks.encode(masks.decode([tuple(q) for q in box["runs"]], 20, 30)) == masks.encode(masks.decode(RL.dilated(RL.of_box(3, 2, 9, 7, 30, 20), 4, 30, 20), 20, 30))


def test_stream_gives_the_rows_of_the_batch(spark, small, tmp_path):
    """In keyed state of several variables; the newest frames wait for the event timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = Q.tracked(spark, small).withColumn("at", F.timestamp_seconds(F.col("frame_idx") * 10 + 10**9))
    step = online.OnlineTracks(Q.V.FRAME_W, Q.V.FRAME_H, Q.GRID)
    batch = Counter(map(tuple, frames.by_frame(rows.drop("at"), lambda: step, online.OUT, ["video_id"]).collect()))
    parts = [rows.where(f"frame_idx >= {9 * k} and frame_idx < {9 * k + 9}") for k in range(3)]
    parts.append(rows.limit(1).withColumns({"video_id": F.lit(99).cast("long"), "frame_idx": F.lit(0).cast("long"), "at": F.timestamp_seconds(F.lit(2 * 10**9))}))
    parts.append(parts[-1].withColumn("at", F.timestamp_seconds(F.lit(2 * 10**9 + 1))))
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    folder, got = f"{tmp_path}/flat", []
    import os
    import shutil

    os.makedirs(folder)
    for k in range(len(parts)):
        for name in os.listdir(f"{tmp_path}/in/k={k}"):
            if name.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in/k={k}/{name}", f"{folder}/{k}.parquet")
        stream = spark.readStream.schema(rows.schema).parquet(folder).withWatermark("at", "1 seconds")
        processor = online.stream_processor(step, rows.columns, schema, 1000)
        found = stream.groupBy("video_id").transformWithStateInPandas(processor, online.OUT, "append", "EventTime")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    got = Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("video_id < 99").collect()))
    assert got == batch and sum(batch.values()) > 800


def sighting(i, f, box, depth=0.5, label="pot", coarse="cookware", confidence=0.9, vector=None, quality=0.9, fill=0.6):
    return {"det_id": i, "video_id": 0, "frame_idx": f, "raw_label": label, "coarse": coarse, "confidence": confidence, **dict(zip(online.BOX, map(float, box), strict=True)), "depth": depth, "depth_low": depth - 0.02, "depth_high": depth + 0.03, "fill": fill, "quality": quality, "vector": vector}


def test_cue_matching_is_optimal():
    r = random.Random(8)
    for _ in range(15):
        tracker, state = association.CueTracker(W, H), {}
        boxes = [(x := r.randrange(0, 300), y := r.randrange(0, 200), x + r.randrange(60, 90), y + r.randrange(60, 90)) for _ in range(4)]
        vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in boxes]
        tracker(state, [sighting(i, 0, b, 0.3 + i / 10, vector=v) for i, (b, v) in enumerate(zip(boxes, vectors, strict=True))])
        moved = [tracker._read(sighting(10 + i, 1, tuple(v + r.randrange(-20, 20) for v in b), 0.3 + i / 10, vector=[x + r.gauss(0, 0.5) for x in v])) for i, (b, v) in enumerate(zip(boxes, vectors, strict=True))]
        for row_, hit in zip(moved, association.conflicts(moved, W, H), strict=True):
            row_["in_conflict"] = hit
        tracks, names = state["tracks"], list(state["tracks"])
        got = tracker._matched(tracks, names, moved, association.WEIGHTS, 0.35)
        table = {}
        for i, n in enumerate(names):
            for j, row_ in enumerate(moved):
                cues = tracker._cues(tracks[n], row_)
                if tracker._passes(tracks[n], row_, cues, row_["in_conflict"] or tracks[n]["in_conflict"]):
                    table[i, j] = sum(w * cues[c] for c, w in association.WEIGHTS.items())
        best = min(itertools.permutations(range(4)), key=lambda p: sum(1 - table[i, j] if (i, j) in table else 1e6 for i, j in enumerate(p)))
        assert sorted((n, j) for n, j, _ in got) == sorted((names[i], j) for i, j in enumerate(best) if table.get((i, j), 0) >= 0.35)


def test_cue_tracker_follows_slowly_in_conflict_and_expires():
    tracker, state = association.CueTracker(W, H), {}
    box, other = (50, 50, 110, 110), (55, 50, 115, 110)
    tracker(state, [sighting(1, 0, box, 0.5)])
    tracker(state, [sighting(2, 1, box, 0.6)])
    assert state["tracks"][1]["depth"] == pytest.approx(0.7 * 0.5 + 0.3 * 0.6) and state["tracks"][1]["status"] == "visible"
    out = tracker(state, [sighting(3, 2, box, 0.6), sighting(4, 2, other, 0.6, confidence=0.2)])
    t = state["tracks"][1]
    assert t["depth"] == pytest.approx(0.9 * 0.53 + 0.1 * 0.6) and t["status"] == "conflict_update" and t["labels"] == {"pot": 2} and out[1]["assigned"] is None and out[1]["in_conflict"]
    for hidden, limit in ((False, 8), (True, 30)):
        tracker, state = association.CueTracker(W, H), {}
        tracker(state, [sighting(1, 0, box, 0.9)])
        front = sighting(9, 1, (40, 40, 130, 130), 0.2, confidence=0.1) if hidden else sighting(9, 1, (300, 200, 360, 260), 0.2, confidence=0.1)
        gone = [tracker(state, [{**front, "frame_idx": f}])[-1] for f in range(1, limit + 2)]
        assert [g["status"] for g in gone] == ["occluded" if hidden else "missing"] * limit + ["ended"] and not state["tracks"]


def test_weak_rows_extend_tracks_and_gates_refuse():
    tracker, state = association.CueTracker(W, H), {}
    box = (50, 50, 110, 110)
    tracker(state, [sighting(1, 0, box, vector=[1.0, 0.0])])
    assert [r["assigned"] for r in tracker(state, [sighting(2, 1, box, confidence=0.2, vector=[1.0, 0.1])])] == [1]
    assert [r["assigned"] for r in tracker(state, [sighting(3, 2, box, vector=[-1.0, 0.2])])][0] == 2  # another appearance
    assert tracker(state, [sighting(4, 3, (250, 200, 310, 260), 0.9, confidence=0.3)])[0]["assigned"] is None
    assert tracker(state, [sighting(5, 4, (250, 200, 310, 260), 0.9, confidence=0.35)])[0]["assigned"] == 3


@pytest.mark.parametrize("with_depth", [True, False])
def test_greedy_tracker_equals_a_plain_loop(with_depth):
    r = random.Random(5)
    tracker, state, tracks, count = association.GreedyTracker(W, H, with_depth), {}, [], 0
    for f in range(60):
        rows = [sighting(100 * f + k, f, (x := r.randrange(0, 250), y := r.randrange(0, 150), x + 80, y + 80), r.random(), r.choice(["pot", "cup"]), vector=[r.random(), r.random()] if r.random() < 0.7 else None) for k in range(r.randrange(1, 4))]
        got = tracker(state, rows)
        taken, used = set(), {}
        while True:
            free = [(tracker._score(t, tracker._read(d)), i, j) for i, t in enumerate(tracks) for j, d in enumerate(rows) if i not in taken and j not in used and i < count_at_start(tracks, f)]
            if not free or max(free)[0] < 0.35:
                break
            _, i, j = max(free)
            taken.add(i)
            used[j] = i
        front = [rows[j] for j in used]
        for j, i in used.items():
            t, d = tracks[i], rows[j]
            t["later"] = {"depth": 0.7 * t["depth"] + 0.3 * d["depth"], "vector": t["vector"] if d["vector"] is None else np.array(d["vector"]) if t["vector"] is None else 0.7 * t["vector"] + 0.3 * np.array(d["vector"])}
        for j, i in used.items():
            t, d = tracks[i], rows[j]
            t.update(t.pop("later"), **{k: d[k] for k in online.BOX}, missed=0)
            t["all"].append(d["raw_label"])
            t["label"] = Counter(t["all"]).most_common(1)[0][0]
        for i, t in enumerate(tracks):
            if i not in taken:
                t["missed"] += 1
                t["hidden"] = any(steps.iou(t, d) > 0.15 and d["depth"] < t["depth"] - 0.03 for d in front)
        want = {rows[j]["det_id"]: tracks[i]["id"] for j, i in used.items()}
        for j, d in enumerate(rows):
            if j not in used:
                count += 1
                want[d["det_id"]] = count
                tracks.append({**{k: d[k] for k in (*online.BOX, "depth")}, "vector": None if d["vector"] is None else np.array(d["vector"]), "label": d["raw_label"], "all": [d["raw_label"]], "id": count, "missed": 0, "hidden": False, "born": f})
        assert {g["det_id"]: g["assigned"] for g in got if g["det_id"] is not None} == want
        tracks = [t for t in tracks if t["missed"] <= (60 if t["missed"] and t["hidden"] else 15)]
        assert [t["id"] for t in tracks] == list(state["tracks"])


def count_at_start(tracks, frame):
    return sum(t["born"] < frame for t in tracks)


@pytest.mark.parametrize("within", [False, True])
def test_growing_memory_equals_a_sequential_loop(within):
    r = random.Random(6)
    kinds = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    step, state = growing.GrowingMemory(within_frame=within), {}
    memory = {"accepted": [], "other": []}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)

    seen = Counter()
    for f in range(40):
        rows = [{"det_id": 10 * f + k, "video_id": 1, "frame_idx": f, "label": r.choice(["Pot", "pot", "cup"]), "score": r.random(), "vector": r.choice([None, [], [0.0] * 6, *[[x + r.gauss(0, 0.2) * r.random() for x in v] for v in kinds], kinds[0]])} for k in range(r.randrange(1, 6))]
        got, later = step(state, rows), []
        for row_, g in zip(rows, got, strict=True):
            v = row_["vector"] if row_["vector"] and any(row_["vector"]) else None
            best = {k: max([cosine(v, u) + (0.03 if label == row_["label"].lower() else 0) for label, u in m], default=0.0) if v else 0.0 for k, m in memory.items()}
            hard = best["other"] >= 0.88 and best["other"] >= best["accepted"] - 0.03
            boost = (0.12 if best["accepted"] >= 0.90 else 0.06 if best["accepted"] >= 0.82 else 0) - (0.16 if hard else 0)
            adjusted = min(1, max(0, row_["score"] + boost))
            status = "accepted" if adjusted >= 0.75 and not hard else "needs_vlm" if adjusted >= 0.45 else "rejected"
            assert (g["hard"], g["status"]) == (hard, status) and g["boost"] == pytest.approx(boost) and g["adjusted"] == pytest.approx(adjusted) and g["best"] == pytest.approx(max(best.values()))
            seen[status, hard] += 1
            if v:
                later.append(("accepted" if status == "accepted" else "other", row_["label"].lower(), v))
            for kind, label, u in later if within else ():
                memory[kind].append((label, u))
            later = [] if within else later
        for kind, label, u in later:
            memory[kind].append((label, u))
    assert len(seen) >= 4 and state["good"].n <= len(memory["accepted"])
