"""Operators inside frames: goldens, brute force on random frames, and equal rows in batch and stream."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from frameloom import taxonomy as T
from frameloom.operators import masks, perframe, review
from frameloom.streaming import steps

SCHEMA = "det_id bigint, video_id bigint, frame_idx bigint, raw_label string, coarse string, fine string, source string, track_id bigint, confidence double, confirmed boolean, x1 double, y1 double, x2 double, y2 double"
NAMES = ["pot", "Pan ", "lid", "pot lid", "plate", "bowl", "knife", "hand", "wall", "kitchen wall", "countertop"]


def row(i, frame=0, box=(0, 0, 10, 10), label="pot", coarse="cookware", confidence=0.9, track=None, source="yolo_world", confirmed=True):
    return (i, 0, frame, label, coarse, label, source, track, confidence, confirmed, *map(float, box))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def crowd(spark):
    """Random frames of up to 14 rows with ties, empty boxes and missing tracks; one frame is large."""
    r, rows, i = random.Random(3), [], 0
    for frame in range(60):
        for _ in range(90 if frame == 7 else r.randint(1, 14)):
            x, y = r.randrange(60), r.randrange(60)
            name = r.choice(NAMES)
            group = T.inverted(T.TRACKING_GROUPS).get(name.strip().lower(), name.strip())
            rows.append((i, frame % 3, frame // 3, name, group, T.FINE_SYNONYMS.get(name.strip().lower(), name.strip()), r.choice([*T.SOURCE_RANK]), r.choice([None, -1, *range(6)]), r.randrange(1, 20) / 20, r.random() < 0.8, float(x), float(y), float(x + r.choice([0, 8, 20, 40])), float(y + r.choice([5, 10, 40]))))
            i += 1
    return table(spark, rows), [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], x, strict=True)) for x in rows]


def by_frame(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["det_id"]):
        out.setdefault((r["video_id"], r["frame_idx"]), []).append(r)
    return out


def common(a, b):
    return max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))


def share(a, b):
    least = min(steps.area(a), steps.area(b))
    return common(a, b) / least if least > 0 else 0.0


def low(r, c="raw_label"):
    return r[c].strip().lower()


def pot_kind(name):
    return 1 if name in T.COOKWARE_BODIES else 2 if name in T.COOKWARE_LIDS else 0


def ids(df):
    return sorted(r["det_id"] for r in df.collect())


def test_suppression(spark, crowd):
    rows = [row(1, confidence=0.9), row(2, box=(1, 0, 10, 10), confidence=0.8), row(3, box=(0, 0, 10, 8), label="lid", confidence=0.7)]
    assert ids(perframe.suppressed(table(spark, rows))) == [1, 3]
    want = []
    for group in by_frame(crowd[1]).values():
        kept = []
        for r in sorted(group, key=lambda r: (-r["confidence"], r["det_id"])):
            limit = [0.82 if pot_kind(low(r)) and pot_kind(low(k)) and low(r) != low(k) else 0.45 for k in kept]
            if all(steps.iou(r, k) < x for k, x in zip(kept, limit, strict=True)):
                kept.append(r)
        want += [k["det_id"] for k in kept]
    assert ids(perframe.suppressed(crowd[0])) == sorted(want)


def test_diverse(crowd):
    want = []
    for group in by_frame(crowd[1]).values():
        kept = []
        for r in sorted(group, key=lambda r: (-steps.area(r), r["det_id"])):
            if len(kept) < 4 and all(steps.iou(r, k) < 0.45 and share(r, k) < 0.8 for k in kept):
                kept.append(r)
        want += [k["det_id"] for k in kept]
    assert ids(perframe.diverse(crowd[0])) == sorted(want)


def test_redundant(crowd):
    want = []
    for group in by_frame(crowd[1]).values():
        stay = {r["det_id"]: r for r in group}
        for r in group:
            rank = lambda x: (T.SOURCE_RANK[x["source"]], x["confidence"])
            alike = lambda x, r=r: low(x, "coarse") == low(r, "coarse") or 0 != pot_kind(low(x, "coarse")) == pot_kind(low(r, "coarse"))
            if r["source"] in T.TEMPORAL_SOURCES and any(x is not r and alike(x) and steps.iou(x, r) >= 0.45 and rank(x) > rank(r) for x in stay.values()):
                del stay[r["det_id"]]
        want += stay
    assert ids(perframe.without_redundant(crowd[0])) == sorted(want)


def judged(group):
    """Pairs of a frame in order, by the rules in words."""
    now = {r["det_id"]: {**r, "lost": []} for r in group}
    gone = set()
    for a_id in [r["det_id"] for r in group]:
        if a_id in gone:
            continue
        a = dict(now[a_id])
        for b_id in [r["det_id"] for r in group if r["det_id"] > a_id]:
            b = now[b_id]
            touching = steps.iou(a, b) >= 0.60 or steps.containment(a, b) >= 0.70
            groups = {low(a, "coarse"), low(b, "coarse")}
            if b_id in gone or not touching or ("hand" in groups and len(groups) == 2):
                continue
            state = lambda r: r["confirmed"] * (2 if (r["track_id"] if r["track_id"] is not None else -1) >= 0 else 1)
            w, h = lambda r: max(1.0, r["x2"] - r["x1"]), lambda r: max(1.0, r["y2"] - r["y1"])
            vague = lambda r: low(r, "coarse") == "utensil" and r["confidence"] < 0.60 and not (max(w(r) / h(r), h(r) / w(r)) >= 2.2 and state(r) > 0)  # noqa: E731, B023
            weak = [x for x in (a, b) if vague(x)] if groups & {"cookware", "dishware", "appliance"} else []
            if weak:
                other = b if weak[0]["det_id"] == a_id else a
                now[other["det_id"]]["lost"].append(weak[0]["raw_label"].strip())
                now[weak[0]["det_id"]]["confirmed"] = False
                continue
            base = lambda r: (state(r), r["source"] in T.STRONG_SOURCES, T.GROUP_RANK.get(low(r, "coarse"), 0), r["confidence"])  # noqa: E731, B023
            full = lambda r: (*base(r)[:2], T.SOURCE_RANK[r["source"]], *base(r)[2:])  # noqa: E731, B023
            first = full(a) >= full(b)
            if groups == {"cookware", "dishware"}:
                pan, dish = (a, b) if low(a, "coarse") == "cookware" else (b, a)
                if (pan["confidence"] >= 0.30 and dish["confidence"] < pan["confidence"] + 0.20) or base(pan) >= base(dish):
                    first = pan is a
            winner, loser = (a_id, b_id) if first else (b_id, a_id)
            if len(groups) == 2 or now[winner]["raw_label"] != now[loser]["raw_label"]:
                now[winner]["lost"].append(now[loser]["raw_label"].strip())
            gone.add(loser)
    return [(r["det_id"], r["confirmed"], ",".join(dict.fromkeys(r["lost"]))) for r in now.values() if r["det_id"] not in gone]


def test_conflicts(spark, crowd):
    resolve = lambda *rows: {r["det_id"]: (r["alternatives"], r["confirmed"]) for r in perframe.resolved(table(spark, list(rows))).collect()}
    assert resolve(row(1, track=1, confidence=0.5), row(2, track=2, label="pan", confidence=0.9)) == {2: ("pot", True)}
    assert resolve(row(1, track=1), row(2, coarse="hand", label="hand", track=2)) == {1: ("", True), 2: ("", True)}
    assert resolve(row(1, coarse="utensil", label="knife", confidence=0.3, track=1), row(2, track=2)) == {1: ("", False), 2: ("knife", True)}
    assert resolve(row(1, coarse="dishware", label="plate", confidence=0.4, track=1), row(2, confidence=0.35, confirmed=False)) == {2: ("plate", False)}
    assert resolve(row(1), row(2, box=(50, 50, 60, 60))) == {1: ("", True), 2: ("", True)}
    want = sorted(x for group in by_frame(crowd[1]).values() for x in judged(group))
    assert sorted((r["det_id"], r["confirmed"], r["alternatives"]) for r in perframe.resolved(crowd[0]).collect()) == want


def test_cookware(spark, crowd):
    lids = [row(1, 0, label="lid", confidence=0.5, track=1), row(2, 2, label="lid", confidence=0.5), row(3, 2, box=(0, 0, 10, 7), label="lid", confidence=0.52), row(4, 5, label="lid", confidence=0.5), row(5, 5, box=(0, 0, 10, 7), label="lid", confidence=0.52)]
    assert ids(perframe.best_cookware(table(spark, lids))) == [1, 2, 5]  # the lid of two steps before speaks for row 2, none for row 4
    seen, want = {}, []  # (video, track) -> last row
    for (video, frame), group in sorted(by_frame(crowd[1]).items(), key=lambda x: x[0]):
        clusters = []
        for r in [x for x in group if pot_kind(low(x))]:
            home = [c for c in clusters if any(steps.iou(r, x) >= 0.35 for x in c)]
            (home[0] if home else clusters.append([]) or clusters[-1]).append(r)
        want += [r["det_id"] for r in group if not pot_kind(low(r))]
        for c in clusters:
            near = len(c) > 1 and any(steps.iou(r, h) >= 0.05 for r in c for h in group if low(h) == "hand")
            for kind in {pot_kind(low(r)) for r in c}:
                score = lambda r, near=near: r["confidence"] + (pot_kind(low(r)) == 2) * (0.08 * near + 0.12 * max([steps.iou(r, x) for (v, _), x in seen.items() if v == video and frame - x["frame_idx"] <= 2 and pot_kind(low(x, "fine")) == 2], default=0.0))  # noqa: E731, B023
                want.append(max((r for r in c if pot_kind(low(r)) == kind), key=lambda r: (score(r), -r["det_id"]))["det_id"])
        seen |= {(video, r["track_id"]): r for r in group if r["track_id"] is not None and r["track_id"] >= 0}
    assert ids(perframe.best_cookware(crowd[0])) == sorted(want)


def test_components(crowd):
    want = {}
    for group in by_frame(crowd[1]).values():
        pots = [r for r in group if pot_kind(low(r))]
        name = {r["det_id"]: r["det_id"] for r in pots}
        for _ in pots:
            for a in pots:
                for b in pots:
                    if share(a, b) >= 0.28:
                        name[a["det_id"]] = min(name[a["det_id"]], name[b["det_id"]])
        want |= name
    assert {r["det_id"]: r["component"] for r in perframe.cookware_components(crowd[0]).collect()} == want


def test_two_detectors(spark, crowd):
    from pyspark.sql import functions as F

    rows = [row(1), row(2, box=(0, 0, 10, 9)), row(3, box=(0, 0, 9, 9)), row(4, box=(50, 50, 60, 60))]
    got = perframe.matched_sides(table(spark, rows), F.col("det_id").isin(1, 4)).collect()
    assert sorted((r["left_id"] or 0, r["right_id"] or 0) for r in got) == [(0, 3), (1, 2), (4, 0)]
    want = []
    for group in by_frame(crowd[1]).values():
        sides = [[r for r in group if r["det_id"] % 2 == k] for k in (0, 1)]
        middle = lambda r: np.array([r["x1"] + r["x2"], r["y1"] + r["y2"]])
        far = lambda a, b: float(np.hypot(*(middle(a) - middle(b))))  # noqa: E731, B023
        pairs = sorted((-steps.iou(a, b), -steps.containment(a, b), far(a, b), a["det_id"], b["det_id"]) for a in sides[0] for b in sides[1] if steps.iou(a, b) >= 0.5 or steps.containment(a, b) >= 0.8)
        used = set()
        for over, _, _, a, b in pairs:
            if not used & {a, b}:
                used |= {a, b}
                want.append((a, b, -over))
        want += [(r["det_id"], None, 0.0) if r["det_id"] % 2 == 0 else (None, r["det_id"], 0.0) for r in group if r["det_id"] not in used]
    got = [(r["left_id"], r["right_id"], r["iou"]) for r in perframe.matched_sides(crowd[0], F.col("det_id") % 2 == 0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scenes(crowd):
    want = []
    for (video, frame), group in by_frame(crowd[1]).items():
        boxes = []
        for r in sorted((r for r in group if low(r) in ("wall", "kitchen wall", "countertop")), key=lambda r: (-r["confidence"], r["det_id"])):
            name = T.SCENE_CANONICAL[low(r)]
            home = next((b for b in boxes if b["name"] == name and (steps.iou(b, r) >= 0.55 or share(b, r) >= 0.82)), None)
            if home is None:
                boxes.append({**r, "name": name, "members": 1})
            else:
                home.update(members=home["members"] + 1, **{k: f(home[k], r[k]) for k, f in (("x1", min), ("y1", min), ("x2", max), ("y2", max))})
        want += [(video, frame, b["name"], b["confidence"], b["members"]) for b in boxes]
    names = ("wall", "kitchen wall", "countertop")
    got = perframe.merged_scenes(crowd[0].where(crowd[0]["raw_label"].isin(*names)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_representatives(crowd):
    want, tracks = [], {}
    for r in crowd[1]:
        if r["track_id"] is not None and r["track_id"] >= 0:
            tracks.setdefault((r["video_id"], r["track_id"]), []).append(r)
    for rows in tracks.values():
        chosen = []
        while len(chosen) < 8:
            away = lambda r: min([abs(r["frame_idx"] - c["frame_idx"]) for c in chosen], default=20)  # noqa: E731, B023
            left = [r for r in rows if not chosen or away(r) >= 3]
            if not left:
                break
            chosen.append(max(left, key=lambda r: (0.7 * r["confidence"] + 0.3 * min(1.0, away(r) / 20.0), -r["det_id"])))
        want += [(r["det_id"], k) for k, r in enumerate(chosen)]
    assert sorted((r["det_id"], r["place"]) for r in perframe.representatives(crowd[0].where("track_id >= 0")).collect()) == sorted(want)


def test_mask_pairs(spark):
    """Masks of any shape, runs around the ends of rows, an empty mask."""
    r = np.random.default_rng(5)
    pictures = {(f, i): (np.kron(r.random((4, 5)) < 0.4, np.ones((3, 4)))).astype(np.uint8) for f in range(6) for i in range(7)}
    pictures[(0, 0)][:] = 0
    pictures[(1, 1)][:] = 1
    rows = [(10 * f + i, 0, f, masks.encode(m)) for (f, i), m in pictures.items()]
    got = {(x["a_id"], x["b_id"]): (x["common"], round(x["iou"], 9)) for x in perframe.mask_pairs(spark.createDataFrame(rows, f"det_id bigint, video_id bigint, frame_idx bigint, runs {masks.RUNS}"), 20).collect()}
    want = {}
    for (f, i), a in pictures.items():
        for (g, j), b in pictures.items():
            both = int((a & b).sum())
            if f == g and i < j and both:
                want[(10 * f + i, 10 * g + j)] = (both, round(both / int((a | b).sum()), 9))
    assert got == want


def test_no_rows(spark):
    from pyspark.sql import functions as F

    none = table(spark, []).where("det_id > 0")
    for run in (perframe.suppressed, perframe.diverse, perframe.without_redundant, perframe.resolved, perframe.best_cookware, perframe.cookware_components, perframe.merged_scenes, perframe.representatives):
        assert run(none).count() == 0
    assert perframe.matched_sides(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("run", [perframe.suppressed, perframe.without_redundant, perframe.resolved, perframe.merged_scenes])
def test_stream_equals_batch(spark, crowd, tmp_path, run):
    d = crowd[0]
    source = tmp_path / "in"
    for part in range(3):
        d.where(f"frame_idx div 7 = {part}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = run(stream).writeStream.format("memory").queryName(f"p_{run.__name__}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    want = sorted(map(tuple, run(d).collect()))
    until = time.time() + 60
    while time.time() < until and query.isActive and spark.table(f"p_{run.__name__}").count() < len(want):
        time.sleep(0.5)
    assert query.exception() is None
    query.stop()
    with pytest.raises(ValueError, match="frame by frame"):
        perframe.representatives(stream)
    assert sorted(map(tuple, spark.table(f"p_{run.__name__}").collect())) == want  # the last frames came by the time limit


def test_replay_of_any_log(spark):
    """Statuses on label events, blank values and instances without events, against a fold in order."""
    r = random.Random(8)
    instances = [(i, i % 3, r.choice(["", "pot"]), r.choice(["unreviewed", "deleted"])) for i in range(12)]
    kinds = [r.choice(["instance", "label", "action"]) for _ in range(150)]
    events = [(n, k, r.randrange(11) if k == "instance" else r.randrange(4), r.choice(["", None, "deleted", "reviewed", "uncertain"]), r.choice(["", None, "a", "b"]), r.choice(["", None, "why"])) for n, k in enumerate(kinds)]
    want = []
    for i, cluster, label, status in instances:
        reason = ""
        for _, kind, target, s, lab, why in events:
            if target != (i if kind == "instance" else cluster):
                continue
            if kind == "label":
                if status != "deleted":
                    status, label = s or "reviewed", lab or ""
            else:
                status, reason = s or status, why or reason
                label = (lab or label) if kind == "instance" else label
        want.append((i, cluster, status, label, reason))
    got = review.replayed(spark.createDataFrame(instances, "proposal_id bigint, cluster_id bigint, human_label string, review_status string"), spark.createDataFrame(events, "seq bigint, kind string, target bigint, status string, label string, reason string"))
    assert sorted(map(tuple, got.collect())) == want


def test_old_tracks_leave_the_state():
    again, cache, state, held = steps.Reassign(), steps.MaskCache(), {}, {}
    box = {"x1": 0.0, "y1": 0.0, "x2": 5.0, "y2": 5.0, "coarse": "cookware", "confirmed": True}
    for f in range(40):
        again(state, [{**box, "det_id": f, "frame_idx": f, "track_id": f}])
        cache(held, [{**box, "det_id": f, "frame_idx": f, "track_id": f}])
    assert len(state["seen"]) <= 6 and len(held) <= 4
