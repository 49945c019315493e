"""The online pipeline's memory of tracks: what one frame does to it, and the rows it adds.

``OnlineTracks`` is a step function (see frames). A frame's rows come from a
detector and a tracker: det_id, video_id, frame_idx, raw_label, coarse, fine,
confidence, track_id, source, the box x1, y1, x2, y2, and ``mask`` (runs on a
grid of ``grid`` pixels; null without). Hands are the rows of the group hand;
``grabbing`` is a Boolean column, if there is one. Rows of the source memory_sam
are no detections but masks that a segmenter proposes for tracks gone missing.

In order: hands that cover many tracks start or end an occlusion event; tracker
ids are judged; rows near a recent track that nobody has take its id; hands at
the border are judged; tracks that miss one stride persist for a while, a lid
in a hand with that hand; tracks may be recovered by a proposed mask, each mask
taking its pixels from those after it; rows that rest on memory too long lose
their confirmation; memory takes up what is confirmed and has a mask, except
for tracks that an occlusion event holds frozen.

Out come all rows, with what was decided. The state holds ``tracks`` (by id),
``event`` and ``before`` (the confirmed boxes of the frame before).
"""

from __future__ import annotations

import math

from frameloom import taxonomy as T
from frameloom.functions import runlists as R
from frameloom.parameters import DEFAULTS, Parameters
from frameloom.streaming.steps import containment, iou

BOX = ("x1", "y1", "x2", "y2")
HELD = {*T.MOVABLE, *T.COOKWARE_BODIES, *T.COOKWARE_LIDS, *T.MANIPULABLE}
#: Schemas of the state: a track, the occlusion event, and a box of the frame before.
TRACK = (
    "video_id long, raw_label string, coarse string, fine string, x1 double, y1 double, x2 double, y2 double, mask array<long>, mask_fault string, confidence double, source string, stable int, last_seen long, budget int, "
    "recovery_age int, missing int, unconfirmed boolean, attached boolean, handheld boolean, hand_x double, hand_y double, reliability string"
)
EVENT = "active boolean, last long, affected array<long>"
BEFORE = "track_id long, x1 double, y1 double, x2 double, y2 double"
#: Schema of the rows that come out.
OUT = (
    "det_id long, video_id long, frame_idx long, track_id long, coarse string, source string, confidence double, x1 double, y1 double, x2 double, y2 double, confirmed boolean, reason string, visibility string, age int, "
    "recovery_quality double, frozen boolean, occluded boolean, budget int"
)
COOKWARE = {*T.COOKWARE_BODIES, *T.COOKWARE_LIDS}
SCENE = {*T.SCENE_SUPPORTS, *T.SCENE_BACKGROUNDS}

# What persists, and what one sighting is enough for, by the published defaults.
PERSISTENT = ("cookware", "pot", "pan", "saucepan", "lid", "pot lid", "pan lid", "hand", "background_unknown", "dishware", "utensil")
SHORT = ("dishware", "utensil", "plate", "bowl", "spoon", "knife")
SEEDS = ("bottle", "jar", "cup", "bowl", "plate", "box", "carton", "package", "container", "can", "lid", "pot lid", "pan lid")
REASSIGNED = ("hand", "cookware", "dishware", "utensil", "pot", "pan", "saucepan", "plate", "bowl", "spoon", "knife")
PROMOTED = "background_unknown"
#: Recovered frames that a quality is good for.
BUDGETS = ((0.92, 5), (0.85, 4), (0.75, 3), (0.65, 2), (0.55, 1))
#: Detectors whose last sighting supports a weak row from memory.
DETECTORS = T.STRONG_SOURCES


def centre(b: dict) -> tuple[float, float]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def diagonal(b: dict) -> float:
    return max(1.0, math.hypot(b["x2"] - b["x1"], b["y2"] - b["y1"]))


def apart(a: tuple[float, float], b: tuple[float, float]) -> float:
    return math.hypot(a[0] - b[0], a[1] - b[1])


def border(b: dict, width: int, height: int) -> str:
    """The borders of the frame that a box comes near, joined by +; empty for none."""
    mx, my = max(24.0, width * 0.06), max(24.0, height * 0.06)
    near = (("left", b["x1"] <= mx), ("right", b["x2"] >= width - mx), ("top", b["y1"] <= my), ("bottom", b["y2"] >= height - my))
    return "+".join(name for name, yes in near if yes)


def pairs(mask) -> R.Runs | None:
    """Runs from start, length, start, length, … (or pairs already)."""
    if mask is None or len(mask) == 0:
        return None if mask is None else []
    flat = mask.tolist() if hasattr(mask, "tolist") else list(mask)
    return list(zip(flat[::2], flat[1::2], strict=True)) if not isinstance(flat[0], tuple) else flat


def doubted(row: dict, reason: str, **more) -> dict:
    return {**row, "confirmed": False, "unconfirmed": True, "reason": reason, **more}


def mask_fault(mask: R.Runs | None, box: dict, width: int, height: int) -> str:
    """Why a mask can't be trusted (none, empty, tiny, or a box and no shape); empty for a good one."""
    if mask is None:
        return "none"
    if not mask:
        return "empty"
    rect = R.of_box(*(round(box[k]) for k in BOX), width, height)
    if R.area(rect) > 200 and R.area(R.common(mask, rect)) > 0.82 * R.area(R.union(mask, rect)):
        return "like its box"
    x1, y1, x2, y2 = R.extent(mask, width)
    tight = (x2 - x1) * (y2 - y1)
    return "too small" if tight < 50 else "too full" if R.area(mask) > 0.80 * tight else ""


def recovery_quality(mask: R.Runs, track: dict, width: int, height: int) -> float:
    """.35 ratio of areas, .40 mask IoU, .25 shift of the centre; the IoU of the boxes where no mask is known."""
    if not mask:
        return 0.0
    old = track["mask"]
    if old is None:
        x1, y1, x2, y2 = R.extent(mask, width)
        return iou(track, {"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    if not old:
        return 0.0
    a, b = R.area(mask), R.area(old)
    shift = apart(R.centre(mask, width), R.centre(old, width)) / max(1.0, math.hypot(width, height) * 0.2)
    return 0.35 * min(a, b) / max(a, b) + 0.40 * R.area(R.common(mask, old)) / R.area(R.union(mask, old)) + 0.25 * max(0.0, 1.0 - shift)


def plain(rows: list[dict]) -> list[dict]:
    """Rows from memory that a better row of their kind covers go: a later one always, an earlier one if it stays itself."""
    kind = lambda r: "body" if r["coarse"].lower() in (*T.COOKWARE_BODIES,) else "lid" if r["coarse"].lower() in T.COOKWARE_LIDS else r["coarse"].lower()
    rank = lambda r: (T.SOURCE_RANK.get(r["source"], 0), r["confidence"])
    covers = lambda a, b: b["source"] in T.TEMPORAL_SOURCES and kind(a) == kind(b) and rank(a) > rank(b) and iou(a, b) >= DEFAULTS.temporal_iou
    out: list[dict] = []
    for i, row in enumerate(rows):
        if not any(covers(a, row) for a in rows[i + 1 :]) and not any(covers(a, row) for a in out):
            out.append(row)
    return out


class OnlineTracks:
    """One frame of the online pipeline; see the module."""

    def __init__(self, width: int, height: int, grid: int = 1, p: Parameters = DEFAULTS):
        self.p, self.width, self.height, self.grid = p, width, height, grid
        self.wide, self.high = width // grid, height // grid

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        now = rows[0]["frame_idx"]
        tracks = state["tracks"] = dict(sorted(state.get("tracks", {}).items()))
        event = state.setdefault("event", {"active": False, "last": None, "affected": [], "frozen": {}})
        rows = [{**r, "mask": pairs(r["mask"]), "track_id": None if r["track_id"] is None or r["track_id"] != r["track_id"] else int(r["track_id"])} for r in rows]
        proposals = [r for r in rows if r["source"] == "memory_sam"]
        seen = [{**r, "age": 0, "reason": "", "visibility": "", "unconfirmed": False, "recovery_quality": None} for r in rows if r["source"] not in ("memory_sam", "track_persist")]
        hands = [r for r in seen if r["coarse"] == "hand"]
        self._occlusion(event, hands, state.get("before", []), tracks, now)
        found = self._reassigned(self._tracked(seen, tracks), tracks, now)
        found = [self._at_border({**r, "confirmed": not r["unconfirmed"]}) for r in found]
        found = plain(found + self._persisted(tracks, found, hands, now))
        found = plain(found + self._recovered(tracks, found, hands, proposals, now))
        found = [self._stale(r, tracks) for r in found]
        for row in found:
            row["frozen"] = self._remember(tracks, row, hands, event, now)
        state["before"] = [{"track_id": r["track_id"], **{k: r[k] for k in BOX}} for r in found if r["confirmed"] and (r["track_id"] or 0) > 0 and r["raw_label"].strip().lower() not in SCENE]
        budget = lambda r: tracks[r["track_id"]]["budget"] if r["track_id"] in tracks else None
        return [{**r, "occluded": event["active"], "budget": budget(r)} for r in found]

    def _occlusion(self, event: dict, hands: list[dict], before: list[dict], tracks: dict, now: int) -> None:
        affected: set[int] = set()
        if hands:
            around = {k: (min if k in ("x1", "y1") else max)(h[k] for h in hands) for k in BOX}
            affected = {b["track_id"] for b in before if iou(around, b) >= self.p.occlusion_iou or containment(around, b) >= self.p.occlusion_containment}
        if len(affected) >= self.p.occlusion_tracks:
            if not event["active"]:
                event.update(active=True, affected=sorted(affected), frozen={t: dict(tracks[t]) for t in sorted(affected) if t in tracks})
            else:
                event["affected"] = sorted({*event["affected"], *affected})
            event["last"] = now
        elif event["active"] and now - event["last"] >= self.p.occlusion_clear_frames:
            event.update(active=False, affected=[], frozen={})

    def _tracked(self, rows: list[dict], tracks: dict) -> list[dict]:
        """Scene rows pass by the tracker, first; of the others those without an id are dropped, unless all are scene rows."""
        scene = [r for r in rows if r["source"] == "segformer_scene" or r["raw_label"].strip().lower() in SCENE]
        out = [{**r, "track_id": None} for r in scene]
        for r in rows:
            if r["source"] == "segformer_scene" or r["raw_label"].strip().lower() in SCENE or r["track_id"] is None:
                continue
            floor = self.p.new_track_floor.get(r["coarse"].strip().lower(), self.p.new_track_floor_other)
            if r["track_id"] not in tracks and r["confidence"] < floor:
                r = doubted({**r, "track_id": None}, "low_confidence_new_track")
            elif r["track_id"] in tracks and tracks[r["track_id"]]["coarse"].lower() != r["coarse"].strip().lower() and r["source"] != "yolo11_seg":
                r = doubted({**r, "track_id": None}, "coarse_label_mismatch")
            elif r["track_id"] < 0:
                r = doubted(r, "negative_track_id")
            out.append(r)
        return out

    def _reassigned(self, rows: list[dict], tracks: dict, now: int) -> list[dict]:
        present, used, out = {r["track_id"] for r in rows if r["track_id"] is not None}, set(), []
        for row in rows:
            label, own, best, found = row["coarse"].strip().lower(), row["track_id"], 0.0, None
            lost = own is None or row["unconfirmed"]
            for t, s in tracks.items() if label in REASSIGNED and (not lost or label in HELD) else ():
                gap = int((now - s["last_seen"]) / max(1, self.p.frame_stride))
                if t < 0 or t in used or (t in present and t != own) or s["coarse"].lower() != label or not 1 <= gap <= self.p.reassign_gap:
                    continue
                score, size = iou(row, s), diagonal(row)
                if (s["attached"] or s["handheld"]) and label in HELD:
                    at_hand = s["hand_x"] is not None and apart(centre(row), (s["hand_x"], s["hand_y"])) <= size * max(1.0, self.p.hand_distance_scale)
                    if at_hand or apart(centre(row), centre(s)) <= size * self.p.hand_distance_scale:
                        score = max(score, self.p.reassign_iou)
                edge = border(row, self.width, self.height) if label == "hand" else ""
                if edge and edge == border(s, self.width, self.height) and apart(centre(row), centre(s)) <= size * 1.25:
                    score = max(score, self.p.reassign_iou)
                if score >= self.p.reassign_iou and score > best:
                    best, found = score, t
            if found is not None and found != own:
                used.add(found)
                row = {**row, "track_id": found, "unconfirmed": False, "reason": "reassigned", "visibility": row["visibility"] or ("reentered_near_edge" if label == "hand" else "")}
            out.append(row)
        return out

    def _at_border(self, row: dict) -> dict:
        """Hands near a border are partly out of sight; weak ones aren't confirmed."""
        if row["coarse"].strip().lower() != "hand" or not (edge := border(row, self.width, self.height)):
            return row
        if row["unconfirmed"]:
            return {**row, "visibility": row["visibility"] or "partial_offscreen"}
        if row["source"] not in DETECTORS:
            return row
        row = {**row, "visibility": "partial_offscreen", "edge": edge}
        return doubted(row, "partial_offscreen") if row["confidence"] < self.p.hand_border_confidence else row

    def _moved_with_hand(self, s: dict, hands: list[dict]) -> dict:
        """The box of a lid in a hand, moved as the hand nearest to the one it knew has moved."""
        box = {k: s[k] for k in BOX}
        if s["fine"] not in T.COOKWARE_LIDS or not s["attached"] or s["hand_x"] is None or not hands:
            return box
        known = (s["hand_x"], s["hand_y"])
        x, y = min((centre(h) for h in hands), key=lambda c: apart(c, known))
        dx, dy = x - known[0], y - known[1]
        x1, y1 = min(max(0.0, box["x1"] + dx), self.width - 1.0), min(max(0.0, box["y1"] + dy), self.height - 1.0)
        return {"x1": x1, "y1": y1, "x2": min(max(x1 + 1, box["x2"] + dx), float(self.width)), "y2": min(max(y1 + 1, box["y2"] + dy), float(self.height))}

    def _terms(self, s: dict) -> tuple[int, float, int, int]:
        """Sightings, confidence and frames that a track needs to persist, and for how many it stays confirmed."""
        p, label, fine = self.p, s["coarse"].lower(), s["fine"]
        hand, promoted, once = label == "hand", label == PROMOTED, s["stable"] == 1
        cold, seed, short = once and label in COOKWARE, once and s["source"] == "grounding_dino_rescue" and label in SEEDS, once and label in SHORT
        alone = promoted or cold or seed or short or (once and s["source"] == "yolo11_seg")
        sightings = 1 if alone else p.persistence_min_stable
        least, most, sure = p.persistence_min_confidence, p.persistence_frames, p.hand_confirmed_persistence if hand else p.confirmed_persistence
        eased = lambda by: max(0.05, least - by)
        # the first case that holds decides
        cases = [
            (promoted, eased(0.04), most + 2, sure),
            (hand, eased(0.04), max(most, p.hand_persistence_frames), sure),
            (cold, max(0.05, p.cold_start_confidence), max(most, p.cold_start_frames), sure),
            (seed, max(0.05, p.seed_confidence), max(most, p.seed_frames), sure),
            (short, max(0.05, p.short_confidence), max(most, p.short_frames), sure),
            ((s["attached"] or s["handheld"]) and label in HELD, eased(0.06), max(most, p.handheld_frames), max(sure, p.handheld_confirmed)),
            (s["attached"] and fine in T.PLATE_PROXIES, eased(0.05), most + 1, sure),
            (s["attached"] and fine in T.COOKWARE_LIDS, eased(0.05), most + 1, sure),
            (label in T.COOKWARE_BODIES, eased(0.02), most + 1, sure),
        ]
        _, confidence, frames, window = next((c for c in cases if c[0]), (True, least, most, sure))
        return sightings, confidence, frames, window

    def _persisted(self, tracks: dict, rows: list[dict], hands: list[dict], now: int) -> list[dict]:
        present, out = {r["track_id"] for r in rows}, []
        for t, s in tracks.items():
            if t < 0 or t in present or s["unconfirmed"] or s["coarse"].lower() not in PERSISTENT or now - s["last_seen"] != self.p.frame_stride:
                continue
            sightings, least, frames, window = self._terms(s)
            age = s["missing"] + 1
            if s["stable"] < sightings or s["confidence"] < least or age > frames:
                continue
            held = s["attached"] or s["handheld"]
            hand = s["coarse"] == "hand"
            row = {**self._row(s, t, now), **self._moved_with_hand(s, hands), "source": "track_persist", "confidence": max(0.05, s["confidence"] * self.p.persistence_decay**age), "age": age}
            row["visibility"] = "temporarily_occluded_or_handheld" if held and not hand else ""
            if hand and border(s, self.width, self.height):
                why = "partial_offscreen" if hands else "offscreen_exit"
                row = doubted(row, why, visibility=why)
            if age > window or row["confidence"] < self.p.stale_confidence:
                row = doubted(row, "stale_persistence")
            out.append(row)
        return out

    def _row(self, s: dict, track: int, now: int) -> dict:
        """A row made of a track."""
        plain_ = {k: s[k] for k in ("video_id", "raw_label", "coarse", "fine", *BOX)}
        return {**plain_, "det_id": None, "frame_idx": now, "track_id": track, "mask": None, "confirmed": True, "unconfirmed": False, "reason": "", "visibility": "", "recovery_quality": None}

    def candidates(self, tracks: dict, present: set, now: int) -> list[tuple[int, dict, float, float]]:
        """Tracks that may be recovered: id, track, the quality that a mask needs, the row's confidence."""
        out = []
        for t, s in tracks.items():
            seed = s["source"] == "grounding_dino_rescue" and s["coarse"].lower() in SEEDS
            sightings, least = (1, min(self.p.memory_confidence, self.p.seed_confidence)) if seed else (self.p.memory_min_stable, self.p.memory_confidence)
            age = s["recovery_age"] + 1
            if t in present or now - s["last_seen"] != self.p.frame_stride or s["stable"] < sightings or s["confidence"] < least or age > self.p.memory_frames or s["budget"] <= 0:
                continue
            need, lid, plate = {1: 0.55, 2: 0.68}.get(age, 0.80), s["attached"] and s["fine"] in T.COOKWARE_LIDS, s["attached"] and s["fine"] in T.PLATE_PROXIES
            if lid:
                need = max(0.42, need - 0.15)
            elif plate:
                need = max(0.44, need - 0.12)
            elif s["coarse"].lower() in T.COOKWARE_BODIES:
                need = max(0.48, need - 0.08)
            out.append((t, s, need, max(0.22, s["confidence"] * 0.90) if lid or plate else max(0.20, s["confidence"] * 0.85)))
        return out

    def _room(self, s: dict, box: dict) -> R.Runs:
        """Where a lost mask is looked for: around the old mask and the old box."""
        g = self.grid
        room = R.dilated(s["mask"], max(1, round(10 / g)), self.wide, self.high) if s["mask"] else []
        px, py = max(12, int((box["x2"] - box["x1"]) * 0.12)), max(12, int((box["y2"] - box["y1"]) * 0.12))
        return R.union(room, R.of_box((box["x1"] - px) / g, (box["y1"] - py) / g, (box["x2"] + px) / g, (box["y2"] + py) / g, self.wide, self.high))

    def _recovered(self, tracks: dict, rows: list[dict], hands: list[dict], proposals: list[dict], now: int) -> list[dict]:
        """For each missing track the proposed mask of the best quality; what is taken is not free for the next."""
        present, out, occupied = {r["track_id"] for r in rows}, [], []
        for r in rows:
            if r["mask"] and r["raw_label"].strip().lower() not in SCENE:
                occupied = R.union(occupied, r["mask"])
        for t, s, need, confidence in self.candidates(tracks, present, now) if proposals else ():
            box = self._moved_with_hand(s, hands)
            free = R.without(self._room(s, box), occupied)
            small = {**s, **{k: box[k] / self.grid for k in BOX}}
            best, quality, score = None, 0.0, -1.0
            for r in proposals if free else ():
                mask = R.common(r["mask"] or [], free)
                q = recovery_quality(mask, small, self.wide, self.high)
                if best is None or q > quality or (q == quality and r["confidence"] > score):
                    best, quality, score = mask, q, r["confidence"]
            if best is None or quality < need or R.area(best) < self.p.memory_least_area:
                continue
            x1, y1, x2, y2 = (float(v * self.grid) for v in R.extent(best, self.wide))
            row = {**self._row(s, t, now), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "mask": best, "source": "memory_sam", "confidence": min(confidence, 0.45), "age": s["recovery_age"] + 1, "recovery_quality": quality}
            occupied = R.union(occupied, best)
            if row["raw_label"].strip().lower() in SCENE:
                continue
            out.append(row)
        for row in out:
            s = tracks[row["track_id"]]
            s.update({k: row[k] for k in (*BOX, "confidence")}, budget=max(0, s["budget"] - 1), recovery_age=row["age"], last_seen=now)
        return out

    def _stale(self, row: dict, tracks: dict) -> dict:
        if row["unconfirmed"] or row["source"] not in ("track_persist", "memory_sam"):
            return row
        supported = tracks.get(row["track_id"], {}).get("source") in DETECTORS
        window = self.p.memory_confirmed if row["source"] == "memory_sam" else self.p.hand_confirmed_persistence if row["coarse"] == "hand" else self.p.confirmed_persistence
        return doubted(row, "stale_persistence") if row["age"] > window or (row["confidence"] < self.p.stale_confidence and not supported) else row

    def _hand_of(self, row: dict, hands: list[dict]) -> tuple[float, float] | None:
        """The centre of the hand that holds a row's object."""
        fine, label = row["fine"], row["coarse"].strip().lower()
        if not (fine in T.COOKWARE_LIDS or fine in T.PLATE_PROXIES or label in HELD):
            return None
        near = [(iou(row, h), h) for h in hands]
        best, hand = max(near, key=lambda x: x[0], default=(0.0, None))
        if hand is None or best <= 0:
            return None
        far, size, scale = apart(centre(row), centre(hand)), diagonal(row), self.p.hand_distance_scale
        if fine in T.PLATE_PROXIES or label in HELD:
            held = best >= self.p.hand_iou or far <= size * scale or (bool(hand.get("grabbing")) and far <= size * max(1.0, scale))
        else:
            held = best >= 0.03 or (bool(hand.get("grabbing")) and far <= size * 0.9)
        return centre(hand) if held else None

    def _remember(self, tracks: dict, row: dict, hands: list[dict], event: dict, now: int) -> bool:
        """Memory takes a confirmed row up; true where an occlusion event kept the track as it was."""
        t = row["track_id"]
        if t is None or t < 0 or not row["confirmed"]:
            return False
        old, made = tracks.get(t), row["source"] in ("memory_sam", "track_persist")
        mask = row["mask"]
        if mask is None and (row["source"] != "track_persist" or not old or not old["mask"]):
            return False
        mask = list(old["mask"]) if mask is None else mask
        hand = self._hand_of(row, hands)
        if event["active"] and t in event["affected"] and t in event["frozen"]:
            tracks[t] = {**event["frozen"][t], "last_seen": now, "reliability": "occlusion_frozen"}
            return True
        small = {k: row[k] / self.grid for k in BOX}
        fault = mask_fault(mask, small, self.wide, self.high)
        box = {k: row[k] for k in BOX}
        kept = mask if not fault else old["mask"] if old else None
        if row["coarse"].strip().lower() == PROMOTED and old:
            box = {k: (min if k in ("x1", "y1") else max)(old[k], row[k]) for k in BOX}
            kept = R.union(old["mask"], kept) if old["mask"] and kept else kept
        good = next((n for q, n in BUDGETS if (row["recovery_quality"] if row["source"] == "memory_sam" else 1.0) >= q), 0)
        budget = min(self.p.memory_frames, good)
        persisted = row["source"] == "track_persist"
        tracks[t] = {
            **box, "video_id": row["video_id"], "raw_label": row["raw_label"], "coarse": row["coarse"], "fine": row["fine"], "mask": kept, "mask_fault": fault, "confidence": row["confidence"], "source": row["source"],
            "stable": (old["stable"] if old else 0) + (not made), "last_seen": now, "budget": max(old["budget"] if old else 0, budget) if row["source"] == "memory_sam" else budget,
            "recovery_age": row["age"] if row["source"] == "memory_sam" else 0, "missing": row["age"] if persisted else 0, "unconfirmed": False,
            "attached": bool(old and old["attached"]) if persisted else hand is not None, "handheld": bool(old and old["handheld"]) if persisted else hand is not None,
            "hand_x": (old["hand_x"] if old else None) if persisted else hand and hand[0], "hand_y": (old["hand_y"] if old else None) if persisted else hand and hand[1],
            "reliability": {"track_persist": "persisted", "memory_sam": "memory_recovered"}.get(row["source"], "confirmed"),
        }
        return False


def _typed(values: dict, schema: str) -> tuple:
    """A state's fields in the order of its schema; masks as flat numbers."""
    names = [c.split()[0] for c in schema.split(", ")]
    flat = lambda v: None if v is None else [x for run in v for x in run]
    return tuple(flat(values[n]) if n == "mask" else values[n] for n in names)


def _untyped(row, schema: str) -> dict:
    names = [c.split()[0] for c in schema.split(", ")]
    return {n: pairs(v) if n == "mask" else list(v) if isinstance(v, list | tuple) else v for n, v in zip(names, row, strict=True)}


def stream_processor(step, columns: list[str], schema: str, idle_ms: int, forget_ms: int | None = None):
    """``step`` (an OnlineTracks) over a stream in keyed state of several variables.

    Tracks and frozen tracks are maps by id (a track that nothing touches for
    ``forget_ms`` is forgotten, if given), the event is a value, the boxes of
    the frame before and the rows of the newest frame are lists. The newest
    frame is worked on when a newer one comes, or by an event timer once the
    watermark is ``idle_ms`` behind it. Only tracks that changed are written.
    Rows have a column ``at`` (timestamp); ``schema`` is theirs. Rows of frames
    that were emitted are late and dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    out_columns = [c.split()[0] for c in OUT.split(", ")]

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.tracks = handle.getMapState("tracks", "track_id long", TRACK, forget_ms)
            self.frozen = handle.getMapState("frozen", "track_id long", TRACK)
            self.event = handle.getValueState("event", EVENT)
            self.before = handle.getListState("before", BEFORE)
            self.held = handle.getListState("held", schema)
            self.done = handle.getValueState("done", "frame long")

        def _load(self) -> dict:
            tracks = {k[0]: _untyped(v, TRACK) for k, v in self.tracks.iterator()}
            event = _untyped(self.event.get(), EVENT) if self.event.exists() else {"active": False, "last": None, "affected": []}
            event["frozen"] = {k[0]: _untyped(v, TRACK) for k, v in self.frozen.iterator()}
            return {"tracks": tracks, "event": event, "before": [_untyped(r, BEFORE) for r in self.before.get()]}

        def _save(self, state: dict, was: dict) -> None:
            for t, track in state["tracks"].items():
                if was["tracks"].get(t) != (now := _typed(track, TRACK)):
                    self.tracks.updateValue((t,), now)
            for t in was["frozen"] - state["event"]["frozen"].keys():
                self.frozen.removeKey((t,))
            for t in state["event"]["frozen"].keys() - was["frozen"]:
                self.frozen.updateValue((t,), _typed(state["event"]["frozen"][t], TRACK))
            self.event.update(_typed(state["event"], EVENT))
            self.before.clear()
            if state["before"]:
                self.before.put([_typed(b, BEFORE) for b in state["before"]])

        def _work(self, rows: list[dict], everything: bool) -> pd.DataFrame:
            rows = sorted(rows, key=lambda r: (r["frame_idx"], r["det_id"]))
            newest = rows[-1]["frame_idx"] if rows else None
            ready = [r for r in rows if everything or r["frame_idx"] < newest]
            rest, out = rows[len(ready) :], []
            if ready:
                state = self._load()
                was = {"tracks": {t: _typed(s, TRACK) for t, s in state["tracks"].items()}, "frozen": set(state["event"]["frozen"])}
                while ready:
                    now = [r for r in ready if r["frame_idx"] == ready[0]["frame_idx"]]
                    out += step(state, now)
                    ready = ready[len(now) :]
                    self.done.update((now[0]["frame_idx"],))
                self._save(state, was)
            self.held.clear()
            if rest:
                self.held.put([tuple(r[c] for c in columns) for r in rest])
            return pd.DataFrame([[r[c] for c in out_columns] for r in out], columns=out_columns)

        def handleInputRows(self, key, rows, timerValues):
            done = self.done.get()[0] if self.done.exists() else None
            held = [dict(zip(columns, r, strict=True)) for r in self.held.get()]
            fresh = [r for batch in rows for r in batch.astype(object).where(batch.notna(), None).to_dict("records")]
            for r in fresh:
                r["mask"] = None if r["mask"] is None else [int(x) for x in r["mask"]]
                r["at"] = pd.Timestamp(r["at"]).to_pydatetime()
            everyone = held + [{c: r[c] for c in columns} for r in fresh if done is None or r["frame_idx"] > done]
            yield self._work(everyone, False)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if everyone:
                last = max(r["at"] for r in everyone)
                self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield self._work([dict(zip(columns, r, strict=True)) for r in self.held.get()], True)

        def close(self) -> None:
            pass

    return Processor()
