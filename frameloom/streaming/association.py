"""Trackers that weigh several cues: place, depth, shape, appearance, label and motion.

Step functions (see frames). Rows have det_id, video_id, frame_idx, raw_label,
coarse, confidence, the box x1, y1, x2, y2, ``depth`` with ``depth_low`` and
``depth_high``, ``fill`` (share of the box that the mask takes), ``quality``
and ``vector`` (an appearance, null without). Scores of a frame are tables of
tracks by rows. Out comes a row for each detection (``assigned`` is its track,
null if it got none) and one for each track that was not seen, with its status.
"""

from __future__ import annotations

import math
from operator import itemgetter
from typing import NamedTuple

import numpy as np

from frameloom.operators.tracks import Gallery
from frameloom.streaming.steps import cheapest, iou

# Weights of the cues, gates and limits of the published trackers.
WEIGHTS = {"iou": 0.20, "centre": 0.10, "depth": 0.15, "mask": 0.10, "shape": 0.10, "appearance": 0.30, "label": 0.03, "motion": 0.02}
WEAK_WEIGHTS = {**WEIGHTS, "depth": 0.15 * 1.2, "appearance": 0.30 * 1.2, "label": 0.03 * 0.5}
GREEDY_WEIGHTS = {"iou": 0.35, "centre": 0.20, "depth": 0.25, "label": 0.10, "appearance": 0.10}
FLAT_WEIGHTS = {"iou": 0.55, "centre": 0.30, "label": 0.15}
#: Coarse labels that stand for nearly the same.
RELATED = (frozenset(("cookware", "lid_or_cookware")), frozenset(("utensil", "cutting_tool")))

OUT = "det_id long, video_id long, frame_idx long, assigned long, score double, status string, in_conflict boolean, depth double, missed int, seen int"


def _middle(b: dict) -> tuple[float, float]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def _apart(a: tuple[float, float], b: tuple[float, float], width: float = 1.0, height: float = 1.0) -> float:
    return math.hypot((a[0] - b[0]) / width, (a[1] - b[1]) / height)


def cosine(a, b, missing: float = 0.5) -> float:
    if a is None or b is None:
        return missing
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / size if size > 0 else missing


#: What scores are made of besides labels, appearances and motion, a row of a table each.
FIELDS = ("x1", "y1", "x2", "y2", "depth", "depth_low", "depth_high", "fill")
_fields = itemgetter(*FIELDS)


def _columns(items: list[dict]) -> np.ndarray:
    """The fields of tracks or rows as a table: field by item."""
    return np.array([_fields(b) for b in items], dtype=np.float64).reshape(-1, len(FIELDS)).T


def _areas(a: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, a[2] - a[0]) * np.maximum(0.0, a[3] - a[1])


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each item of one table with each of another."""
    common = np.maximum(0.0, np.minimum(a[2][:, None], b[2]) - np.maximum(a[0][:, None], b[0])) * np.maximum(0.0, np.minimum(a[3][:, None], b[3]) - np.maximum(a[1][:, None], b[1]))
    return np.divide(common, _areas(a)[:, None] + _areas(b) - common, out=np.zeros_like(common), where=common > 0)


def conflicts(rows: list[dict], width: int, height: int) -> list[bool]:
    """Rows that overlap another by more than .25, or lie within .08 of it at nearly the same depth."""
    a = _columns(rows)
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    away = np.hypot((x[:, None] - x) / width, (y[:, None] - y) / height)
    hit = (_overlaps(a, a) > 0.25) | ((away < 0.08) & (np.abs(a[4][:, None] - a[4]) < 0.10))
    np.fill_diagonal(hit, False)
    return hit.any(axis=1).tolist()


def paired(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> list[tuple[int, int, float]]:
    """As many one-to-one pairs of those listed as there can be, and of all such choices the one of the highest total score.

    If every j has its best i for itself, that is the choice. Else a j need
    only look at its best few, as many as there are j: of these one is always left.
    """
    listed: dict[int, list[tuple[float, int]]] = {}
    for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True):
        listed.setdefault(b, []).append((-s, a))
    best = {b: min(found) for b, found in listed.items()}
    if len({a for _, a in best.values()}) < len(best):
        few = {b: dict((a, s) for s, a in sorted(found)[: len(listed)]) for b, found in listed.items()}
        columns = sorted({a for found in few.values() for a in found})
        spare = range(max(0, len(few) - len(columns)))
        cost = [[1.0 + found[a] if a in found else 1e6 for a in columns] + [1e6 for _ in spare] for found in few.values()]
        names = list(few)
        chosen = [(names[r], columns[c]) for r, c in cheapest(cost) if c < len(columns)]
        best = {b: (few[b][a], a) for b, a in chosen if a in few[b]}
    return sorted((a, b, -s) for b, (s, a) in best.items())


class _Cues:
    """What trackers share: the frame's size, appearances as arrays, rows of tracks that were not seen."""

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height

    def _read(self, row: dict) -> dict:
        vector = row["vector"]
        return {**row, "vector": None if vector is None or not len(vector) else np.asarray(vector, dtype=np.float64)}

    @staticmethod
    def _lost(track: int, t: dict, row: dict) -> dict:
        return {"det_id": None, "video_id": row["video_id"], "frame_idx": row["frame_idx"], "assigned": track, "score": None, "status": t["status"], "in_conflict": False, "depth": t["depth"], "missed": t["missed"], "seen": t["seen"]}

    @staticmethod
    def _given(row: dict, track: int | None, t: dict | None, score: float | None, in_conflict: bool) -> dict:
        ids = {k: row[k] for k in ("det_id", "video_id", "frame_idx")}
        return {**ids, "assigned": track, "score": None if score is None else round(score, 9), "status": t["status"] if t else "dropped", "in_conflict": in_conflict, "depth": t["depth"] if t else row["depth"], "missed": 0, "seen": t["seen"] if t else 0}


class _Pairs(NamedTuple):
    """A frame's tracks (name to place) and rows: tables of overlaps and of rows in front, rows in conflict; and pairs that may match, whether also in conflicts, with their cues."""

    at: dict[int, int]
    overlap: np.ndarray
    behind: np.ndarray
    hit: np.ndarray
    i: np.ndarray
    j: np.ndarray
    strict: np.ndarray
    cues: dict[str, np.ndarray]


class CueTracker(_Cues):
    """Two rounds of optimal matching on eight cues behind gates.

    Confident rows (.45) come first, at a score of .35, then weaker ones (.15)
    to the tracks that are left, at .25 and with depth and appearance weighing
    more. Depth follows by moving average, slower in conflicts; appearances
    enter a gallery outside of conflicts only, and so do labels (as counts),
    confidences and qualities (as sums) their histories. Tracks end after 8 frames unseen, 30 if something hides them.
    """

    def __init__(self, width: int, height: int, keep: float = 0.7, keep_in_conflict: float = 0.9, missing: int = 8, hidden: int = 30):
        super().__init__(width, height)
        self.keep, self.keep_in_conflict, self.missing, self.hidden, self.gallery = keep, keep_in_conflict, missing, hidden, Gallery()

    @staticmethod
    def _known(t: dict) -> np.ndarray | None:
        """The unit vectors that a track is known by: its gallery, without one its first appearance."""
        g = t["gallery"]
        vectors = [v for _, v in g["best"]] + g["recent"] + ([g["mean"]] if g["mean"] is not None else [])
        if not vectors and t["vector"] is not None and (size := math.sqrt(float(t["vector"] @ t["vector"]))) > 0:
            vectors = [t["vector"] / size]
        return np.stack(vectors) if vectors else None

    @staticmethod
    def _looks(tracks: list[dict], rows: list[dict], known: np.ndarray) -> np.ndarray:
        """The best cosine of each row's appearance to those of each track (.5 where one is missing), kept within 0 and 1 for galleries."""
        out = np.full((len(tracks), len(rows)), 0.5)
        have, seen = [i for i, t in enumerate(tracks) if t["known"] is not None], [j for j, r in enumerate(rows) if r["vector"] is not None]
        if have and seen:
            vectors = np.stack([rows[j]["vector"] for j in seen])
            size = np.sqrt((vectors * vectors).sum(axis=1))
            blocks = [tracks[i]["known"] for i in have]
            starts = np.cumsum([0, *map(len, blocks[:-1])])
            best = np.maximum.reduceat(np.concatenate(blocks) @ vectors.T, starts, axis=0) / np.where(size > 0, size, 1.0)
            best = np.where(known[have][:, None], np.clip(best, 0.0, 1.0), best)
            out[np.ix_(have, seen)] = np.where(size > 0, best, 0.5)
        return out

    @staticmethod
    def _gate(known, looks, ratio, overlap, apart, in_conflict):
        """Whether pairs may be matched; of single values or tables."""
        unlike = known & (looks < np.where(in_conflict, 0.50, 0.35))
        return ~(unlike | ((ratio > 2.5) & (looks < 0.75)) | ((overlap < 0.30) & (apart > 0.25)))

    def _cues(self, t: dict, row: dict) -> dict[str, float]:
        known = np.array([bool(t["gallery"]["best"] or t["gallery"]["recent"])])
        a, b, one = _columns([t]), _columns([row]), np.zeros(1, dtype=int)
        found = self._cues_of([t], [row], a, b, _overlaps(a, b), self._looks([t], [row], known), one, one)
        return {name: float(values[0]) for name, values in found.items()}

    def _cues_of(self, tracks: list[dict], rows: list[dict], a: np.ndarray, b: np.ndarray, overlap: np.ndarray, looks: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """The cues of pairs (track i, row j)."""
        kinds: dict = {}
        kind = np.array([kinds.setdefault(x["coarse"], len(kinds)) for x in (*tracks, *rows)], dtype=int)
        alike = np.array([[1.0 if p == q else 0.5 if frozenset((p, q)) in RELATED else 0.2 for q in kinds] for p in kinds])
        before = np.array([t["before"] or (np.nan, np.nan) for t in tracks]).reshape(-1, 2).T[:, i]
        label = alike[kind[i], kind[len(tracks) + j]]
        a, b = a[:, i], b[:, j]
        wide, high = np.stack([a[2] - a[0], b[2] - b[0]]), np.stack([a[3] - a[1], b[3] - b[1]])
        sizes, aspect = np.maximum(0.0, wide) * np.maximum(0.0, high), wide / np.maximum(1.0, high)
        ratio = sizes.max(axis=0) / np.maximum(1e-6, sizes.min(axis=0))
        form = np.exp(-np.abs(np.log(np.maximum(1e-6, aspect[0] / np.maximum(1e-6, aspect[1])))) / 0.8)
        thick = a[6] - a[5] - (b[6] - b[5])
        extent = np.sqrt(((wide[0] - wide[1]) / self.width) ** 2 + ((high[0] - high[1]) / self.height) ** 2 + thick**2)
        now, there = (a[:2] + a[2:4]) / 2, (b[:2] + b[2:4]) / 2
        side = np.maximum(1.0, np.maximum(wide[1], high[1]))
        return {
            "iou": overlap[i, j], "centre": np.exp(-np.hypot(*(now - there)) / side), "depth": np.exp(-np.abs(a[4] - b[4]) / 0.12), "mask": np.exp(-np.abs(a[7] - b[7]) / 0.35),
            "shape": np.clip(0.45 / np.maximum(1.0, ratio) + 0.35 * form + 0.20 * np.exp(-extent / 0.35), 0.0, 1.0), "appearance": looks[i, j], "label": label,
            "motion": np.where(np.isnan(before[0]), 0.7, np.exp(-np.hypot(*(2 * now - before - there)) / side)),
        }

    def _passes(self, t: dict, row: dict, cues: dict, in_conflict: bool) -> bool:
        a, b = _areas(_columns([t]))[0], _areas(_columns([row]))[0]
        known = bool(t["gallery"]["best"] or t["gallery"]["recent"])
        return bool(self._gate(known, cues["appearance"], max(a, b) / max(1e-6, min(a, b)), cues["iou"], abs(t["depth"] - row["depth"]), in_conflict))

    def _table(self, tracks: dict, names: list[int], rows: list[dict]) -> _Pairs:
        some = [tracks[n] for n in names]
        a, b = _columns(some), _columns(rows)
        known = np.array([bool(t["gallery"]["best"] or t["gallery"]["recent"]) for t in some], dtype=bool)
        overlap, looks, sizes, apart = _overlaps(a, b), self._looks(some, rows, known), (_areas(a)[:, None], _areas(b)), np.abs(a[4][:, None] - b[4])
        ratio = np.maximum(*sizes) / np.maximum(1e-6, np.minimum(*sizes))
        i, j = np.nonzero(self._gate(known[:, None], looks, ratio, overlap, apart, False))
        strict = self._gate(known[i], looks[i, j], ratio[i, j], overlap[i, j], apart[i, j], True)
        behind = b[4] < a[4][:, None] - 0.03
        return _Pairs({n: k for k, n in enumerate(names)}, overlap, behind, np.array([r["in_conflict"] for r in rows], dtype=bool), i, j, strict, self._cues_of(some, rows, a, b, overlap, looks, i, j))

    def _matched(self, tracks: dict, names: list[int], rows: list[dict], weights: dict, least: float, table: _Pairs | None = None, first: int = 0) -> list[tuple[int, int, float]]:
        """Pairs of tracks and rows; ``table`` may hold more of both, these rows from its row ``first`` on."""
        if not names or not rows:
            for n in names:
                tracks[n]["in_conflict"] = False
            return []
        table = table or self._table(tracks, names, rows)
        at, end = [table.at[n] for n in names], first + len(rows)
        mixed = np.zeros(len(table.at), dtype=bool)
        mixed[at] = ((table.overlap[at, first:end] > 0.05) & table.hit[first:end]).any(axis=1)
        for n, k in zip(names, at, strict=True):
            tracks[n]["in_conflict"] = bool(mixed[k])
        mine = np.zeros(len(table.at), dtype=bool)
        mine[at] = True
        i, j = table.i, table.j
        kept = mine[i] & (j >= first) & (j < end) & (table.strict | ~(mixed[i] | table.hit[j]))
        score = sum(w * table.cues[c][kept] for c, w in weights.items())
        sure = ~np.isnan(score)  # a missing value matches nothing
        order = list(table.at)
        return [(order[k], row, s) for k, row, s in paired(i[kept][sure], j[kept][sure] - first, score[sure]) if s >= least]

    def _seen(self, t: dict, row: dict, weak: bool) -> None:
        in_conflict = row["in_conflict"] or t["in_conflict"]
        keep = self.keep_in_conflict if in_conflict else self.keep
        t["before"] = _middle(t)
        t["depth"] = keep * t["depth"] + (1 - keep) * row["depth"]
        t.update({k: row[k] for k in ("x1", "y1", "x2", "y2", "depth_low", "depth_high", "fill")}, missed=0, seen=t["seen"] + 1, status="conflict_update" if in_conflict else "visible")
        if not in_conflict:
            t["labels"][row["raw_label"]] = t["labels"].get(row["raw_label"], 0) + 1
            t["confidence"] += row["confidence"]
            t["quality"] += row["quality"] * (0.75 if weak else 1.0)
        self._shown(t, row, in_conflict)

    def _shown(self, t: dict, row: dict, in_conflict: bool) -> None:
        if in_conflict or row["vector"] is None or not row["quality"] >= self.gallery.least_quality:
            return  # nothing that a gallery takes
        (told,) = self.gallery({0: t["gallery"]}, [{"track_id": 0, "vector": row["vector"], "quality": row["quality"], "in_conflict": in_conflict}])
        if told["added"]:
            t["known"] = self._known(t)

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        tracks = state.setdefault("tracks", {})
        rows = [self._read(r) for r in rows]
        for row, hit in zip(rows, conflicts(rows, self.width, self.height), strict=True):
            row["in_conflict"] = hit
        high, low = [r for r in rows if r["confidence"] >= 0.45], [r for r in rows if 0.15 <= r["confidence"] < 0.45]
        table = self._table(tracks, list(tracks), [*high, *low, *(r for r in rows if not r["confidence"] >= 0.15)])
        first = self._matched(tracks, list(tracks), high, WEIGHTS, 0.35, table)
        taken = {n for n, _, _ in first}
        second = self._matched(tracks, [n for n in tracks if n not in taken], low, WEAK_WEIGHTS, 0.25, table, len(high))
        given: dict[int, tuple[int, float]] = {}
        for found, some in ((first, high), (second, low)):
            for n, j, score in found:
                self._seen(tracks[n], some[j], some is low)
                given[id(some[j])] = (n, score)
        lost, seen = [], {n for n, _ in given.values()}
        behind = (((table.overlap > 0.15) & table.behind) | (table.hit & (table.overlap > 0.05))).any(axis=1)
        for n, hidden in zip(list(tracks), behind.tolist(), strict=True):
            if n in seen:
                continue
            t = tracks[n]
            t.update(missed=t["missed"] + 1, status="occluded" if hidden else "missing")
            if t["missed"] > (self.hidden if hidden else self.missing):
                t["status"] = "ended"
                del tracks[n]
            lost.append(self._lost(n, t, rows[0]))
        for row in [*high, *low]:
            if id(row) not in given and row["confidence"] >= 0.35:
                n = state["next"] = state.get("next", 0) + 1
                kept = {k: row[k] for k in ("x1", "y1", "x2", "y2", "coarse", "depth", "depth_low", "depth_high", "fill", "vector")}
                tracks[n] = {**kept, "before": None, "missed": 0, "seen": 1, "status": "visible", "in_conflict": False, "labels": {row["raw_label"]: 1}, "confidence": row["confidence"], "quality": row["quality"], "gallery": {"best": [], "recent": [], "mean": None}}
                tracks[n]["known"] = self._known(tracks[n])
                self._shown(tracks[n], row, row["in_conflict"])
                given[id(row)] = (n, 1.0)
        return [self._given(r, n, tracks[n], score, r["in_conflict"]) if (n := given.get(id(r), (None, None))[0]) is not None and (score := given[id(r)][1]) is not None else self._given(r, None, None, None, r["in_conflict"]) for r in rows] + lost


class GreedyTracker(_Cues):
    """One round of greedy matching, by place and label alone or with depth and appearance.

    Pairs are taken in descending order of score (ties: the later track, then
    the later row), at .35 or more. Depth and appearance follow by moving
    average, the label by majority. Every other row starts a track; tracks end
    after 15 frames unseen, 60 while a matched row in front hides them.
    """

    def __init__(self, width: int, height: int, with_depth: bool = True, keep: float = 0.7, missing: int = 15, hidden: int = 60):
        super().__init__(width, height)
        self.with_depth, self.keep, self.missing, self.hidden = with_depth, keep, missing, hidden

    def _score(self, t: dict, row: dict) -> float:
        away = _apart(_middle(t), _middle(row), max(1, self.width), max(1, self.height))
        cues = {"iou": iou(t, row), "centre": math.exp(-6.0 * away), "label": 1.0 if t["label"].lower() == row["raw_label"].lower() else 0.3}
        if not self.with_depth:
            return sum(w * cues[c] for c, w in FLAT_WEIGHTS.items())
        cues |= {"depth": math.exp(-8.0 * abs(t["depth"] - row["depth"])), "appearance": cosine(t["vector"], row["vector"])}
        return sum(w * cues[c] for c, w in GREEDY_WEIGHTS.items())

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        tracks = state.setdefault("tracks", {})
        rows = [self._read(r) for r in rows]
        names = list(tracks)
        pairs = sorted(((self._score(tracks[n], r), i, j) for i, n in enumerate(names) for j, r in enumerate(rows)), reverse=True)
        given: dict[int, tuple[int, float]] = {}
        taken: set[int] = set()
        for score, i, j in pairs:
            if score < 0.35:
                break
            if i in taken or j in given:
                continue
            taken.add(i)
            given[j] = (names[i], score)
            t, row = tracks[names[i]], rows[j]
            t["depth"] = self.keep * t["depth"] + (1 - self.keep) * row["depth"]
            if row["vector"] is not None:
                t["vector"] = row["vector"] if t["vector"] is None else self.keep * t["vector"] + (1 - self.keep) * row["vector"]
            t["labels"][row["raw_label"]] = t["labels"].get(row["raw_label"], 0) + 1
            t.update({k: row[k] for k in ("x1", "y1", "x2", "y2")}, label=max(t["labels"], key=t["labels"].__getitem__), missed=0, seen=t["seen"] + 1, status="visible")
        front, lost = [rows[j] for j in sorted(given)], []
        for i, n in enumerate(names):
            if i not in taken:
                t = tracks[n]
                hidden = any(iou(t, r) > 0.15 and r["depth"] < t["depth"] - 0.03 for r in front)
                t.update(missed=t["missed"] + 1, status="occluded" if hidden else "missing")
                if t["missed"] > (self.hidden if hidden else self.missing):
                    t["status"] = "ended"
                    del tracks[n]
                lost.append(self._lost(n, t, rows[0]))
        for j, row in enumerate(rows):
            if j not in given:
                n = state["next"] = state.get("next", 0) + 1
                tracks[n] = {**{k: row[k] for k in ("x1", "y1", "x2", "y2", "depth", "vector")}, "label": row["raw_label"], "labels": {row["raw_label"]: 1}, "missed": 0, "seen": 1, "status": "visible"}
                given[j] = (n, 1.0)
        return [self._given(r, given[j][0], tracks[given[j][0]], given[j][1], False) for j, r in enumerate(rows)] + lost
