"""Greedy operators inside one frame, on whole columns.

Rows are dealt by (video, frame), so that tasks follow the number of frames,
and arrive as Arrow batches cut between frames. Text is turned into numbers by
Column expressions before; a task works on arrays of many frames at once. Greedy
choices are made in rounds: a round settles every row, of all frames, that
waits for no earlier one.

Streams take the same operators (``in_groups``): a frame is worked on when a
newer one of its video has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from frameloom import taxonomy as T
from frameloom.functions import labels as L
from frameloom.parameters import DEFAULTS, Parameters
from frameloom.streaming import frames

FRAME = ("video_id", "frame_idx")
IDS = ("det_id", "video_id", "frame_idx")
PAIRS = 1 << 21  # pairs that are looked at together
IDLE_MS = 10_000  # a video's newest frame in a stream counts as whole after so long without rows


class Frames:
    """Rows of whole groups; rows of a group lie one behind the other."""

    def __init__(self, table: pa.Table, keys=FRAME):
        self.table, self.size = table.combine_chunks(), table.num_rows
        new = np.zeros(self.size, dtype=bool)
        new[:1] = True
        for k in keys:
            column = self[k]
            new[1:] |= column[1:] != column[:-1]
        self.starts = np.flatnonzero(new)
        self.counts = np.diff(np.r_[self.starts, self.size])
        self.group = np.cumsum(new) - 1

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def boxes(self) -> np.ndarray:
        return np.stack([self[c] for c in ("x1", "y1", "x2", "y2")]).astype(np.float64)

    def place(self) -> np.ndarray:
        return np.arange(self.size) - self.starts[self.group]

    def touching(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs i < j of one group whose boxes have common points, ordered by (i, j).

        Rows are swept by their left edges, so that only pairs that meet in x
        are looked at, a bounded number at a time.
        """
        order = np.lexsort((box[0], self.group))
        group, left, right = self.group[order], box[0][order], box[2][order]
        rank = np.unique(np.concatenate([left, right]), return_inverse=True)[1]
        width = int(rank.max(initial=0)) + 2
        end = np.searchsorted(group * width + rank[: self.size], group * width + rank[self.size :], side="right")
        n = np.maximum(end - np.arange(self.size) - 1, 0)
        total, found, first = np.cumsum(n), [], 0
        while first < self.size:
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
            a = np.repeat(np.arange(first, last), n[first:last])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[first:last] - n[first:last] - before, n[first:last])
            a, b = order[a], order[b]
            meet = (box[1][a] <= box[3][b]) & (box[1][b] <= box[3][a])
            found.append(np.stack([np.minimum(a, b)[meet], np.maximum(a, b)[meet]]))
            first = last
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(found, axis=1)
        order = np.lexsort((j, i))
        return i[order], j[order]

    def rows(self, chosen: np.ndarray, names, **more) -> pa.Table:
        """The chosen rows' columns, and more columns (already chosen)."""
        out = self.table.select([n for n in names if n not in more]).take(pa.array(chosen))
        for name, values in more.items():
            out = out.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
        return out


Work = Callable[[Frames], pa.Table]


def _whole(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.Table]:
    """Tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != column[0]
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _fields(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (field.split() for field in schema.split(", "))])


def in_groups(d: DataFrame, work: Work, schema: str, keys=FRAME, order=("det_id",)) -> DataFrame:
    """``work`` on all groups of the keys, dealt by them, rows of a group in order; on a stream, frame by frame of each video."""
    fields = _fields(schema)
    if d.isStreaming:
        if tuple(keys[:2]) != FRAME:
            raise ValueError("a stream is worked on frame by frame; this operator needs more")
        kinds, place = to_arrow_schema(d.schema), [*keys, *order]

        def step():
            def run(state, rows):
                rows = sorted(rows, key=lambda r: [r[c] for c in place])
                return work(Frames(pa.Table.from_pylist(rows, kinds), keys)).select(fields.names).cast(fields).to_pylist()

            return run

        return frames.in_stream(d, step, schema, keys[0], keys[1], order[0], IDLE_MS)

    def run(batches):
        for table in _whole(batches, keys):
            if table.num_rows:
                yield from work(Frames(table, keys)).select(fields.names).cast(fields).combine_chunks().to_batches()

    return d.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def iou(box: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    common = intersection(box, i, j)
    size = areas(box)
    union = size[i] + size[j] - common
    return np.where(common > 0, common / np.where(union > 0, union, 1.0), 0.0)


def areas(box: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, box[2] - box[0]) * np.maximum(0.0, box[3] - box[1])


def intersection(box: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2][i], box[2][j]) - np.maximum(box[0][i], box[0][j])
    h = np.minimum(box[3][i], box[3][j]) - np.maximum(box[1][i], box[1][j])
    return np.maximum(0.0, w) * np.maximum(0.0, h)


def shares(box: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common area by the smaller box's."""
    least = np.minimum(areas(box)[i], areas(box)[j])
    return np.where(least > 0, intersection(box, i, j) / np.where(least > 0, least, 1.0), 0.0)


def containments(box: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    size, common = np.maximum(1.0, areas(box)), intersection(box, i, j)
    return np.maximum(common / size[i], common / size[j])


def survivors(kept: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows left when each edge's first row, if it is left itself, removes the second; edges follow an order of the rows."""
    kept = kept.copy()
    while len(first):
        waits = np.zeros(len(kept), dtype=bool)
        waits[second] = True
        sure = ~waits[first]
        kept[second[sure & kept[first]]] = False
        still = ~sure & kept[first] & kept[second]
        first, second = first[still], second[still]
    return kept


def by_rank(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with the row of lower rank first."""
    swap = rank[i] > rank[j]
    return np.where(swap, j, i), np.where(swap, i, j)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Place of each row in the order of the keys (the last one leads)."""
    out = np.empty(len(keys[0]), dtype=np.int64)
    out[np.lexsort(keys)] = np.arange(len(out))
    return out


def _rank_of(c: Column, ranks: dict[str, int]) -> Column:
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, c), F.lit(0))


def _cookware(label: str) -> Column:
    """1 body, 2 lid, 0 other."""
    kind = L.cookware_kind(F.col(label))
    return F.when(kind == "body", 1).when(kind == "lid", 2).otherwise(0)


_BOX = ("x1", "y1", "x2", "y2")


def suppressed(d: DataFrame, limit: float = DEFAULTS.nms_iou, cookware_limit: float = DEFAULTS.nms_cookware_iou, score: str = "confidence") -> DataFrame:
    """Non-maximum suppression inside frames by descending score, then id: det_id, video_id, frame_idx, confidence.

    Two different kinds of cookware suppress one another only from ``cookware_limit`` on.
    """
    return in_groups(d.select(*IDS, *_BOX, F.col(score).alias("confidence"), *_named()), _suppress(limit, cookware_limit), "det_id bigint, video_id bigint, frame_idx bigint, confidence double")


def _named() -> list[Column]:
    return [_cookware("raw_label").alias("cookware"), F.xxhash64(L.lowered(F.col("raw_label"))).alias("name")]


def _suppress(limit: float, cookware_limit: float) -> Work:
    def work(f: Frames) -> pa.Table:
        box, name, pot = f.boxes(), f["name"], f["cookware"] > 0
        i, j = f.touching(box)
        mixed = pot[i] & pot[j] & (name[i] != name[j])
        hit = iou(box, i, j) >= np.where(mixed, cookware_limit, limit)
        rank = _ranks(f["det_id"], -f["confidence"], f.group)
        kept = survivors(np.ones(f.size, dtype=bool), *by_rank(rank, i[hit], j[hit]))
        return f.rows(np.flatnonzero(kept), (*IDS, "confidence"))

    return work


def diverse(d: DataFrame, k: int = 4, limit: float = 0.45, share: float = 0.8) -> DataFrame:
    """The ``k`` largest boxes of each frame, each apart from those chosen before it."""

    def work(f: Frames) -> pa.Table:
        box = f.boxes()
        i, j = f.touching(box)
        near = (iou(box, i, j) >= limit) | (shares(box, i, j) >= share)
        rank = _ranks(f["det_id"], -areas(box), f.group)
        kept = np.flatnonzero(survivors(np.ones(f.size, dtype=bool), *by_rank(rank, i[near], j[near])))
        kept = kept[np.argsort(rank[kept])]
        group = f.group[kept]
        place = np.arange(len(kept)) - np.searchsorted(group, group)
        return f.rows(kept[place < k], IDS)

    return in_groups(d.select(*IDS, *_BOX), work, "det_id bigint, video_id bigint, frame_idx bigint")


def without_redundant(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Rows that were carried over go where a row of their family and a higher (source rank, confidence) covers them.

    A row that has gone itself covers nothing; rows are judged in order, so one
    that comes later has not gone yet.
    """
    family = F.when(_cookware("coarse") > 0, _cookware("coarse").cast("bigint")).otherwise(F.xxhash64(F.lower("coarse")))
    rows = d.select(*IDS, *_BOX, "source", "confidence", _rank_of(F.col("source"), T.SOURCE_RANK).alias("rank"), F.col("source").isin(*T.TEMPORAL_SOURCES).alias("carried"), family.alias("family"))
    return in_groups(rows, _redundant(p.temporal_iou), "det_id bigint, video_id bigint, frame_idx bigint, source string")


def _redundant(limit: float) -> Work:
    def work(f: Frames) -> pa.Table:
        box, family = f.boxes(), f["family"]
        i, j = f.touching(box)
        hit = (family[i] == family[j]) & (iou(box, i, j) >= limit)
        i, j = i[hit], j[hit]
        key = np.unique(np.stack([f["rank"].astype(np.float64), f["confidence"]]), axis=1, return_inverse=True)[1].ravel()  # places in the order of (rank, confidence)
        carried = f["carried"]
        kept = np.ones(f.size, dtype=bool)
        kept[i[carried[i] & (key[j] > key[i])]] = False  # covered by a later row
        earlier = carried[j] & (key[i] > key[j]) & kept[i] & kept[j]
        return f.rows(np.flatnonzero(survivors(kept, i[earlier], j[earlier])), (*IDS, "source"))

    return work


def resolved(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Overlapping rows of a frame, pair by pair in order: det_id, video_id, frame_idx, coarse, confirmed, alternatives.

    Hands and other things don't compete. An implausible utensil (weak, and not
    long and confirmed) before cookware, dishware or an appliance stays but is
    confirmed no more. Of other pairs one row goes: cookware beats dishware
    unless that is much surer; else the order is (confirmed, seen in this frame,
    source, group, confidence), ties to the first. ``alternatives`` lists the
    labels that lost to a row. A row's own state is taken when its turn as the
    first of pairs begins.
    """
    rows = d.select(
        *IDS, *_BOX, "coarse", "confidence", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("track_id", F.lit(-1)).alias("track"), F.trim("raw_label").alias("name"), F.xxhash64(F.lower("coarse")).alias("kind"), F.xxhash64("raw_label").alias("raw"),
        _rank_of(F.lower("coarse"), T.GROUP_RANK).alias("group_rank"), _rank_of(F.col("source"), T.SOURCE_RANK).alias("source_rank"), F.col("source").isin(*T.STRONG_SOURCES).alias("strong"),
    )
    return in_groups(rows, _resolve(p), "det_id bigint, video_id bigint, frame_idx bigint, coarse string, confirmed boolean, alternatives string")


def _resolve(p: Parameters) -> Work:
    hand, utensil, dishware, cookware = (T.GROUP_RANK[k] for k in ("hand", "utensil", "dishware", "cookware"))

    def work(f: Frames) -> pa.Table:
        box, group, kind, raw, sure = f.boxes(), f["group_rank"], f["kind"], f["raw"], f["confidence"]
        w, h = np.maximum(1.0, box[2] - box[0]), np.maximum(1.0, box[3] - box[1])
        long = np.maximum(w / h, h / w) >= 2.2
        seen, strong = np.where(f["track"] >= 0, 2, 1), f["strong"].astype(np.int64)
        confirmed, gone = f["confirmed"].astype(bool).copy(), np.zeros(f.size, dtype=bool)
        i, j = f.touching(box)
        over = (iou(box, i, j) >= p.conflict_iou) | (containments(box, i, j) >= p.conflict_containment)
        over &= (kind[i] == kind[j]) | ((group[i] != hand) & (group[j] != hand))
        i, j = i[over], j[over]
        # round r settles the r-th pair of every frame
        at = f.group[i]
        turn = np.arange(len(i)) - np.searchsorted(at, at)
        opens = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        gone_then, confirmed_then = gone.copy(), confirmed.copy()
        notes: list[tuple[np.ndarray, np.ndarray]] = []
        by_turn = np.argsort(turn, kind="stable")
        bounds = np.searchsorted(turn[by_turn], np.arange(int(turn.max(initial=-1)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            now = by_turn[lo:hi]
            begin = i[now[opens[now]]]
            gone_then[begin], confirmed_then[begin] = gone[begin], confirmed[begin]
            now = now[~gone_then[i[now]] & ~gone[j[now]]]
            a, b = i[now], j[now]
            state_a, state_b = np.where(confirmed_then[a], seen[a], 0), np.where(confirmed[b], seen[b], 0)
            solid = (cookware, dishware, T.GROUP_RANK["appliance"])
            doubt = lambda x, y, state: (group[x] == utensil) & np.isin(group[y], solid) & (sure[x] < 0.60) & ~(long[x] & (state >= 1))
            weak_a, weak_b = doubt(a, b, state_a), doubt(b, a, state_b)
            short_a, short_b = (state_a * 2 + strong[a]) * 8 + group[a], (state_b * 2 + strong[b]) * 8 + group[b]
            full_a, full_b = (((s * 2 + strong[x]) * 8 + f["source_rank"][x]) * 8 + group[x] for s, x in ((state_a, a), (state_b, b)))
            first = (full_a > full_b) | ((full_a == full_b) & (sure[a] >= sure[b]))
            for mine, theirs, keep in ((a, b, True), (b, a, False)):
                pan = (group[mine] == cookware) & (group[theirs] == dishware)
                s_mine, s_theirs = (short_a, short_b) if keep else (short_b, short_a)
                wins = ((sure[mine] >= 0.30) & (sure[theirs] < sure[mine] + 0.20)) | (s_mine > s_theirs) | ((s_mine == s_theirs) & (sure[mine] >= sure[theirs]))
                first = np.where(pan & wins, keep, first)
            weak = weak_a | weak_b
            winner, loser = np.where(weak, np.where(weak_a, b, a), np.where(first, a, b)), np.where(weak, np.where(weak_a, a, b), np.where(first, b, a))
            told = weak | (kind[a] != kind[b]) | (raw[a] != raw[b])
            notes.append((winner[told], loser[told]))
            confirmed[loser[weak]] = False
            gone[loser[~weak]] = True
        names, listed = f.table["name"], [""] * f.size
        lost: dict[int, dict[str, None]] = {}
        for winners, losers in notes:
            for x, y in zip(winners.tolist(), losers.tolist(), strict=True):
                lost.setdefault(x, {})[names[y].as_py()] = None
        for x, found in lost.items():
            listed[x] = ",".join(found)
        left = np.flatnonzero(~gone)
        return f.rows(left, (*IDS, "coarse"), confirmed=confirmed[left], alternatives=pa.array([listed[x] for x in left], pa.string()))

    return work


def recent_lids(d: DataFrame, gap: int) -> DataFrame:
    """(video_id, frame_idx, x1, y1, x2, y2) of tracks whose last row before a frame is a lid, seen at most ``gap`` frames ago."""
    from pyspark.sql import Window

    after = F.lead("frame_idx").over(Window.partitionBy("video_id", "track_id").orderBy("frame_idx", "det_id"))
    rows = d.where("track_id >= 0").withColumn("_next", after).where(L.is_lid_like(F.col("fine")))
    last = F.least(F.coalesce("_next", F.col("frame_idx") + gap), F.col("frame_idx") + gap)
    return rows.where(last > F.col("frame_idx")).select("video_id", F.explode(F.sequence(F.col("frame_idx") + 1, last)).alias("frame_idx"), *_BOX)


def best_cookware(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Cookware of a frame in clusters; of each cluster the best body and the best lid stay: det_id, video_id, frame_idx, raw_label.

    A row joins the oldest cluster that has a row over it at the limit. A lid
    counts .08 more in a cluster near a hand, and .12 times its best IoU with a
    lid that a track showed in the two steps before. Other rows stay.
    """
    from frameloom.functions import geometry as G

    box = lambda a: F.struct(*[F.col(f"{a}.{c}") for c in _BOX])
    lids = d.where(_cookware("raw_label") == 2).alias("a").join(recent_lids(d, 2 * p.frame_stride).alias("b"), ["video_id", "frame_idx"])
    bonus = lids.groupBy("a.det_id").agg(F.max(G.iou(box("a"), box("b"))).alias("recent"))
    rows = d.select(*IDS, *_BOX, "raw_label", "confidence", _cookware("raw_label").alias("cookware"), (L.lowered(F.col("raw_label")) == "hand").alias("hand"))
    rows = rows.join(bonus, "det_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0.0)))
    return in_groups(rows, _cluster(p.cookware_cluster_iou), "det_id bigint, video_id bigint, frame_idx bigint, raw_label string")


def _cluster(limit: float, hand_limit: float = 0.05) -> Work:
    def work(f: Frames) -> pa.Table:
        box, pot, hand = f.boxes(), f["cookware"], f["hand"].astype(bool)
        i, j = f.touching(box)
        over = iou(box, i, j)
        held = np.zeros(f.size, dtype=bool)
        for x, y in ((i, j), (j, i)):
            held[x[(pot[x] > 0) & hand[y] & (over >= hand_limit)]] = True
        same = (pot[i] > 0) & (pot[j] > 0) & (over >= limit)
        label = oldest(f.size, i[same], j[same])
        near = np.bincount(label, weights=held & (pot > 0), minlength=f.size) > 0
        crowd = np.bincount(label[pot > 0], minlength=f.size) > 1
        lid = pot == 2
        score = f["confidence"] + np.where(lid & near[label] & crowd[label], 0.08, 0.0) + np.where(lid, 0.12 * f["recent"], 0.0)
        order = np.lexsort((np.arange(f.size), -score, pot, label))
        best = np.r_[True, (label[order][1:] != label[order][:-1]) | (pot[order][1:] != pot[order][:-1])] if f.size else np.zeros(0, bool)
        stay = pot == 0
        stay[order[best]] = True
        return f.rows(np.flatnonzero(stay), (*IDS, "raw_label"))

    return work


def oldest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each row's label: the least label of its earlier neighbours, its own number without any."""
    label = np.arange(n)
    while len(first):
        waits = np.zeros(n, dtype=bool)
        waits[second] = True
        sure = ~waits[first]
        ready = np.zeros(n, dtype=bool)  # all neighbours are settled
        ready[second] = True
        ready[second[~sure]] = False
        now = ready[second]
        label[second[now]] = n
        np.minimum.at(label, second[now], label[first[now]])
        first, second = first[~now], second[~now]
    return label


def cookware_components(d: DataFrame, share: float = 0.28) -> DataFrame:
    """Connected components of overlapping cookware: each row with its component's least det_id."""

    def work(f: Frames) -> pa.Table:
        box = f.boxes()
        i, j = f.touching(box)
        hit = shares(box, i, j) >= share
        i, j = i[hit], j[hit]
        label = np.arange(f.size)
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return f.rows(np.arange(f.size), IDS, component=f["det_id"][label])

    return in_groups(d.where(_cookware("raw_label") > 0).select(*IDS, *_BOX), work, "det_id bigint, video_id bigint, frame_idx bigint, component bigint")


def matched_sides(d: DataFrame, left: Column, limit: float = 0.5, inside: float = 0.8) -> DataFrame:
    """One-to-one join of two detectors' rows in frames, the best pair first: video_id, frame_idx, left_id, right_id, iou.

    Pairs go by IoU, containment and nearness, then by the rows' order;
    unmatched rows of both sides stay. ``left`` tells the sides apart.
    """

    def work(f: Frames) -> pa.Table:
        box, mine = f.boxes(), f["left"].astype(bool)
        i, j = f.touching(box)
        i, j = i[mine[i] != mine[j]], j[mine[i] != mine[j]]
        a, b = np.where(mine[i], i, j), np.where(mine[i], j, i)
        over, within = iou(box, a, b), containments(box, a, b)
        hit = (over >= limit) | (within >= inside)
        a, b, over, within = a[hit], b[hit], over[hit], within[hit]
        far = np.hypot(box[0][a] + box[2][a] - box[0][b] - box[2][b], box[1][a] + box[3][a] - box[1][b] - box[3][b])
        rank = _ranks(b, a, far, -within, -over)
        partner, score = np.full(f.size, -1), np.zeros(f.size)
        while len(a):
            best = np.full(f.size, np.iinfo(np.int64).max)
            np.minimum.at(best, a, rank)
            np.minimum.at(best, b, rank)
            now = (best[a] == rank) & (best[b] == rank)
            partner[a[now]], partner[b[now]], score[a[now]] = b[now], a[now], over[now]
            free = (partner[a] < 0) & (partner[b] < 0)
            a, b, over, rank = a[free], b[free], over[free], rank[free]
        rows = np.flatnonzero(mine | (partner < 0))
        ids = f["det_id"]
        met = partner[rows]
        return f.rows(rows, FRAME, left_id=pa.array(ids[rows], mask=~mine[rows]), right_id=pa.array(np.where(mine[rows], ids[met], ids[rows]), mask=mine[rows] & (met < 0)), iou=score[rows])

    return in_groups(d.select(*IDS, *_BOX, left.alias("left")), work, "video_id bigint, frame_idx bigint, left_id bigint, right_id bigint, iou double")


def merged_scenes(d: DataFrame, limit: float = 0.55, share: float = 0.82) -> DataFrame:
    """Scene boxes of one canonical label merged by descending confidence: video_id, frame_idx, label, confidence, members.

    A row joins the first merged box of its frame and label that it overlaps;
    that box grows around it.
    """
    rows = d.select(*IDS, *_BOX, "confidence", L.canonical_scene(F.col("raw_label")).alias("label"))

    def work(f: Frames) -> pa.Table:
        box, sure = f.boxes(), f["confidence"]
        order = np.lexsort((f["det_id"], -sure, f.group))
        turn = np.arange(f.size) - f.starts[f.group[order]]
        home, grown = np.full(f.size, -1), box.copy()  # row -> the row that began its merged box
        for r in range(int(f.counts.max(initial=0))):
            now = order[turn == r]  # the r-th row of every frame of the group
            if r:
                older = order[turn < r]
                older = older[home[older] == older]
                at = np.searchsorted(f.group[older], f.group[now]), np.searchsorted(f.group[older], f.group[now], side="right")
                n = at[1] - at[0]
                mine = np.repeat(now, n)
                theirs = older[np.repeat(at[0], n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)]
                both = np.concatenate([grown, box], axis=1)
                hit = (iou(both, theirs, mine + f.size) >= limit) | (shares(both, theirs, mine + f.size) >= share)
                mine, theirs = mine[hit], theirs[hit]
                first = np.unique(mine, return_index=True)
                home[first[0]] = theirs[first[1]]
            new = now[home[now] < 0]
            home[new] = new
            old = now[home[now] != now]
            h = home[old]
            grown[:2, h] = np.minimum(grown[:2, h], box[:2, old])
            grown[2:, h] = np.maximum(grown[2:, h], box[2:, old])
        members = np.bincount(home, minlength=f.size)
        top = np.flatnonzero(members > 0)
        return f.rows(top, ("video_id", "frame_idx", "label", "confidence"), members=members[top].astype(np.int32))

    return in_groups(rows, work, "video_id bigint, frame_idx bigint, label string, confidence double, members int", keys=("video_id", "frame_idx", "label"))


def representatives(d: DataFrame, k: int = 8, apart: int = 3, reach: float = 20.0) -> DataFrame:
    """Up to ``k`` rows of each track: det_id, video_id, frame_idx, track_id, place.

    Each time the best sum of .7 confidence and .3 distance in time from those
    chosen (``reach`` frames count in full), ``apart`` frames from them or more;
    ties to the smaller id. A task holds a track's ids, times and confidences.
    """

    def work(f: Frames) -> pa.Table:
        frame, sure, chosen, place = f["frame_idx"], f["confidence"], [], []
        spread = np.full(f.size, reach)
        for r in range(k):
            score = np.where(spread >= (apart if r else 0), 0.7 * sure + 0.3 * np.minimum(1.0, spread / reach), -np.inf)
            best = np.maximum.reduceat(score, f.starts)
            hits = np.flatnonzero((score == best[f.group]) & (score > -np.inf))
            hits = hits[np.unique(f.group[hits], return_index=True)[1]]  # rows are in order of id
            chosen.append(hits)
            place.append(np.full(len(hits), r, np.int32))
            mine = np.full(len(f.starts), np.iinfo(np.int64).max // 2)
            mine[f.group[hits]] = frame[hits]
            away = np.abs(frame - mine[f.group])
            spread = away.astype(np.float64) if not r else np.minimum(spread, away)
        return f.rows(np.concatenate(chosen), (*IDS, "track_id"), place=np.concatenate(place))

    return in_groups(d.select(*IDS, "track_id", "confidence"), work, "det_id bigint, video_id bigint, frame_idx bigint, track_id bigint, place int", keys=("video_id", "track_id"))


def mask_pairs(d: DataFrame, width: int) -> DataFrame:
    """Pairs of a frame's masks (det_id, runs) with common pixels: a_id, b_id, common, iou.

    Masks whose boxes meet are paired; a pair's runs are looked up in running
    totals of set pixels, so that a pair costs its shorter list of runs.
    """

    def work(f: Frames) -> pa.Table:
        lists = f.table["runs"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        s, n = (flat.field(c).to_numpy() for c in ("s", "n"))
        at = at - at[0]
        runs = np.diff(at)
        owner = np.repeat(np.arange(f.size), runs)
        full, e = runs > 0, s + n
        whole = s // width != (e - 1) // width  # a run around a row's end
        box = np.zeros((4, f.size))
        box[:, ~full] = np.array([[1.0], [1.0], [0.0], [0.0]])
        for k, values, least in ((0, np.where(whole, 0, s % width), True), (1, s // width, True), (2, np.where(whole, width, s % width + n), False), (3, (e - 1) // width + 1, False)):
            if len(s):
                box[k, full] = (np.minimum if least else np.maximum).reduceat(values, at[:-1][full])
        i, j = f.touching(box)
        keep = full[i] & full[j]
        i, j = i[keep], j[keep]
        swap = runs[i] > runs[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        span = int(e.max(initial=0)) + 2
        key, before = owner * span + s, np.cumsum(n) - n
        size = np.bincount(owner, weights=n, minlength=f.size).astype(np.int64)

        def covered(mask: np.ndarray, x: np.ndarray) -> np.ndarray:
            """Set pixels of a mask before x."""
            run = np.searchsorted(key, mask * span + x, side="right") - 1
            first = at[mask]
            inside = run >= first
            run = np.maximum(run, 0)
            return np.where(inside, before[run] - before[first] + np.minimum(x - s[run], n[run]), 0)

        common, total, done = np.zeros(len(a), np.int64), np.cumsum(runs[a]), 0
        while done < len(a):
            so_far = total[done - 1] if done else 0
            last = max(done + 1, int(np.searchsorted(total, so_far + PAIRS, side="right")))
            x, many = a[done:last], runs[a[done:last]]
            starts = np.cumsum(many) - many
            rows = np.arange(int(many.sum())) - np.repeat(starts, many) + np.repeat(at[x], many)
            there = np.repeat(b[done:last], many)
            common[done:last] = np.add.reduceat(covered(there, e[rows]) - covered(there, s[rows]), starts)
            done = last
        hit = common > 0
        i, j, common = i[hit], j[hit], common[hit]
        ids = f["det_id"]
        return pa.table({"a_id": np.minimum(ids[i], ids[j]), "b_id": np.maximum(ids[i], ids[j]), "common": common, "iou": common / np.maximum(size[i] + size[j] - common, 1)})

    return in_groups(d.select(*FRAME, "det_id", F.filter("runs", lambda r: r["n"] > 0).alias("runs")), work, "a_id bigint, b_id bigint, common bigint, iou double")


def free_proposals(d: DataFrame, occupied: Column, least: int = 1) -> DataFrame:
    """Masks of a frame without the pixels that its occupied masks cover: det_id, video_id, frame_idx, free, rank.

    Rows that are not ``occupied`` and keep ``least`` pixels or more are ranked
    by (confidence, free pixels), the largest first, then by id.
    """

    def work(f: Frames) -> pa.Table:
        lists = f.table["runs"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        s, n = (flat.field(c).to_numpy() for c in ("s", "n"))
        owner = np.repeat(np.arange(f.size), np.diff(at))
        taken = f["occupied"].astype(bool)
        span = int((s + n).max(initial=0)) + 2
        # the union of a frame's occupied runs: parts of them that lie beyond all runs before
        mine = taken[owner]
        start, end = f.group[owner[mine]] * span + s[mine], f.group[owner[mine]] * span + (s + n)[mine]
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        reach = np.r_[0, np.maximum.accumulate(end)]
        start = np.maximum(start, reach[:-1]) if len(start) else start
        part = np.maximum(end - start, 0)
        before = np.r_[0, np.cumsum(part)]

        def covered(x: np.ndarray) -> np.ndarray:
            """Occupied pixels of all frames before x."""
            run = np.searchsorted(start, x, side="right")
            inside = np.minimum(x - start[np.maximum(run - 1, 0)], part[np.maximum(run - 1, 0)]) if len(start) else np.zeros(len(x), np.int64)
            return np.where(run > 0, before[np.maximum(run - 1, 0)] + inside, 0)

        place = f.group[owner] * span + s
        free = np.bincount(owner, weights=n - (covered(place + n) - covered(place)), minlength=f.size).astype(np.int64)
        rows = np.flatnonzero(~taken & (free >= least))
        rows = rows[np.lexsort((f["det_id"][rows], -free[rows], -f["confidence"][rows], f.group[rows]))]
        group = f.group[rows]
        rank = np.arange(len(rows)) - np.searchsorted(group, group) + 1
        return f.rows(rows, IDS, free=free[rows], rank=rank)

    rows = d.select(*IDS, "confidence", occupied.alias("occupied"), F.filter("runs", lambda r: r["n"] > 0).alias("runs"))
    return in_groups(rows, work, "det_id bigint, video_id bigint, frame_idx bigint, free bigint, rank bigint")
