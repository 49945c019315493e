"""Spatial, best-match, interval and greedy joins.

All are equi-joins on the frame, or on cells of a grid or of time, with the
exact condition on top; none needs a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.parameters import DEFAULTS, Parameters

FRAME = ["video_id", "frame_idx"]


def same_frame(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.video_id") == F.col(f"{b}.video_id")) & (F.col(f"{a}.frame_idx") == F.col(f"{b}.frame_idx"))


def frame_pairs(d: DataFrame) -> DataFrame:
    """Unordered pairs of a frame's rows, as aliases a and b (a has the smaller det_id)."""
    return d.alias("a").join(d.alias("b"), same_frame() & (F.col("a.det_id") < F.col("b.det_id")))


def box_key(bbox: Column, digits: int = 3) -> Column:
    """A box rounded half to even, for joins by equality."""
    return F.struct(*[F.bround(bbox[n], digits).alias(n) for n in ("x1", "y1", "x2", "y2")])


def with_mask(d: DataFrame, masks: DataFrame) -> DataFrame:
    """Left join with the last mask of equal frame, label and rounded box."""
    keys = [*FRAME, "label", "_box"]
    last = masks.withColumn("_box", box_key(F.col("bbox"))).groupBy(*keys).agg(F.max_by("mask_area", "seq").alias("mask_area"))
    return d.withColumn("_box", box_key(F.col("bbox"))).join(last, keys, "left").drop("_box")


def best_label(rows: DataFrame, named: DataFrame) -> DataFrame:
    """For each row the label of the best box of its frame: of equal or contained labels the largest IoU, else any of .1 or more."""
    a, b = rows.alias("a"), named.alias("b")
    iou = G.iou(F.col("a.bbox"), F.col("b.bbox"))
    x, y = L.lowered(F.col("a.label")), L.lowered(F.col("b.label"))
    related = F.contains(x, y) | F.contains(y, x)
    pairs = a.join(b, same_frame()).select(F.col("a.det_id").alias("det_id"), F.col("b.label").alias("other"), iou.alias("iou"), related.cast("int").alias("related"), F.col("b.det_id").alias("other_id"))
    pairs = pairs.where((F.col("related") == 1) | (F.col("iou") >= 0.1))
    return pairs.groupBy("det_id").agg(F.max_by(F.struct("other", "iou", "related"), F.struct("related", "iou", -F.col("other_id"))).alias("m")).select("det_id", "m.*")


def without_covered(rows: DataFrame, current: DataFrame, least_iou: float) -> DataFrame:
    """Anti-join: rows without a box of their family in the frame at the IoU."""
    hit = G.iou(F.col("a.bbox"), F.col("b.bbox")) >= least_iou
    return rows.alias("a").join(current.alias("b"), same_frame() & L.same_family(F.col("a.label"), F.col("b.label")) & hit, "left_anti")


def nearest_hand(d: DataFrame, hands: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Left join of each row with the hand of largest IoU (above 0); attached if it overlaps, is near, or grabs."""
    pairs = d.alias("a").join(hands.alias("h"), same_frame("a", "h") & (F.col("a.det_id") != F.col("h.det_id")))
    iou, far = G.iou(F.col("a.bbox"), F.col("h.bbox")), G.distance(F.col("a.bbox"), F.col("h.bbox"))
    near = far <= p.hand_distance_scale * G.diagonal(F.col("a.bbox"))
    attached = (iou >= p.hand_iou) | near | F.col("h.grabbing")
    found = pairs.where(iou > 0).groupBy(F.col("a.det_id").alias("det_id")).agg(F.max_by(F.struct(F.col("h.det_id").alias("hand_id"), iou.alias("hand_iou"), far.alias("hand_distance"), attached.alias("attached")), F.struct(iou, -F.col("h.det_id"))).alias("m"))
    return d.join(found.select("det_id", "m.*"), "det_id", "left").withColumn("attached", F.coalesce("attached", F.lit(False)))


def occluded_frames(d: DataFrame, hands: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Frames whose hands' common box covers three or more confirmed tracks of the previous frame."""
    around = hands.groupBy(*FRAME).agg(G.union_agg(F.col("bbox")).alias("bbox"))
    tracks = d.where(F.col("confirmed") & (F.col("track_id") >= 0)).select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), "track_id", "bbox")
    hit = (G.iou(F.col("h.bbox"), F.col("t.bbox")) >= p.occlusion_iou) | (G.containment(F.col("h.bbox"), F.col("t.bbox")) >= p.occlusion_containment)
    return (
        around.alias("h").join(tracks.alias("t"), same_frame("h", "t") & hit).groupBy(F.col("h.video_id").alias("video_id"), F.col("h.frame_idx").alias("frame_idx"))
        .agg(F.countDistinct("t.track_id").alias("affected")).where(F.col("affected") >= p.occlusion_tracks)
    )


def interval(left: DataFrame, right: DataFrame, gap: int, keys: list[str], time: str = "frame_idx") -> DataFrame:
    """Pairs (aliases a, b) with equal keys and 1 <= a.time - b.time <= gap.

    Time is cut into cells of ``gap``; the right side is put into its cell and
    the next, so that the join is by equality.
    """
    cells = right.withColumn("_cell", F.explode(F.array(F.floor(F.col(time) / gap), F.floor(F.col(time) / gap) + 1)))
    a, b = left.withColumn("_cell", F.floor(F.col(time) / gap)).alias("a"), cells.alias("b")
    on = F.col("a._cell") == F.col("b._cell")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    step = F.col(f"a.{time}") - F.col(f"b.{time}")
    return a.join(b, on & (step >= 1) & (step <= gap))


def recent_candidates(d: DataFrame, gap: int, least_iou: float) -> DataFrame:
    """For each detection the recent track row of its label with the largest IoU (then the latest, then the largest id)."""
    past = d.where(F.col("track_id") >= 0)
    pairs = interval(d, past, gap, ["video_id", "coarse"])
    iou = G.iou(F.col("a.bbox"), F.col("b.bbox"))
    near = pairs.where(G.may_reach(F.col("a.bbox"), F.col("b.bbox"), least_iou))
    best = near.groupBy(F.col("a.det_id").alias("det_id")).agg(F.max(F.struct(iou.alias("iou"), F.col("b.frame_idx").alias("at"), F.col("b.det_id").alias("past_id"), F.col("b.track_id").alias("past_track"))).alias("m"))
    return best.where(F.col("m.iou") >= least_iou).select("det_id", "m.past_track", "m.past_id", "m.iou")


def scene_takeovers(scene: DataFrame, movable: DataFrame, gap: int = 5) -> DataFrame:
    """Scene rows that cover a recent movable track: IoU .35 or containment .65."""
    pairs = interval(scene, movable, gap, ["video_id"])
    iou, inside = G.iou(F.col("a.bbox"), F.col("b.bbox")), G.containment(F.col("a.bbox"), F.col("b.bbox"))
    score = F.greatest(iou / 0.35, inside / 0.65)
    near = pairs.where(G.may_reach(F.col("a.bbox"), F.col("b.bbox"), 0.35) | G.may_contain(F.col("a.bbox"), F.col("b.bbox"), 0.65))
    best = near.groupBy(F.col("a.det_id").alias("det_id")).agg(F.max(F.struct(score.alias("score"), F.col("b.det_id").alias("past_id"), F.col("b.track_id").alias("track"))).alias("m"))
    return best.where("m.score >= 1").select("det_id", "m.track", "m.score")


def grid_pairs(left: DataFrame, right: DataFrame, cell: float, least_iou: float, keys: list[str]) -> DataFrame:
    """Overlapping pairs across a key, by grid cells; each pair once (in the cell of its common corner)."""

    def celled(d: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(f"bbox.{a}") / cell), F.floor(F.col(f"bbox.{b}") / cell))
        return d.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))

    a, b = celled(left).alias("a"), celled(right).alias("b")
    on = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    corner_x = F.floor(F.greatest(F.col("a.bbox.x1"), F.col("b.bbox.x1")) / cell)
    corner_y = F.floor(F.greatest(F.col("a.bbox.y1"), F.col("b.bbox.y1")) / cell)
    once = (corner_x == F.col("a._cx")) & (corner_y == F.col("a._cy"))
    return a.join(b, on & once & (G.iou(F.col("a.bbox"), F.col("b.bbox")) >= least_iou))


def overlap_conflicts(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Pairs of confirmed tracked rows of one frame with different coarse labels and an IoU above the limit."""
    rows = d.where(F.col("confirmed") & F.col("track_id").isNotNull())
    iou = G.iou(F.col("a.bbox"), F.col("b.bbox"))
    pairs = frame_pairs(rows).where(F.lower("a.coarse") != F.lower("b.coarse")).where(iou > p.confirmed_overlap_iou)
    return pairs.select(
        F.col("a.video_id").alias("video_id"), F.col("a.frame_idx").alias("frame_idx"), F.col("a.det_id").alias("first_id"), F.col("a.track_id").alias("first_track"),
        F.col("a.coarse").alias("first_coarse"), F.col("b.det_id").alias("second_id"), F.col("b.track_id").alias("second_track"), F.col("b.coarse").alias("second_coarse"), iou.alias("iou"),
    )


def conflict_zones(d: DataFrame) -> DataFrame:
    """Rows near another one (IoU above .25, or centres close), with how many and which."""
    iou, close = G.iou(F.col("a.bbox"), F.col("b.bbox")), G.center_distance_ratio(F.col("a.bbox"), F.col("b.bbox"))
    pairs = frame_pairs(d).where((iou > 0.25) | (close < 0.08)).select(F.col("a.det_id").alias("x"), F.col("b.det_id").alias("y"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return both.groupBy(F.col("x").alias("det_id")).agg(F.count("*").alias("partners"), F.concat_ws(",", F.array_sort(F.collect_list("y"))).alias("partner_ids"))


def positional_outer(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Full outer join by stem and position, with the file's unmatched number."""
    return truth.alias("g").join(predicted.alias("p"), ["stem", "pos"], "full_outer").select("stem", "pos", F.col("g.class_id").alias("truth"), F.col("p.class_id").alias("predicted"))


def smallest_at(d: DataFrame, points: DataFrame) -> DataFrame:
    """For each point of a frame the smallest box that holds it."""
    pairs = points.alias("q").join(d.alias("d"), same_frame("q", "d") & G.contains_point(F.col("d.bbox"), F.col("q.x"), F.col("q.y")))
    size = G.area(F.col("d.bbox"))
    return pairs.groupBy("q.point_id").agg(F.min_by(F.struct(F.col("d.det_id").alias("det_id"), size.alias("area")), F.struct(size, F.col("d.det_id"))).alias("m")).select("point_id", "m.*")


def split_by_frames(d: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Semi and anti join: the rows in and outside the chosen keys."""
    return d.join(chosen, key, "left_semi"), d.join(chosen, key, "left_anti")


def pending(videos: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Videos that the ledger doesn't list as done, in order."""
    rest = videos.join(ledger.where("state = 'completed'"), "video_id", "left_anti").orderBy("video_id")
    return rest.limit(limit) if limit else rest
