"""Pixels that foreground objects own, and scene rows that would take them.

Columns: det_id, video_id, frame_idx, raw_label, coarse, track_id, confirmed,
bbox; ``runs`` is a mask on a grid of ``grid`` pixels, null without one;
``held`` says whether a hand holds the object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import runs as M
from frameloom.operators.joins import interval, same_frame
from frameloom.operators.masks import area

FRAME = ["video_id", "frame_idx"]
#: Scene labels that a moving object is easily taken for.
SURFACES = ("sink", "countertop", "wall", "cabinet", "cooktop", "burner", "stove burner")


def recent_tracks(d: DataFrame, gap: int = 5) -> DataFrame:
    """For each frame the movable tracks last seen 1 to ``gap`` frames before it: frame, and the row that saw them last."""
    seen = d.where(F.col("confirmed") & (F.col("track_id") >= 0) & L.is_movable(F.col("coarse")))
    one = Window.partitionBy("video_id", "track_id", "frame_idx").orderBy(F.col("det_id").desc())
    seen = seen.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    frames = d.select(*FRAME).distinct()
    pairs = interval(frames, seen, gap, ["video_id"])
    track = F.struct(*[F.col(f"b.{c}") for c in seen.columns if c not in ("video_id", "frame_idx")])
    last = pairs.groupBy(F.col("a.video_id").alias("video_id"), F.col("a.frame_idx").alias("frame_idx"), F.col("b.track_id").alias("_track")).agg(F.max_by(track, F.col("b.frame_idx")).alias("_s"))
    return last.select(*FRAME, "_s.*")


def protected(d: DataFrame, recent: DataFrame, width: int, height: int, grid: int = 1, pixels: int = 8) -> DataFrame:
    """(frame, det_id, track_id, bbox, runs): regions of movable confirmed rows of a frame, grown by ``pixels`` (twice as far in a hand), and of tracks seen shortly before that are not among them."""
    now = d.where(F.col("confirmed") & L.is_movable(F.col("coarse")))
    mine = now.where("track_id IS NOT NULL").select(*FRAME, "track_id").distinct()
    past = recent.join(mine, [*FRAME, "track_id"], "left_anti").withColumn("runs", F.lit(None).cast("array<struct<s: bigint, n: bigint>>"))
    near, far = max(0, pixels // grid), max(0, 2 * pixels // grid)
    columns = [*FRAME, "det_id", "track_id", "bbox", "held", "runs"]
    both = now.select(columns).unionByName(past.select(columns))
    by = F.when(F.col("held"), far).otherwise(near)
    shape = F.when(F.col("runs").isNull(), M.of_box(F.col("bbox"), width, height, grid, by)).when(F.col("held"), M.dilated(F.col("runs"), far, width, height)).otherwise(M.dilated(F.col("runs"), near, width, height))
    return both.withColumn("runs", shape)


def clipped(scene: DataFrame, regions: DataFrame, width: int, least: float = 0.15) -> DataFrame:
    """(det_id, runs, overlap, clipped): scene masks without the pixels of their frame's regions, where those cover a share of ``least`` or more; ``overlap`` is that share."""
    mine = scene.select(*FRAME, F.col("det_id").alias("scene_id"), "runs")
    taken = mine.alias("a").join(regions.alias("b"), same_frame()).select(F.col("a.scene_id").alias("scene_id"), F.col("b.runs").alias("runs"))
    # only the part of the regions on the scene's own rows can matter
    lines = mine.select("scene_id", F.floor(F.array_min("runs.s") / width).alias("lo"), F.floor(F.array_max("runs.s") / width).alias("hi"))
    taken = taken.join(lines, "scene_id").select("scene_id", F.filter("runs", lambda r: (r["s"] >= F.col("lo") * width) & (r["s"] < (F.col("hi") + 1) * width)).alias("runs"))
    left = M.without(mine, taken, ["scene_id"], width).withColumnRenamed("runs", "rest")
    joined = mine.join(left, "scene_id", "left").withColumn("rest", F.coalesce("rest", F.array().cast("array<struct<s: bigint, n: bigint>>")))
    share = (area(F.col("runs")) - area(F.col("rest"))) / F.greatest(F.lit(1), area(F.col("runs")))
    out = joined.withColumn("overlap", share)
    return out.select(F.col("scene_id").alias("det_id"), F.when(F.col("overlap") >= least, F.col("rest")).otherwise(F.col("runs")).alias("runs"), "overlap", (F.col("overlap") >= least).alias("clipped"))


def blocked(scene: DataFrame, d: DataFrame, recent: DataFrame, frame_area: float) -> DataFrame:
    """(det_id, reason, track): why a scene row must not take its place, null if it may.

    Rows that cover a track seen shortly before (IoU .35 or containment .65)
    are blocked, and so are small surfaces (share of the frame up to .18) near
    a hand, or on an object that moved 8 pixels or more, or that is new.
    """
    pairs = scene.alias("a").join(recent.alias("b"), same_frame())
    near = pairs.where(G.may_reach(F.col("a.bbox"), F.col("b.bbox"), 0.35) | G.may_contain(F.col("a.bbox"), F.col("b.bbox"), 0.65))
    score = F.greatest(G.iou(F.col("a.bbox"), F.col("b.bbox")) / 0.35, G.containment(F.col("a.bbox"), F.col("b.bbox")) / 0.65)
    over = near.groupBy(F.col("a.det_id").alias("det_id")).agg(F.max(F.struct(score.alias("score"), (-F.col("b.track_id")).alias("first"), F.col("b.held").alias("held"))).alias("m")).where("m.score >= 1")

    small = scene.where(L.canonical_scene(F.col("raw_label")).isin(*SURFACES) & (G.area(F.col("bbox")) / frame_area <= 0.18))
    hands = d.where("coarse = 'hand'")
    reach = (G.iou(F.col("a.bbox"), F.col("b.bbox")) >= 0.01) | (G.distance(F.col("a.bbox"), F.col("b.bbox")) <= 1.4 * G.diagonal(F.col("b.bbox")))
    by_hand = small.alias("a").join(hands.alias("b"), same_frame() & reach, "left_semi").select("det_id")
    objects = d.where(~L.is_scene(F.col("raw_label")))
    lies = G.may_reach(F.col("a.bbox"), F.col("b.bbox"), 0.20) | G.may_contain(F.col("a.bbox"), F.col("b.bbox"), 0.50)
    on = small.alias("a").join(objects.alias("b"), same_frame() & lies)
    exact = (G.iou(F.col("a.bbox"), F.col("b.bbox")) >= 0.20) | (G.containment(F.col("a.bbox"), F.col("b.bbox")) >= 0.50)
    first = on.groupBy(F.col("a.det_id").alias("det_id"), *[F.col(f"a.{c}").alias(c) for c in FRAME]).agg(F.min(F.when(exact, F.struct(F.col("b.det_id").alias("id"), F.col("b.track_id").alias("track_id"), F.col("b.bbox").alias("bbox")))).alias("o")).where("o IS NOT NULL")
    known = recent.select(*FRAME, F.col("track_id").alias("_t"), F.col("bbox").alias("_old"))
    placed = first.withColumn("_t", F.col("o.track_id")).join(known, [*FRAME, "_t"], "left")
    moving = placed.where(F.col("_old").isNull() | (G.distance(F.col("o.bbox"), F.col("_old")) >= 8.0)).select("det_id")
    suspicious = by_hand.unionByName(moving).distinct().withColumn("suspicious", F.lit(True))

    rows = scene.select("det_id").join(over, "det_id", "left").join(suspicious, "det_id", "left")
    reason = F.when(F.col("m.held"), "blocked_scene_takeover_handheld").when(F.col("m").isNotNull(), "blocked_scene_takeover_recent_foreground").when(F.col("suspicious"), "suspicious_scene_on_moving_object")
    return rows.select("det_id", reason.alias("reason"), (-F.col("m.first")).alias("track"))
