"""Frames and regions: sampling of frames, joining of proposals to frames, regions nobody claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators.joins import interval, same_frame


def sampled_frames(d: DataFrame, fps: float | None, stride: int, start: float, end: float, seed: int, most: int | None = None) -> DataFrame:
    """Frames of a time range by stride (from the wanted rate where given); one, by a seeded hash, of ranges shorter than the stride; capped over all videos in order."""
    step = F.greatest(F.lit(1), F.round(F.col("video_fps") / fps)) if fps else F.lit(stride)
    inside = d.where((F.col("timestamp") >= start) & (F.col("timestamp") <= end)).withColumn("_step", step)
    w = Window.partitionBy("video_path")
    rows = inside.withColumns({"_first": F.min("frame_index").over(w), "_n": F.count("*").over(w), "_pick": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "frame_index"), "frame_index"))})
    short = F.col("_n") < F.col("_step")
    kept = rows.where((short & (F.col("_pick") == 1)) | (~short & ((F.col("frame_index") - F.col("_first")) % F.col("_step") == 0)))
    out = kept.withColumn("sampling_reason", F.when(short, "short_range").otherwise("stride")).drop("_step", "_first", "_n", "_pick")
    return out.orderBy("video_path", "frame_index").limit(most) if most else out


def proposals_on_frames(proposals: DataFrame, frames: DataFrame) -> DataFrame:
    """Proposals with their frame's number, by path, else by file name; those without frame or box go; every frame is kept."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    by_path = frames.select("frame_path", F.col("frame_index").alias("_i"))
    by_stem = frames.groupBy(stem(F.col("frame_path")).alias("_stem")).agg(F.min("frame_index").alias("_j"))
    rows = proposals.withColumn("_stem", stem(F.col("frame_path"))).join(by_path, "frame_path", "left").join(by_stem, "_stem", "left")
    placed = rows.withColumn("frame_index", F.coalesce("_i", "_j")).where("frame_index is not null and bbox is not null").drop("_i", "_j", "_stem", "frame_path")
    return frames.join(placed, "frame_index", "left")


def promoted_regions(regions: DataFrame, background: DataFrame, frame_area: float, w: int, h: int, gap: int = 5) -> DataFrame:
    """Unknown regions that are large and touch the border, with the id of the background track they continue, or a new negative one.

    Columns of ``regions``: det_id, video_id, frame_idx, bbox, mask_area; of
    ``background``: video_id, frame_idx, track_id, bbox.
    """
    wanted = regions.where((F.col("mask_area") / frame_area >= 0.05) & G.touches_border(F.col("bbox"), w, h))
    pairs = interval(wanted, background, gap, ["video_id"])
    iou = G.iou(F.col("a.bbox"), F.col("b.bbox"))
    best = pairs.where(iou >= 0.35).groupBy(F.col("a.det_id").alias("det_id")).agg(F.max_by("b.track_id", F.struct(iou, F.col("b.frame_idx"), F.col("b.track_id"))).alias("old"))
    rows = wanted.join(best, "det_id", "left")
    new = -F.sum(F.col("old").isNull().cast("int")).over(Window.partitionBy("video_id").orderBy("frame_idx", "det_id"))
    return rows.select("det_id", "video_id", "frame_idx", F.coalesce("old", new).alias("track_id"), F.col("old").isNotNull().alias("reused"))


def weak_utensils(d: DataFrame) -> DataFrame:
    """Carried-over utensils of low confidence near cookware or dishes that a hand holds (column ``held``)."""
    weak = d.where((F.col("coarse") == "utensil") & F.col("source").isin("memory_sam", "track_persist") & (F.col("confidence") < 0.35))
    held = d.where(F.col("coarse").isin("cookware", "dishware") & F.col("held") & F.col("confirmed"))
    near = (G.iou(F.col("a.bbox"), F.col("b.bbox")) >= 0.01) | (G.distance(F.col("a.bbox"), F.col("b.bbox")) <= 1.8 * G.diagonal(F.col("a.bbox")))
    return weak.alias("a").join(held.alias("b"), same_frame() & near, "left_semi")


def contaminated(d: DataFrame) -> DataFrame:
    """Recovered rows half of whose box lies on one scene box: their mask is dropped, the box stays."""
    rows = d.where(F.col("source") == "memory_sam")
    scene = d.where(L.is_scene(F.col("raw_label")))
    share = G.intersection(F.col("a.bbox"), F.col("b.bbox")) / F.greatest(F.lit(1.0), G.area(F.col("a.bbox")))
    pairs = rows.alias("a").join(scene.alias("b"), same_frame() & (F.col("a.det_id") != F.col("b.det_id")))
    return pairs.groupBy(F.col("a.det_id").alias("det_id")).agg(F.max(share).alias("scene_overlap")).where(F.col("scene_overlap") >= 0.50)


def recovery_candidates(tracks: DataFrame) -> DataFrame:
    """Tracks that may be recovered: stable, confident, young, with budget left; with the quality they need.

    Columns: track_id, coarse, fine, stable, confidence, recovery_age, budget, attached.
    """
    age = F.col("recovery_age") + 1
    lid, plate = L.is_lid_like(F.col("fine")) & F.col("attached"), L.is_plate_proxy(F.col("fine")) & F.col("attached")
    base = F.when(age == 1, 0.55).when(age == 2, 0.68).otherwise(0.80)
    needed = F.when(lid, F.greatest(F.lit(0.42), base - 0.15)).when(plate, F.greatest(F.lit(0.44), base - 0.12)).when(L.lowered(F.col("coarse")).isin("pot", "cooking pot", "saucepan", "pan", "frying pan", "cookware"), F.greatest(F.lit(0.48), base - 0.08)).otherwise(base)
    confidence = F.when(lid | plate, F.greatest(F.lit(0.22), F.col("confidence") * 0.90)).otherwise(F.greatest(F.lit(0.20), F.col("confidence") * 0.85))
    keep = (F.col("stable") >= 2) & (F.col("confidence") >= 0.20) & (age <= 7) & (F.col("budget") > 0)
    return tracks.where(keep).select("track_id", age.alias("recovery_age"), needed.alias("min_quality"), confidence.alias("recovered_confidence"))


def uncovered_parts(parts: DataFrame, frame_area: float, w: int, h: int, pad: int = 12, most: int = 3) -> DataFrame:
    """The largest uncovered parts of each frame (area share .025 or more), padded inside the frame."""
    order = Window.partitionBy("video_id", "frame_idx").orderBy(F.col("area").desc(), "part")
    rows = parts.where(F.col("area") / frame_area >= 0.025).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    b, zero = F.col("bbox"), F.lit(0.0)
    return rows.withColumn("bbox", G.box(F.greatest(zero, b["x1"] - pad), F.greatest(zero, b["y1"] - pad), F.least(F.lit(float(w)), b["x2"] + pad), F.least(F.lit(float(h)), b["y2"] + pad)))
