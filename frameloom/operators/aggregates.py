"""Summaries of a run, of tracks, and of scene boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import scores as S


def counts_by(d: DataFrame, *columns: str) -> DataFrame:
    """(metric, key, n) for each column, in one pass."""
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns])).alias("e"))
    return long.groupBy("e.metric", "e.key").agg(F.count("*").alias("n"))


def run_totals(d: DataFrame) -> DataFrame:
    """One row: detections, frames, tracks, unconfirmed and negative ones, mean confidence."""
    return d.agg(
        F.count("*").alias("detections"),
        F.countDistinct("video_id", "frame_idx").alias("frames"),
        F.countDistinct(F.when(F.col("track_id") >= 0, F.col("track_id"))).alias("tracks"),
        F.count_if(~F.col("confirmed")).alias("unconfirmed"),
        F.count_if(F.col("track_id") < 0).alias("negative_tracks"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def track_spread(d: DataFrame) -> DataFrame:
    """Entropy of each track's raw labels and stability of its confidence."""
    counts = d.groupBy("track_id", "raw_label").agg(F.count("*").alias("n")).groupBy("track_id").agg(F.collect_list(F.col("n").cast("double")).alias("ns"))
    spread = d.groupBy("track_id").agg(F.round(F.when(F.count("*") < 2, 0.5).otherwise(F.exp(-F.stddev_pop("confidence") / 0.1)), 6).alias("stability"))
    return counts.select("track_id", F.round(S.entropy(F.col("ns")), 6).alias("entropy")).join(spread, "track_id")


def label_votes(d: DataFrame) -> DataFrame:
    """Weighted votes of each track: best coarse label, its share, and how many labels it had."""
    weight = F.col("confidence") * F.when(F.col("source") == "yolo_world", 1.0).when(F.col("source") == "track_persist", 0.2).otherwise(0.5)
    votes = d.where("track_id >= 0").groupBy("track_id", "coarse").agg(F.sum(weight).alias("w"))
    return votes.groupBy("track_id").agg(
        F.max_by("coarse", F.struct(F.round("w", 6), "coarse")).alias("label"), F.round(F.max("w") / F.sum("w"), 6).alias("share"), F.count("*").alias("labels"),
    )


def hand_frames(d: DataFrame) -> DataFrame:
    """Every recorded frame: hands, confirmed hands, and whether hands have just gone."""
    by_frame = d.groupBy("video_id", "frame_idx").agg(F.count_if(F.col("coarse") == "hand").alias("hands"), F.count_if((F.col("coarse") == "hand") & F.col("confirmed")).alias("confirmed_hands"))
    before = F.lag("hands", 1, 0).over(Window.partitionBy("video_id").orderBy("frame_idx"))
    return by_frame.withColumn("disappeared", (before > 0) & (F.col("hands") == 0))


def overlap_tracks(d: DataFrame, least_iou: float) -> DataFrame:
    """Track pairs of cookware over dishware, with the number of frames."""
    from frameloom.operators.joins import frame_pairs

    rows = d.where(F.col("confirmed") & F.col("coarse").isin("cookware", "dishware"))
    pairs = frame_pairs(rows).where((F.col("a.coarse") != F.col("b.coarse")) & (G.iou(F.col("a.bbox"), F.col("b.bbox")) > least_iou))
    first = F.col("a.coarse") == "cookware"
    return pairs.groupBy(F.when(first, F.col("a.track_id")).otherwise(F.col("b.track_id")).alias("cookware_track"), F.when(first, F.col("b.track_id")).otherwise(F.col("a.track_id")).alias("dishware_track")).agg(F.count("*").alias("frames"))


def track_quality(d: DataFrame) -> DataFrame:
    """Score, flags and category of each track."""
    votes = label_votes(d).select("track_id", "share")
    base = d.where("track_id >= 0").groupBy("track_id").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("confirmed").cast("double")).alias("confirmed"), F.stddev_pop(G.area(F.col("bbox"))).alias("spread"), F.avg(G.area(F.col("bbox"))).alias("area"),
    )
    steady = F.exp(-F.col("spread") / F.col("area"))
    score = 0.35 * F.col("confidence") + 0.25 * F.col("share") + 0.20 * F.col("confirmed") + 0.10 * steady + 0.10 * F.least(F.lit(1.0), F.col("n") / 20.0)
    flags = F.array_compact(F.array(F.when(F.col("share") < 0.5, "label_jitter"), F.when(F.col("n") < 3, "short"), F.when(F.col("confirmed") < 0.5, "unconfirmed")))
    scored = base.join(votes, "track_id").withColumn("score", score).withColumn("flags", F.concat_ws(",", flags))
    category = F.when(F.col("score") >= 0.75, "gold").when(F.col("score") >= 0.60, "silver").when(F.col("score") >= 0.45, "review").otherwise("reject")
    return scored.select("track_id", F.col("n").alias("length"), F.round("score", 6).alias("score"), "flags", category.alias("category"))


def tuning_profile(corrections: DataFrame, least: int = 1) -> DataFrame:
    """Mean box scale and mask growth of each label's geometry corrections; labels with too few go."""
    out = corrections.where("action = 'geometry'").groupBy("label").agg(F.round(F.avg("bbox_scale"), 3).alias("bbox_scale"), F.round(F.avg("mask_grow")).cast("bigint").alias("mask_grow"), F.count("*").alias("sample_count"))
    return out.where(F.col("sample_count") >= least)


def merged_cluster(d: DataFrame, keys: list[str]) -> DataFrame:
    """One detection for each cluster of cookware boxes: common box, best weighted label, raised confidence."""
    lid = F.lower(F.trim("raw_label")).isin("lid", "pot lid", "pan lid")
    per_label = d.groupBy(*keys, "fine").agg(F.sum(F.col("confidence") * F.when(lid, 0.92).otherwise(1.18)).alias("w"), G.union_agg(F.col("bbox")).alias("b"), F.max("confidence").alias("c"), F.count("*").alias("n"))
    return per_label.groupBy(*keys).agg(F.max_by("fine", F.struct(F.round("w", 6), "fine")).alias("label"), G.union_agg(F.col("b")).alias("bbox"), F.least(F.lit(0.99), F.max("c") + 0.04).alias("confidence"), F.sum("n").alias("members"))
