"""Row predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.parameters import DEFAULTS, Parameters


def new_track_floor(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Adds ``may_start``: confident enough for a new track of its coarse group."""
    floor = F.coalesce(L.looked_up(F.lower("coarse"), {k: v for k, v in p.new_track_floor.items()}), F.lit(p.new_track_floor_other))
    return d.withColumn("may_start", F.col("confidence") >= floor)


def plausible_utensil(coarse: Column, confidence: Column, bbox: Column, confirmed: Column) -> Column:
    """Other groups always; utensils that are confident, or long and confirmed."""
    return (F.lower(coarse) != "utensil") | (confidence >= 0.60) | ((G.aspect(bbox) >= 2.2) & confirmed)


def confirmed_rank(track_id: Column, confirmed: Column) -> Column:
    """2 for a confirmed track, 1 for a confirmed detection, else 0."""
    return F.when(~confirmed, 0).when(track_id >= 0, 2).otherwise(1)


def source_rank(source: Column) -> Column:
    return F.coalesce(L.looked_up(source, T.SOURCE_RANK), F.lit(0))


def group_rank(coarse: Column) -> Column:
    return F.coalesce(L.looked_up(F.lower(coarse), T.GROUP_RANK), F.lit(0))


def is_strong(source: Column) -> Column:
    return source.isin(*T.STRONG_SOURCES)


def quality_filter(d: DataFrame, confidence_below: float | None = None, area_below: float | None = None, area_above: float | None = None, aspect_above: float | None = None) -> DataFrame:
    """Rows that meet every condition that is given."""
    wanted = [
        condition
        for given, condition in (
            (confidence_below, F.col("confidence") < confidence_below),
            (area_below, F.col("area") < area_below),
            (area_above, F.col("area") > area_above),
            (aspect_above, F.col("aspect") > aspect_above),
        )
        if given is not None
    ]
    return d.where(reduce(lambda a, b: a & b, wanted)) if wanted else d


def kept_or_all(d: DataFrame, keep: Column, groups: list[str] | None = None) -> DataFrame:
    """Rows that are to be kept; all rows of a group (or the table) that has none."""
    if groups:
        some = d.groupBy(*groups).agg(F.bool_or(keep).alias("_some"))
        return d.join(some, groups).where(keep | ~F.col("_some")).drop("_some")
    some = d.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_some"))
    return d.crossJoin(F.broadcast(some)).where(keep | ~F.col("_some")).drop("_some")  # one row


def valid_mask(mask_iou: Column, area: Column, fill: Column) -> Column:
    """Neither the whole box, nor tiny, nor nearly full."""
    return ~((mask_iou > 0.82) | (area < 50) | (fill > 0.80))


def objectness(flags: Column, confidence: Column) -> tuple[Column, Column]:
    """Score from the number of flags and the confidence; and its class."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 - 0.18 * F.size(flags) + F.when(confidence >= 0.5, 0.05).otherwise(-0.05)))
    return score, F.when(score >= 0.70, "real").when(score >= 0.40, "uncertain").otherwise("fake")


def hard_gate_reasons(appearance: Column, size_ratio: Column, depth_gap: Column, iou: Column, in_conflict: Column) -> Column:
    """Why a track and a detection cannot match; empty if they can."""
    floor = F.when(in_conflict, 0.50).otherwise(0.35)
    return F.array_compact(
        F.array(
            F.when(appearance < floor, "low_appearance"),
            F.when((size_ratio > 2.5) & (appearance < 0.75), "size_ratio"),
            F.when((depth_gap > 0.25) & (iou < 0.30), "depth_gap"),
        )
    )


def class_balance(instances: DataFrame, classes: DataFrame) -> DataFrame:
    """Instances and images of every class, with a flag for rare and missing ones."""
    counts = instances.groupBy("class_id").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    out = classes.join(counts, "class_id", "left").na.fill(0, ["instances", "images"])
    return out.withColumn("state", F.when(F.col("instances") == 0, "none").when(F.col("instances") < 300, "rare").otherwise("ok"))
