"""Ordered operators per track: smoothing, runs, motion, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.parameters import DEFAULTS, Parameters

TRACK = ["video_id", "track_id"]


def _order() -> list[Column]:
    return [F.col("frame_idx"), F.col("det_id")]


def smoothed(d: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Adds ``smoothed`` to the confirmed rows of each track.

    The last rows vote with their confidence times their place; the first label
    to reach the best score wins unless a trailing streak of another is long and
    confident enough. Sums run from the newest row back, as the SQL's join deals
    them: labels whose scores are equal but for rounding fall as they do there.
    """
    frame = Window.partitionBy(*TRACK).orderBy(*_order()).rowsBetween(-(p.smoothing_window - 1), 0)
    rows = d.where(F.col("confirmed") & (F.col("track_id") >= 0)).withColumn("h", F.collect_list(F.struct(F.col("coarse").alias("l"), F.col("confidence").alias("c"))).over(frame))
    h = F.col("h")
    names = F.array_distinct(F.transform(h, lambda x: x["l"]))
    score = lambda name: F.aggregate(F.reverse(F.transform(h, lambda x, i: F.when(x["l"] == name, F.greatest(F.lit(0.01), x["c"]) * (i + 1)).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x)
    scored = F.transform(names, lambda name: F.struct(name.alias("l"), score(name).alias("s")))
    best = F.aggregate(scored, F.struct(F.lit("").alias("l"), F.lit(-1.0).alias("s")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    rows = rows.withColumn("best", best["l"]).withColumn("last", F.element_at(h, -1)["l"])
    n = F.size(h)
    other = F.aggregate(F.transform(h, lambda x, i: F.when(x["l"] != F.col("last"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    rows = rows.withColumn("other", other).withColumn("streak", n - F.col("other"))
    total = lambda keep: F.aggregate(F.reverse(F.transform(h, lambda x, i: F.when(keep(x, i), x["c"]).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x)
    recent = total(lambda x, i: i >= F.col("other")) / F.col("streak")
    of_best = F.size(F.filter(h, lambda x: x["l"] == F.col("best")))
    usual = total(lambda x, i: x["l"] == F.col("best")) / of_best
    flip = (F.col("last") != F.col("best")) & (F.col("streak") >= p.flip_streak) & (recent + p.flip_gain >= usual)
    return rows.withColumn("smoothed", F.when(flip, F.col("last")).otherwise(F.col("best"))).drop("h", "other", "streak", "best", "last")


def runs(d: DataFrame, label: str) -> DataFrame:
    """Label runs of each track: how many, switches, and the labels in order."""
    w = Window.partitionBy(*TRACK).orderBy(*_order())
    before = F.lag(label).over(w)
    new = d.withColumn("_new", before.isNull() | (before != F.col(label))).where("_new")
    listed = F.array_sort(F.collect_list(F.struct("frame_idx", "det_id", F.col(label).alias("l"))))
    return new.groupBy(*TRACK).agg(F.count("*").alias("runs"), (F.count("*") - 1).alias("switches"), F.concat_ws(">", F.transform(listed, lambda x: x["l"])).alias("history"))


def motion(d: DataFrame) -> DataFrame:
    """Adds the centre's move since the track's row before, in pixels and against the square root of the area; and the area's ratio."""
    before = F.lag("bbox").over(Window.partitionBy(*TRACK).orderBy(*_order()))
    rows = d.withColumn("_before", before)
    px = F.coalesce(G.distance(F.col("bbox"), F.col("_before")), F.lit(0.0))
    size = G.area(F.col("bbox"))
    return rows.withColumns({"motion_px": px, "motion_norm": px / F.greatest(F.lit(1.0), F.sqrt(size)), "area_ratio": F.when(F.col("_before").isNotNull(), size / F.greatest(F.lit(1.0), G.area(F.col("_before"))))}).drop("_before")


def streaks(d: DataFrame, keys: list[str], order: list[str], condition: Column, name: str = "streak") -> DataFrame:
    """Adds how many rows in a row, up to this one, meet the condition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = d.withColumn("_hit", condition).withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    inner = Window.partitionBy(*keys, "_island").orderBy(*order)
    return rows.withColumn(name, F.when(F.col("_hit"), F.sum(F.col("_hit").cast("int")).over(inner)).otherwise(0)).drop("_hit", "_island")


def dense_first_seen(d: DataFrame, groups: list[str], label: str, position: str) -> DataFrame:
    """Ids of labels in order of group and first appearance, from 0; -1 stays."""
    firsts = d.where(F.col(label) >= 0).groupBy(*groups, label).agg(F.min(position).alias("_first"))
    ids = firsts.withColumn("new_id", F.row_number().over(Window.orderBy(*groups, "_first")) - 1).drop("_first")  # one row for each cluster
    return d.join(ids, [*groups, label], "left").withColumn("new_id", F.coalesce("new_id", F.lit(-1)))


def capped(d: DataFrame, keys: list, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def motion_hold(d: DataFrame, value: str, threshold: float, stride: int, dense: int) -> DataFrame:
    """Frames of the base stride, and of the dense stride for ``stride`` frames after strong change."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rangeBetween(-stride, 0)
    held = F.max(F.when(F.col(value) > threshold, 1).otherwise(0)).over(w) == 1
    kept = d.withColumn("_held", held).where((F.col("frame_idx") % stride == 0) | (F.col("_held") & (F.col("frame_idx") % dense == 0)))
    return kept.withColumn("frame_id", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")) - 1).drop("_held")


def running_total(d: DataFrame, order: str, value: Column, name: str, span: int = 1 << 20) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``order`` (a whole number, without ties).

    Two levels, so that no task sorts the table: sums inside ranges of ``order``,
    and over the ranges' totals, of which there are few.
    """
    rows = d.withColumns({"_range": F.floor(F.col(order) / span), "_value": value})
    totals = rows.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_total")
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(before, "_range").withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_range", "_value", "_inside", "_before")
