"""Hand, surface and cookware relations of objects, and event candidates over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators.joins import same_frame
from frameloom.operators.windows import streaks


def _best(d: DataFrame, other: DataFrame, value, order, where, name: str) -> DataFrame:
    pairs = d.alias("a").join(other.alias("b"), same_frame() & (F.col("a.det_id") != F.col("b.det_id"))).where(where)
    return pairs.groupBy(F.col("a.det_id").alias("det_id")).agg(F.max_by(value, F.struct(order, -F.col("b.det_id"))).alias(name))


def supports_cookware() -> object:
    """A lid or plate over a cookware body: enough overlap, a fitting size, near the centre."""
    a, b = F.col("a.bbox"), F.col("b.bbox")
    ratio = F.greatest(F.lit(1.0), G.area(a)) / F.greatest(F.lit(1.0), G.area(b))
    near = G.distance(a, b) <= F.greatest(F.lit(18.0), G.diagonal(b) * 0.38)
    return (L.cookware_kind(F.col("b.raw_label")) == "body") & (L.is_lid_like(F.col("a.fine")) | L.is_plate_proxy(F.col("a.fine"))) & (G.iou(a, b) >= 0.12) & ratio.between(0.08, 1.20) & near


def snapshot(d: DataFrame) -> DataFrame:
    """Every confirmed object with its hand, surface and cookware relation and whether a hand holds it.

    Columns added: hand_id, hand_iou, hand_distance, surface, surface_iou,
    cookware_id, cookware_iou, attached, manipulable.
    """
    a, b = F.col("a.bbox"), F.col("b.bbox")
    hands = d.where(F.lower(F.trim("raw_label")) == "hand")
    scene = d.where(L.is_scene(F.col("raw_label")))
    objects = d.where((F.col("coarse") != "hand") & ~L.is_scene(F.col("raw_label")) & F.col("confirmed") & (F.col("track_id") >= 0))
    size = F.greatest(F.lit(1.0), F.sqrt(G.area(a)))
    iou = G.iou(a, b)
    hand = _best(objects, hands, F.struct(F.col("b.det_id").alias("hand_id"), iou.alias("hand_iou"), G.distance(a, b).alias("hand_distance"), G.area(b).alias("hand_area")), iou - G.distance(a, b) / size, F.lit(True), "h")
    surface = _best(objects, scene, F.struct(L.surface_kind(F.col("b.raw_label")).alias("surface"), iou.alias("surface_iou")), iou, iou > 0, "s")
    cookware = _best(objects, d.where(L.cookware_kind(F.col("raw_label")).isNotNull()), F.struct(F.col("b.det_id").alias("cookware_id"), iou.alias("cookware_iou")), iou, supports_cookware(), "c")
    rows = objects.join(hand, "det_id", "left").join(surface, "det_id", "left").join(cookware, "det_id", "left")
    manipulable = L.lowered(F.col("coarse")).isin(*T.MANIPULABLE) | L.is_lid_like(F.col("fine")) | L.is_plate_proxy(F.col("fine"))
    own = G.area(F.col("bbox"))
    touching = (F.col("h.hand_iou") >= 0.03) | (F.col("h.hand_distance") <= F.greatest(F.lit(14.0), F.sqrt(own) * 0.45))
    attached = manipulable & touching & (F.greatest(F.lit(1.0), own) / F.greatest(F.lit(1.0), F.col("h.hand_area")) <= 4.5) & (F.col("h.hand_iou") >= 0.06)
    return rows.select(
        *[F.col(c) for c in objects.columns], "h.hand_id", "h.hand_iou", "h.hand_distance", "s.surface", "s.surface_iou", "c.cookware_id", "c.cookware_iou", F.coalesce(attached, F.lit(False)).alias("attached"), manipulable.alias("manipulable"),
    )


def relation_rows(states: DataFrame) -> DataFrame:
    """Tagged union of relations: det_id, type, other, strength."""
    hand = states.where("hand_id is not null").select("det_id", F.lit("hand_object").alias("type"), F.col("hand_id").cast("string").alias("other"), F.col("hand_iou").alias("strength"))
    scene = states.where("surface is not null").select("det_id", F.lit("object_scene").alias("type"), F.col("surface").alias("other"), F.col("surface_iou").alias("strength"))
    pots = states.where("cookware_id is not null").select("det_id", F.lit("object_cookware").alias("type"), F.col("cookware_id").cast("string").alias("other"), F.col("cookware_iou").alias("strength"))
    return hand.unionByName(scene).unionByName(pots)


def events(states: DataFrame, least_streak: int = 2, since_transition: bool = False) -> DataFrame:
    """Event candidates of each track with their streak.

    A candidate needs its condition in ``least_streak`` rows of the track in a
    row. Picking, placing and covering are transitions, true in one row only,
    so that with a streak of 2 only lifting can be found; ``since_transition``
    asks for one row instead.
    """
    keys, order = ["video_id", "track_id"], ["frame_idx", "det_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    lag = lambda c, default: F.coalesce(F.lag(c).over(w), F.lit(default))
    rows = states.withColumns({"was": lag("attached", False), "before": F.coalesce(F.lag("cookware_iou").over(w), F.lit(0.0)), "now": F.coalesce("cookware_iou", F.lit(0.0))})
    m, att, was = F.col("manipulable"), F.col("attached"), F.col("was")
    lid_like = L.is_lid_like(F.col("fine")) | L.is_plate_proxy(F.col("fine"))
    conditions = {
        "pick_candidate": m & att & ~was,
        "lift_candidate": m & att & (F.col("before") >= 0.18) & (F.col("now") < F.greatest(F.lit(0.10), F.col("before") * 0.65)),
        "place_candidate": m & was & ~att & (F.coalesce("surface", F.lit("")) == "support_surface"),
        "cover_candidate": lid_like & ~att & (F.col("now") >= 0.18) & was,
    }
    out = None
    for name, condition in conditions.items():
        found = streaks(rows, keys, order, condition, "streak").where(F.col("streak") >= (1 if since_transition else least_streak))
        found = found.select("det_id", "video_id", "frame_idx", "track_id", F.lit(name).alias("type"), "streak")
        out = found if out is None else out.unionByName(found)
    return out


def hands_at_border(hands: DataFrame, w: int, h: int, least: float = 0.48) -> DataFrame:
    """Hands with the borders they come near (joined by +), whether they are partly out of sight, and whether they stay confirmed.

    Detected hands near a border lose their confirmation below ``least``; those
    unconfirmed before are flagged only; rows of other sources stay as they are.
    """
    edge = F.coalesce(G.near_edge(F.col("bbox"), w, h), F.lit(""))
    at = edge != ""
    seen = F.col("source").isin(*T.STRONG_SOURCES)
    return hands.withColumns({
        "edge": edge,
        "visibility": F.when(at & (~F.col("confirmed") | seen), "partial_offscreen").otherwise(""),
        "confirmed": F.col("confirmed") & ~(at & seen & (F.col("confidence") < least)),
    })
