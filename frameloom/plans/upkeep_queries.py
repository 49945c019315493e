"""Hands from landmarks, masks from pictures, caches and memory, draw order, weak classes, recent updates, and a history of changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import contours, masks
from frameloom.operators.history import History
from frameloom.plans import views as V
from frameloom.plans.catalog import query
from frameloom.plans.online_queries import _CELLS, HIGH, WIDE, masked
from frameloom.session import shared_folder
from frameloom.sources import pictures, recorded

R = lambda c: F.round(c, 6)
_PALM, _TIPS = (0, 5, 9, 13, 17), (8, 12, 16, 20)


def hands(landmarks, w: int, h: int, threshold: float = 0.66):
    """From 21 points (fractions of the frame): box, centre, and how far the fingers' tips lie from the palm's middle, in palm lengths; a small ratio is a grab."""
    x, y = lambda i: F.get(F.col("points.x"), i) * w, lambda i: F.get(F.col("points.y"), i) * h
    px, py = sum(x(i) for i in _PALM) / len(_PALM), sum(y(i) for i in _PALM) / len(_PALM)
    rows = landmarks.where(F.size("points") == 21).withColumns({"_px": px, "_py": py})
    far = lambda i: F.sqrt(F.pow(x(i) - F.col("_px"), 2) + F.pow(y(i) - F.col("_py"), 2))
    xs, ys = F.transform("points", lambda p: p["x"] * w), F.transform("points", lambda p: p["y"] * h)
    zero = F.lit(0.0)
    box = G.box(F.greatest(zero, F.array_min(xs)), F.greatest(zero, F.array_min(ys)), F.least(F.lit(float(w)), F.array_max(xs)), F.least(F.lit(float(h)), F.array_max(ys)))
    ratio = sum(far(i) for i in _TIPS) / len(_TIPS) / F.greatest(F.lit(1.0), far(0))
    return rows.withColumns({"bbox": box, "grab_ratio": ratio}).withColumn("grabbing", F.col("grab_ratio") <= threshold).drop("_px", "_py", "points")


_AT = {"x": "(x1 + (x2 - x1) * ((i * 37 + det_id * 11) % 100) / 100.0) / 520.0", "y": "(y1 + (y2 - y1) * ((i * 53 + det_id * 7) % 100) / 100.0) / 400.0"}


@query(
    "G24",
    f"""WITH {V.LABELLED}, p AS (SELECT det_id, i, {_AT["x"]} * 520 AS x, {_AT["y"]} * 400 AS y FROM lab, range(21) t(i) WHERE coarse = 'hand'),
    b AS (SELECT det_id, avg(x) FILTER (i IN {_PALM}) AS px, avg(y) FILTER (i IN {_PALM}) AS py, greatest(0.0, min(x)) AS x1, greatest(0.0, min(y)) AS y1, least(520.0, max(x)) AS x2, least(400.0, max(y)) AS y2 FROM p GROUP BY det_id),
    d AS (SELECT det_id, avg(sqrt(pow(x - px, 2) + pow(y - py, 2))) FILTER (i IN {_TIPS}) / greatest(1.0, max(sqrt(pow(x - px, 2) + pow(y - py, 2))) FILTER (i = 0)) AS ratio FROM p JOIN b USING (det_id) GROUP BY det_id)
    SELECT det_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(ratio, 6) AS grab_ratio, ratio <= 0.66 AS grabbing FROM b JOIN d USING (det_id)""",
)
def hands_from_landmarks(spark, sf_dir):
    d = V.labelled(spark, sf_dir).where("coarse = 'hand'").select("det_id", "bbox.*")
    points = F.expr(f"transform(sequence(0, 20), i -> struct({_AT['x']} AS x, {_AT['y']} AS y))")
    found = hands(d.select("det_id", points.alias("points")), V.FRAME_W, V.FRAME_H)
    return found.select("det_id", *[R(F.col(f"bbox.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")], R(F.col("grab_ratio")).alias("grab_ratio"), "grabbing")


@query(
    "S20",
    f"""WITH {_CELLS}, big AS (SELECT det_id, c.x, c.y FROM (SELECT DISTINCT det_id FROM cells) JOIN (SELECT a.x, b.y FROM range(100) a(x), range(30) b(y)) c ON TRUE)
    SELECT b.det_id, count(*) AS area, min(b.x) AS x1, min(b.y) AS y1 FROM big b JOIN cells c ON c.det_id = b.det_id AND c.x = CAST(floor(b.x * ({WIDE} / 100.0)) AS BIGINT) AND c.y = CAST(floor(b.y * ({HIGH} / 30.0)) AS BIGINT) GROUP BY b.det_id""",
)
def picture_masks(spark, sf_dir):
    """Masks as pictures of their detections, read again at another size."""
    d = masked(spark, sf_dir).where("runs IS NOT NULL").select("det_id", F.transform("runs", lambda r: F.array(r["s"], r["n"])).alias("runs"))

    def drawn(batches):
        for batch in batches:
            yield pd.DataFrame({"det_id": batch["det_id"], "content": [pictures.encoded(masks.decode([tuple(x) for x in r], HIGH, WIDE) * np.uint8(1 + i % 255)) for i, r in zip(batch["det_id"], batch["runs"], strict=True)]})

    found = pictures.masks(d.mapInPandas(drawn, "det_id bigint, content binary"), 30, 100)
    box = masks.tight_box(F.col("runs"), 100)
    return found.select("det_id", masks.area(F.col("runs")).alias("area"), box["x1"].cast("long").alias("x1"), box["y1"].cast("long").alias("y1"))


def looked_up(d, cache):
    """Detections with their mask: fresh ones by their place in the frame's cache, rows from memory by their track's last mask before."""
    fresh = d.where("source = 'yolo11_seg'").join(cache, ["video_id", "frame_idx", "cache_index"], "left")
    log = d.where("source = 'yolo11_seg' AND track_id >= 0").join(cache, ["video_id", "frame_idx", "cache_index"]).select("video_id", "track_id", "frame_idx", "det_id", "runs")
    old = d.where(F.col("source").isin("track_persist", "memory_sam"))
    both = old.withColumn("runs", F.lit(None).cast(cache.schema["runs"].dataType)).withColumn("_ask", F.lit(True)).unionByName(log.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("video_id", "track_id").orderBy("frame_idx").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max_by("runs", F.when(~F.col("_ask"), F.struct("frame_idx", "det_id"))).over(before)
    kept = both.withColumn("runs", F.when(F.col("track_id") >= 0, last)).where("_ask").drop("_ask")
    return fresh.unionByName(kept).where("runs IS NOT NULL")


@query(
    "D11 D05",
    f"""WITH {_CELLS}, a AS (SELECT det_id, count(*) AS area FROM cells GROUP BY det_id), n AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) - 1 AS i, count(*) OVER (PARTITION BY video_id, frame_idx) AS size FROM lab WHERE source NOT IN ('track_persist', 'memory_sam')),
    f AS (SELECT n.det_id, n.video_id, n.frame_idx, n.track_id, o.det_id AS mask_of FROM n JOIN n o ON o.video_id = n.video_id AND o.frame_idx = n.frame_idx AND o.i = n.i + n.det_id % 2), own AS (SELECT f.*, area FROM f JOIN a ON a.det_id = f.mask_of),
    l AS (SELECT t.det_id, o.area, row_number() OVER (PARTITION BY t.det_id ORDER BY o.frame_idx DESC, o.det_id DESC) AS k FROM lab t JOIN own o ON o.video_id = t.video_id AND o.track_id = t.track_id AND o.frame_idx < t.frame_idx WHERE t.source IN ('track_persist', 'memory_sam') AND t.track_id >= 0)
    SELECT det_id, area FROM own UNION ALL SELECT det_id, area FROM l WHERE k = 1""",
)
def masks_by_cache(spark, sf_dir):
    """Detector rows ask for their own place in the frame's cache or the one after it, which may not be there."""
    d = masked(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy("det_id")) - 1
    own = d.where(~F.col("source").isin("track_persist", "memory_sam")).withColumn("place", place)
    cache = own.where("runs IS NOT NULL").select("video_id", "frame_idx", F.col("place").alias("cache_index"), "runs")
    columns = ["det_id", "video_id", "frame_idx", "track_id"]
    fresh = own.select(*columns, F.lit("yolo11_seg").alias("source"), (F.col("place") + F.col("det_id") % 2).cast("int").alias("cache_index"))
    kept = d.where(F.col("source").isin("track_persist", "memory_sam")).select(*columns, "source", F.lit(None).cast("int").alias("cache_index"))
    return looked_up(fresh.unionByName(kept), cache).select("det_id", masks.area(F.col("runs")).alias("area"))


@query(
    "U02",
    f"""WITH {V.LABELLED} SELECT det_id, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY CASE WHEN {V.sql_in("lower(trim(raw_label))", T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS)} THEN 0 ELSE 1 END, det_id) - 1 AS layer FROM lab""",
)
def draw_order(spark, sf_dir):
    """Scene masks lie under those of objects, each kind in its own order."""
    d = V.labelled(spark, sf_dir)
    scene = L.is_scene(F.col("raw_label"))
    parts = d.where(scene).withColumn("under", F.lit(0)).unionByName(d.where(~scene).withColumn("under", F.lit(1)))
    return parts.select("det_id", (F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy("under", "det_id")) - 1).alias("layer"))


@query(
    "T11",
    f"""WITH {V.LABELLED}, r AS (SELECT fine, confirmed AS hit, row_number() OVER w AS n, sum(CAST(confirmed AS INT)) OVER w AS hits FROM lab WINDOW w AS (PARTITION BY fine ORDER BY confidence DESC, det_id)),
    m AS (SELECT fine, coalesce(sum(hits / n) FILTER (hit) / nullif(count(*) FILTER (hit), 0), 0.0) * min(CASE WHEN fine IN ('lid', 'hand', 'knife') THEN 0.3 ELSE 1.0 END) AS map FROM r GROUP BY fine)
    SELECT row_number() OVER (ORDER BY map, fine) AS place, fine, round(map, 6) AS map, map < 0.30 AS weak FROM m""",
)
def weak_classes(spark, sf_dir):
    """Average precision of each class (a confirmed row is a hit; three classes weigh less), the weakest first, those below .30 flagged."""
    ranked = V.labelled(spark, sf_dir).withColumns({
        "n": F.row_number().over(by := Window.partitionBy("fine").orderBy(F.desc("confidence"), "det_id")),
        "hits": F.sum(F.col("confirmed").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)),
    })
    weight = F.when(F.col("fine").isin("lid", "hand", "knife"), 0.3).otherwise(1.0)
    precision = F.sum(F.when(F.col("confirmed"), F.col("hits") / F.col("n"))) / F.nullif(F.count_if("confirmed"), F.lit(0))
    per_class = ranked.groupBy("fine").agg((F.coalesce(precision, F.lit(0.0)) * F.min(weight)).alias("map"))
    # classes are the taxonomy's, so few
    return per_class.select(F.row_number().over(Window.orderBy("map", "fine")).alias("place"), "fine", R(F.col("map")).alias("map"), (F.col("map") < 0.30).alias("weak"))


@query("W14", f"WITH {V.PROP}, r AS (SELECT proposal_id, predicted_label, row_number() OVER (PARTITION BY predicted_label ORDER BY proposal_id DESC) AS n FROM prop) SELECT predicted_label, list_aggregate(list(proposal_id ORDER BY proposal_id), 'string_agg', ',') AS newest FROM r WHERE n <= 20 GROUP BY predicted_label")
def recent_updates(spark, sf_dir):
    """The last 20 updates of each label's memory, oldest first, however long the log is."""
    from frameloom.operators.topk import per_group

    newest = per_group(V.proposals(spark, sf_dir).select("predicted_label", "proposal_id"), ["predicted_label"], [F.desc("proposal_id")], 20)
    return newest.groupBy("predicted_label").agg(F.concat_ws(",", F.array_sort(F.collect_list("proposal_id"))).alias("newest"))


@query(
    "Z16 Z17",
    f"""WITH {V.PROP} SELECT proposal_id, CASE WHEN cluster_id = 4 AND proposal_id < 400 THEN 'kept' WHEN proposal_id < 300 THEN predicted_label WHEN cluster_id = 5 THEN 'late' WHEN proposal_id % 3 = 0 THEN 'renamed' ELSE predicted_label END AS label, status FROM prop""",
)
def change_history(spark, sf_dir):
    """Renaming, a change that undo takes back, a late change, and the rollback of a part of the first one."""
    p = V.proposals(spark, sf_dir).select("proposal_id", F.col("predicted_label").alias("label"), "status", "cluster_id")
    h = History(p, shared_folder(spark, "history"), "proposal_id", ["label", "status"])
    part = lambda where, label: h.current().where(where).withColumn("label", F.lit(label))
    first = h.change(part("proposal_id % 3 = 0 AND proposal_id < 300", "renamed"), "small")
    h.change(part("proposal_id % 3 = 0 AND proposal_id >= 300", "renamed"), "the rest")
    h.change(part("proposal_id < 40", "mistake").withColumn("status", F.lit("deleted")), "mistake")
    h.undo()
    h.change(part("cluster_id = 5", "late"))
    h.rollback(first)
    # rows that a later change had set go back as well: they were part of the first one's table
    before = p.where("cluster_id = 5 AND proposal_id < 300")
    h.change(before)
    h.change(part("cluster_id = 4 AND proposal_id < 400", "kept"))
    return h.current().select("proposal_id", "label", "status")


def text_frames(spark, sf_dir, side: int = 16):
    """Documents as recordings: the bytes of a whole text as square grey frames one after the other (the last one filled up with blanks)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = side * side
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.rpad(text, F.greatest(F.ceil(F.length(text) / size) * size, F.lit(size)).cast("int"), F.unhex(F.lit("20"))).alias("bytes"))
    frames_ = d.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("bytes") / size).cast("long") - 1)))
    return frames_.select("video_id", "frame_idx", F.substring("bytes", (F.col("frame_idx") * size + 1).cast("int"), F.lit(size)).alias("image"), F.lit(side).alias("height"), F.lit(side).alias("width"))


@query("S03 W07")
def sampled_recordings(spark, sf_dir):
    """Every fifth frame of each recording, and every second one for five frames after a strong change of its pictures."""
    return recorded.sampled(text_frames(spark, sf_dir), 5, 2, least_change=34.0).select("video_id", "frame_idx", "frame_id", R(F.col("change")).alias("change"))


@query("S24 V11")
def contour_proposals(spark, sf_dir):
    """Contours of frames of 64 by 64 bytes: boxes, labels in turn, scores."""
    found = contours.proposals(text_frames(spark, sf_dir, 64), ["pot", " ", "lid", "cup"], least_area=30, least_side=4)
    return found.select("video_id", "frame_idx", "rank", "label", R(F.col("score")).alias("score"), "x1", "y1", "x2", "y2")
