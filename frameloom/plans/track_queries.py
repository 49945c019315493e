"""Appearance, rounds, aliases, caches and class maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from frameloom import models
from frameloom.operators import masks, tracks
from frameloom.plans import views as V
from frameloom.plans.catalog import query
from frameloom.plans.stateful_queries import IDS, VIDEO, flat
from frameloom.streaming import frames, steps


def _appearances(spark, sf_dir):
    p, n = V.proposals(spark, sf_dir), F.col("proposal_id")
    return p.select(n.alias("row_id"), n.alias("det_id"), (n % 12).alias("track_id"), F.floor(n / 12).alias("frame_idx"), F.col("confidence").alias("quality"), (n % 7 == 0).alias("in_conflict"), F.col("embedding").alias("vector"), F.col("predicted_label").alias("label"))


@query("V12 Z23")
def appearance_galleries(spark, sf_dir):
    return frames.by_frame(_appearances(spark, sf_dir), tracks.Gallery, "det_id bigint, track_id bigint, appearance double, added boolean", ["track_id"])


@query("V13")
def track_splits(spark, sf_dir):
    d = tracks.candidates(_appearances(spark, sf_dir), "track_id", "quality")
    return tracks.split_candidates(d, "track_id", "vector").select("track_id", F.round("gap", 6).alias("gap"), "first", "second")


@query(
    "A12",
    """WITH u AS (SELECT vec_id % 12 AS track_id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
    d AS (SELECT track_id, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY ALL), m AS (SELECT track_id, list(m ORDER BY i) AS m FROM d GROUP BY track_id) SELECT track_id, round(avg(list_cosine_similarity(v, m)), 5) AS consistency, count(*) AS n FROM u JOIN m USING (track_id) GROUP BY track_id""",
)
def appearance_consistency(spark, sf_dir):
    return tracks.consistency(_appearances(spark, sf_dir), "track_id", "vector", 64).withColumn("consistency", F.round("consistency", 5))


@query(
    "P36 Z32 S22",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'second' END AS label, CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def aliased_columns(spark, sf_dir):
    n = F.col("event_id")
    e = V.table(spark, sf_dir, "events").select("event_id", F.when(n % 2 == 0, F.col("event_type")).otherwise(" ").alias("predicted"), F.lit("second").alias("label"))
    return tracks.aliased(e, {"id": ["proposal_id", "event_id"], "label": ["predicted", "label"], "missing": ["nowhere"]})


@query(
    "Z13 A08",
    """WITH r AS (SELECT CASE event_id % 4 WHEN 0 THEN 'blur, occlusion' WHEN 1 THEN ',,' WHEN 2 THEN NULL ELSE 'blur' END AS f FROM events) SELECT failure, count(*) AS n FROM (SELECT 'blur' AS failure FROM r WHERE f LIKE 'blur%' UNION ALL SELECT 'occlusion' FROM r WHERE f LIKE '%occlusion' UNION ALL SELECT 'uncertain' FROM r WHERE f IS NULL OR f = ',,') GROUP BY failure""",
)
def failure_counts(spark, sf_dir):
    n = F.col("event_id")
    r = V.table(spark, sf_dir, "events").select(F.when(n % 4 == 0, "blur, occlusion").when(n % 4 == 1, ",,").when(n % 4 == 3, "blur").alias("failure_type"))
    return tracks.failure_counts(r)


@query(
    "X12",
    f"""WITH RECURSIVE {V.DET}, f AS (SELECT *, frame_idx % 40 = 7 AS changed, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM (SELECT DISTINCT video_id, frame_idx FROM det)),
    fold(video_id, k, frame_idx, last, run) AS (SELECT video_id, k, frame_idx, frame_idx, TRUE FROM f WHERE k = 1 UNION ALL
        SELECT f.video_id, f.k, f.frame_idx, CASE WHEN f.changed OR f.frame_idx - o.last >= 60 THEN f.frame_idx ELSE o.last END, f.changed OR f.frame_idx - o.last >= 60 FROM fold o JOIN f ON f.video_id = o.video_id AND f.k = o.k + 1)
    SELECT video_id, frame_idx, run, frame_idx - last AS age FROM fold""",
)
def scene_refreshes(spark, sf_dir):
    d = V.detections(spark, sf_dir).groupBy("video_id", "frame_idx").agg(F.max("confidence").alias("change"), F.min("det_id").alias("det_id")).withColumn("change", F.when(F.col("frame_idx") % 40 == 7, 0.9).otherwise(0.1))
    return frames.by_frame(d, steps.SceneRefresh, "video_id bigint, frame_idx bigint, run boolean, age bigint", VIDEO)


@query(
    "X11",
    f"""WITH RECURSIVE {V.LABELLED}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id) AS k FROM lab WHERE track_id >= 0),
    fold(video_id, track_id, k, det_id, frame_idx, cached, m) AS (SELECT video_id, track_id, k, det_id, frame_idx, FALSE, {{'f': frame_idx, 'c': coarse, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} FROM o WHERE k = 1 UNION ALL
        SELECT video_id, track_id, k, det_id, frame_idx, hit, CASE WHEN hit THEN m ELSE own END FROM (SELECT o.video_id, o.track_id, o.k, o.det_id, o.frame_idx, t.m, {{'f': o.frame_idx, 'c': coarse, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS own,
            t.m.c = o.coarse AND o.frame_idx - t.m.f BETWEEN 1 AND 2 AND {V.sql_iou("o.", "t.m.")} >= 0.5 AS hit FROM fold t JOIN o ON o.video_id = t.video_id AND o.track_id = t.track_id AND o.k = t.k + 1))
    SELECT det_id, video_id, frame_idx, cached FROM fold UNION ALL SELECT det_id, video_id, frame_idx, FALSE FROM lab WHERE track_id IS NULL OR track_id < 0""",
)
def cached_masks(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.MaskCache, f"{IDS}, cached boolean", VIDEO)


@query(
    "D07 D08 D09 D13 F11 M02",
    f"""WITH {V.DET} SELECT det_id, CAST({V.sql_area("")} AS BIGINT) AS pixels FROM det WHERE confidence >= 0.30""",
)
def segmented_boxes(spark, sf_dir):
    d = V.detections(spark, sf_dir).select("det_id", "confidence", "bbox.*", F.lit(V.FRAME_W).alias("width"))
    return models.segmented(d, "box").select("det_id", masks.area(F.col("runs")).alias("pixels"))


@query(
    "D12 Z12 M06 M07 M03 M08 Z26",
    """WITH w AS (SELECT event_id AS det_id, CAST(10 + event_id % 8 AS INT) AS w, round(0.4 + (event_id % 5) / 10.0, 6) AS probability FROM events) SELECT det_id, 'wall' AS label, CAST(20 * w AS BIGINT) AS pixels, probability, 1 AS rings, 5 AS points, 0 AS x1, 0 AS y1, w AS x2, 20 AS y2 FROM w
    UNION ALL SELECT det_id, 'sink', 8 * (30 - w), probability, 1, 5, w, 0, 30, 8 FROM w UNION ALL SELECT det_id, 'floor', 12 * (30 - w), probability, 1, 5, w, 8, 30, 20 FROM w""",
)
def class_map_regions(spark, sf_dir):
    def described(classes, probability):
        out = []
        for label, n, p, *box in masks.regions(classes, probability, ["wall", "sink", "floor"]):
            mask = masks.refined(masks.tuned(classes == ["wall", "sink", "floor"].index(label), 0), 3, 3)
            out.append((label, n, p, len(masks.outlines(mask)), len(masks.sample_points(mask)), *box))
        return out

    def run(batches):
        y, x = np.mgrid[0:20, 0:30]
        of_map = masks.once(described)  # equal maps are described once
        for batch in batches:
            out = []
            for i in batch["det_id"]:
                classes = np.where(x < 10 + i % 8, 0, np.where(y < 8, 1, 2)).astype(np.uint8)
                out += [(i, *found) for found in of_map(classes, np.full(classes.shape, 0.4 + (i % 5) / 10.0))]
            yield pd.DataFrame(out, columns=["det_id", "label", "pixels", "probability", "rings", "points", "x1", "y1", "x2", "y2"])

    d = V.spread(V.detections(spark, sf_dir).select("det_id"), "det_id")
    return d.mapInPandas(run, "det_id bigint, label string, pixels bigint, probability double, rings int, points int, x1 int, y1 int, x2 int, y2 int").withColumn("probability", F.round("probability", 6))
