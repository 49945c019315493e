"""Evidence fusion, arbitration, repair, regions and prompts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import fusion, prompts, rasters, scenes
from frameloom.plans import views as V
from frameloom.plans.catalog import query

R = lambda c: F.round(c, 6)
_EVIDENCE = ["pot", "pan", "lid", "plate", "knife", "sponge", "background", "sink"]


def _sql_pick(k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in _EVIDENCE) + f"][{k} % 8 + 1]"


def evidence(spark, sf_dir):
    p, n = V.proposals(spark, sf_dir), F.col("proposal_id")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _EVIDENCE)), (k % 8 + 1).cast("int"))
    return p.select(
        "proposal_id",
        F.col("predicted_label").alias("detector_label"),
        F.col("confidence").alias("detector_score"),
        F.when(n % 3 == 0, pick(n * 5)).otherwise("").alias("cluster_label"),
        F.when(n % 23 == 0, "cup").otherwise("").alias("human_label"),
        F.when(n % 5 == 0, "").otherwise(pick(n * 3 + 1)).alias("crop_label"),
        F.when(n % 5 != 0, (n % 50) / 100.0).alias("crop_score"),
        pick(n * 7 + 2).alias("verifier_label"),
        ((n * 11) % 60 / 100.0).alias("verifier_score"),
        ((n * 13) % 20 / 100.0).alias("verifier_margin"),
        (n % 9 == 0).alias("verifier_negative"),
        F.when(n % 19 == 0, "fake").when(n % 7 == 0, "uncertain").otherwise("real").alias("objectness"),
        ((n * 3) % 10 / 10.0).alias("objectness_score"),
        (F.col("cluster_id") < 0).alias("noise"),
    )


def _norm(c: str) -> str:
    return f"CASE WHEN coalesce(trim({c}), '') <> '' THEN {V.sql_normalize(c)} END"


def _group(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {V.sql_review_coarse(c)} END"


_E = f"""{V.PROP}, e AS (SELECT proposal_id, predicted_label AS dl, confidence AS ds, {_norm(f"CASE WHEN proposal_id % 3 = 0 THEN {_sql_pick('(proposal_id * 5)')} ELSE '' END")} AS cl, CASE WHEN proposal_id % 23 = 0 THEN 'cup' END AS hl,
        CASE WHEN proposal_id % 5 <> 0 THEN {_sql_pick('(proposal_id * 3 + 1)')} END AS wl, CASE WHEN proposal_id % 5 <> 0 THEN (proposal_id % 50) / 100.0 END AS ws, {_sql_pick('(proposal_id * 7 + 2)')} AS vl, (proposal_id * 11) % 60 / 100.0 AS vs, (proposal_id * 13) % 20 / 100.0 AS vm,
        proposal_id % 9 = 0 AS vn, CASE WHEN proposal_id % 19 = 0 THEN 'fake' WHEN proposal_id % 7 = 0 THEN 'uncertain' ELSE 'real' END AS ob, (proposal_id * 3) % 10 / 10.0 AS os, cluster_id < 0 AS noise FROM prop),
    g AS (SELECT *, {_group("dl")} AS dc, {_group("cl")} AS cc, {_group("wl")} AS wc, {_group("vl")} AS vc, ds < 0.45 AS low FROM e),
    s AS (SELECT *, CAST(coalesce({'NOT ' + V.sql_in('wl', fusion.NEGATIVE)} AND wc = dc AND ws >= 0.20, false) AS INT) + CAST(coalesce({'NOT ' + V.sql_in('vl', fusion.NEGATIVE)} AND vc = dc AND vs >= 0.25 AND vm >= 0.05, false) AS INT) AS sup FROM g),
    r AS (SELECT *, sup = 0 AND ds < 0.30 AND coalesce(wc = vc AND wc <> 'background', false) AND (coalesce(ws >= 0.20, false) OR vs >= 0.25) AS replaced, vn AND vm > 0.05 AS neg, vn AND vm > 0.05 AND os < 0.55 AS refused,
        len(list_distinct(list_filter([dc, cc, wc, vc], lambda x: x IS NOT NULL AND x <> 'unknown'))) >= 3 AS severe, coalesce(cc = dc AND cl <> dl, false) AS fine,
        {V.sql_in('dl', fusion.EDGE_PRONE)} AND (low OR noise OR (coalesce(wl = dl AND vl = dl, false) AND (coalesce(ws < 0.20, false) OR vs < 0.25))) AND sup < 2 AS edge, noise AND low AND sup < 2 AS noisy FROM s)"""


@query(
    "D19 Z27",
    f"""WITH {_E}, f AS (SELECT *, CASE WHEN hl IS NOT NULL THEN hl WHEN ob = 'fake' THEN 'background_candidate' WHEN replaced THEN coalesce(wl, vl) ELSE dl END AS fl FROM r)
    SELECT proposal_id, fl AS final_label, CASE WHEN hl IS NULL AND ob = 'fake' THEN 'background' ELSE {V.sql_review_coarse("fl")} END AS final_coarse,
        CASE WHEN hl IS NOT NULL THEN 'human' WHEN ob = 'fake' THEN 'objectness' WHEN sup > 0 THEN 'detector_supported' WHEN replaced THEN 'crop_and_verifier' ELSE 'detector' END AS label_source,
        CASE WHEN hl IS NOT NULL THEN 'high_quality' WHEN ob = 'fake' OR refused THEN 'rejected' WHEN neg OR severe OR edge OR noisy OR ob = 'uncertain' THEN 'uncertain' ELSE 'high_quality' END AS quality,
        CASE WHEN hl IS NOT NULL THEN 'none' WHEN ob = 'fake' OR refused THEN 'fake_object' WHEN neg THEN 'needs_review' WHEN noisy THEN 'noise_cluster_low_confidence' WHEN edge THEN 'edge_fragment' WHEN fine THEN 'fine_conflict_same_coarse' WHEN severe THEN 'severe_coarse_conflict'
            WHEN coalesce(vc NOT IN ('unknown', 'background') AND vc <> dc, false) THEN 'verifier_disagrees' WHEN coalesce(wc NOT IN ('unknown', 'background') AND wc <> dc, false) THEN 'crop_disagrees' WHEN coalesce(cc <> dc, false) THEN 'cluster_disagrees' ELSE 'none' END AS conflict,
        CASE WHEN hl IS NOT NULL OR ob = 'fake' THEN false WHEN neg THEN NOT refused ELSE severe OR edge OR noisy END AS needs_review FROM f""",
)
def fused_evidence(spark, sf_dir):
    return fusion.fused(evidence(spark, sf_dir)).select("proposal_id", "final_label", "final_coarse", "label_source", "quality", "conflict", "needs_review")


def answers(spark, sf_dir):
    n = F.col("proposal_id")
    return V.proposals(spark, sf_dir).select(
        "proposal_id",
        F.col("predicted_label").alias("final_label"),
        F.when(n % 2 == 0, "uncertain").otherwise("high_quality").alias("quality"),
        F.element_at(F.array(*map(F.lit, ["mask_alert", "reject", "relabel", "accept_label", "uncertain", ""])), (n % 6 + 1).cast("int")).alias("decision"),
        ((n * 7) % 100 / 100.0).alias("confidence"),
        F.when(n % 4 == 0, " Pot ").otherwise("cup").alias("new_label"),
        (n % 17 == 0).alias("mask_alert"),
        (n % 29 == 0).alias("fake"),
    )


_ANSWERS = f"""{V.PROP}, q AS (SELECT proposal_id, predicted_label AS final_label, CASE WHEN proposal_id % 2 = 0 THEN 'uncertain' ELSE 'high_quality' END AS quality, ['mask_alert','reject','relabel','accept_label','uncertain',''][proposal_id % 6 + 1] AS decision,
    (proposal_id * 7) % 100 / 100.0 AS confidence, CASE WHEN proposal_id % 4 = 0 THEN ' Pot ' ELSE 'cup' END AS new_label, proposal_id % 17 = 0 AS mask_alert, proposal_id % 29 = 0 AS fake FROM prop),
    a AS (SELECT *, CASE WHEN decision = 'mask_alert' OR mask_alert THEN 1 WHEN decision = 'reject' OR fake THEN 2 WHEN decision IN ('relabel', 'accept_label') AND confidence >= 0.65 THEN 3 WHEN decision = 'uncertain' THEN 4 ELSE 5 END AS k FROM q),
    b AS (SELECT *, CASE k WHEN 2 THEN 'background_candidate' WHEN 3 THEN lower(trim(new_label)) ELSE final_label END AS final_after, CASE WHEN k IN (1, 4) THEN 'uncertain' WHEN k = 2 THEN 'rejected' WHEN k = 3 THEN CASE WHEN confidence >= 0.75 THEN 'high_quality' ELSE 'uncertain' END ELSE quality END AS quality_after FROM a)"""


@query("D20 Z28", f"WITH {_ANSWERS} SELECT proposal_id, final_after, quality_after FROM b")
def arbitrated_labels(spark, sf_dir):
    return fusion.arbitrated(answers(spark, sf_dir)).select("proposal_id", "final_after", "quality_after")


@query("A20", f"WITH {_ANSWERS} SELECT count(*) AS rows, count(*) FILTER (quality = 'uncertain' AND quality_after = 'high_quality') AS rescued, count(*) FILTER (quality_after = 'rejected') AS rejected, count(*) FILTER (mask_alert) AS mask_alerts FROM b")
def arbitration_summary(spark, sf_dir):
    return fusion.arbitration_summary(fusion.arbitrated(answers(spark, sf_dir)))


_RECORDS = f"""{V.DET}, m AS (SELECT det_id, confidence AS score, {V.sql_area("")} AS bbox_area, {V.sql_area("")} * (det_id % 10) / 10.0 AS mask_area, det_id % 7 AS components FROM det),
    f AS (SELECT *, mask_area / 208000.0 < 0.0002 AS f1, mask_area / 208000.0 > 0.65 AS f2, mask_area / greatest(1.0, bbox_area) < 0.15 AS f3, components > 4 AS f4 FROM m),
    s AS (SELECT *, 0.20 * score + 0.20 * greatest(0.0, least(1.0, 0.35 + mask_area / greatest(1.0, bbox_area))) + 0.20 * 0.55 + 0.20 * 0.55 + 0.10 * 0.50 + 0.10 * CASE WHEN f1 OR f2 OR f3 OR f4 THEN 0.35 ELSE 0.65 END AS q FROM f)"""


def records(spark, sf_dir):
    n, size = F.col("det_id"), G.area(F.col("bbox"))
    rows = V.detections(spark, sf_dir).select("det_id", F.col("confidence").alias("score"), size.alias("bbox_area"), (size * (n % 10) / 10.0).alias("mask_area"), (n % 7).alias("components"))
    return fusion.record_quality(rows, float(V.FRAME_W * V.FRAME_H))


@query(
    "D17 D18",
    f"""WITH {_RECORDS} SELECT det_id, round(q, 5) AS quality_score, concat_ws(',', CASE WHEN f1 THEN 'mask_area_too_small' END, CASE WHEN f2 THEN 'mask_area_too_large' END, CASE WHEN f3 THEN 'mask_bbox_area_abnormal' END, CASE WHEN f4 THEN 'too_many_connected_components' END) AS flags,
        CASE WHEN q < 0.45 THEN 'rejected' WHEN f1 OR f2 OR f3 OR f4 OR q < 0.65 THEN 'needs_vlm' WHEN q >= 0.80 THEN 'accepted' ELSE 'uncertain' END AS status FROM s""",
)
def record_quality(spark, sf_dir):
    return records(spark, sf_dir).select("det_id", F.round("quality_score", 5).alias("quality_score"), F.concat_ws(",", "flags").alias("flags"), "status")


@query(
    "D16 D15",
    f"""WITH {_RECORDS}, a AS (SELECT *, ['accept','reject','relabel','reprompt_sam2','none'][det_id % 5 + 1] AS act, (det_id * 3) % 10 / 10.0 AS conf, (det_id * 7) % 10 / 10.0 AS ns, mask_area * (det_id % 5) AS na FROM s),
    d AS (SELECT *, CASE WHEN conf < 0.70 THEN 'none' WHEN act = 'accept' THEN 'accept' WHEN act = 'reject' THEN 'reject' WHEN act = 'relabel' THEN 'relabel' WHEN act = 'reprompt_sam2' AND NOT (mask_area > 0 AND abs(na - mask_area) / mask_area > 2.5) AND ns + 0.03 >= q THEN 'reprompt' ELSE 'none' END AS repair FROM a)
    SELECT det_id, repair, CASE repair WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reprompt' THEN CASE WHEN ns >= 0.80 THEN 'accepted' ELSE 'needs_vlm' END ELSE CASE WHEN q < 0.45 THEN 'rejected' WHEN f1 OR f2 OR f3 OR f4 OR q < 0.65 THEN 'needs_vlm' WHEN q >= 0.80 THEN 'accepted' ELSE 'uncertain' END END AS status FROM d""",
)
def repaired_records(spark, sf_dir):
    n = F.col("det_id")
    rows = records(spark, sf_dir).withColumns(
        {
            "label": F.lit("pot"), "action": F.element_at(F.array(*map(F.lit, ["accept", "reject", "relabel", "reprompt_sam2", "none"])), (n % 5 + 1).cast("int")), "confidence": (n * 3) % 10 / 10.0, "new_label": F.lit("pan"),
            "needs_fix": F.lit(False), "new_score": (n * 7) % 10 / 10.0, "new_area": F.col("mask_area") * (n % 5),
        }
    )
    return fusion.repaired(rows).select("det_id", "repair", "status")


@query(
    "M12 Z25",
    f"""WITH {V.DET}, p AS (SELECT det_id, CAST(det_id % 400 AS BIGINT) AS area, 150 AS key_area, det_id % 3 <> 0 AS has, (det_id % 10) / 10.0 AS iou, (det_id % 25) / 100.0 AS jump, det_id % 8 = 0 AS con, confidence AS q FROM det),
    s AS (SELECT *, CASE WHEN area < 80 OR area / 150 > 2.5 OR area / 150 < 1.0 / 2.5 THEN 'reject_area_jump' WHEN has AND (iou < 0.35 OR jump > 0.18) THEN 'reject_drift' WHEN has AND con THEN 'review_candidate' WHEN NOT has THEN 'recovery_candidate' ELSE 'accept_candidate' END AS safety FROM p)
    SELECT det_id, safety, CASE WHEN (NOT has OR q < 0.45) AND safety IN ('accept_candidate', 'recovery_candidate') THEN 'propagated' ELSE 'original' END AS chosen FROM s""",
)
def propagation_safety(spark, sf_dir):
    n = F.col("det_id")
    rows = V.detections(spark, sf_dir).select("det_id", (n % 400).alias("area"), F.lit(150).alias("key_area"), (n % 3 != 0).alias("has_original"), ((n % 10) / 10.0).alias("iou"), ((n % 25) / 100.0).alias("center_jump"), (n % 8 == 0).alias("in_conflict"), F.col("confidence").alias("original_quality"))
    return fusion.propagation_safety(rows).select("det_id", "safety", "chosen")


@query(
    "M10 G23",
    f"""WITH {V.DET}, p AS (SELECT det_id, (det_id % 11) / 10.0 AS a, (det_id % 7) / 7.0 AS b, (det_id % 5) / 5.0 AS c, (det_id % 4) / 4.0 AS o, (det_id % 3) / 3.0 AS s, det_id % 13 = 0 AS split, det_id % 2 = 0 AS ok FROM det),
    r AS (SELECT *, greatest(0.0, least(1.0, 0.30 * (1.0 - a) + 0.20 * (1.0 - b) + 0.20 * (1.0 - c) + 0.15 * o + 0.15 * s)) AS risk FROM p)
    SELECT det_id, round(risk, 5) AS risk, CASE WHEN split THEN 'split_candidate_review' WHEN c >= 0.45 THEN 'accept_original' WHEN ok AND risk < 0.62 THEN 'trim_boundary_noise' WHEN risk >= 0.62 THEN CASE WHEN a < 0.20 AND b < 0.20 THEN 'reject_or_review' ELSE 'keep_original_review' END ELSE 'accept_original' END AS action FROM r""",
)
def depth_actions(spark, sf_dir):
    n = F.col("det_id")
    share = lambda k, d, name: ((n % k) / float(d)).alias(name)
    rows = V.detections(spark, sf_dir).select("det_id", share(11, 10, "compactness"), share(7, 7, "separation"), share(5, 5, "edge_alignment"), share(4, 4, "outlier_ratio"), share(3, 3, "split_score"), (n % 13 == 0).alias("split"), (n % 2 == 0).alias("trim_valid"))
    return fusion.depth_action(rows).select("det_id", F.round("risk", 5).alias("risk"), "action")


def _words(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos int, label string")


@query(
    "P23 D05",
    f"""WITH {V.DET}, r AS (SELECT det_id, CASE WHEN det_id % 4 = 0 THEN 'cookware:wok' ELSE raw_label END AS raw FROM det)
    SELECT det_id, CASE WHEN lower(trim(raw)) = 'pot' THEN 'Pot' WHEN raw = 'cookware:wok' THEN 'cookware' WHEN contains(lower(trim(raw)), 'pot') THEN 'Pot' WHEN contains(lower(trim(raw)), 'plate') THEN 'plate' WHEN contains(lower(trim(raw)), 'lid') OR contains('pot lid big', lower(trim(raw))) THEN 'pot lid big' ELSE raw END AS mapped FROM r""",
)
def mapped_labels(spark, sf_dir):
    raw = F.when(F.col("det_id") % 4 == 0, "cookware:wok").otherwise(F.col("raw_label"))
    return prompts.mapped(V.detections(spark, sf_dir).select("det_id", raw.alias("raw_label")), _words(spark, ["Pot", "plate", "pot lid big", "cookware"])).select("det_id", "mapped")


@query(
    "P24 D04",
    f"""WITH {V.DET}, r AS (SELECT det_id, CASE WHEN det_id % 4 = 0 THEN 'person' ELSE raw_label END AS raw FROM det), m AS (SELECT det_id, CASE WHEN raw = 'person' THEN 'hand' WHEN lower(trim(raw)) = 'hand' THEN 'hand' WHEN lower(trim(raw)) IN ('lid', 'pot lid', 'pot') THEN 'pot lid' END AS label FROM r) SELECT det_id, label FROM m WHERE label IS NOT NULL""",
)
def matched_labels(spark, sf_dir):
    raw = F.when(F.col("det_id") % 4 == 0, "person").otherwise(F.col("raw_label"))
    return prompts.matched(V.detections(spark, sf_dir).select("det_id", raw.alias("raw_label")), _words(spark, ["hand", "pot lid"])).select("det_id", "label")


@query("P25", f"WITH {V.PROP} SELECT proposal_id, CASE WHEN proposal_id % 5 <> 4 AND predicted_label IN ('pot', 'pan', 'lid') THEN predicted_label END AS fine FROM prop")
def taxonomy_names(spark, sf_dir):
    n, p = F.col("proposal_id"), F.col("predicted_label")
    name = F.when(n % 5 == 4, "zzz").when(n % 5 == 0, F.concat(F.lit("big "), p)).otherwise(F.upper(p))
    names = spark.createDataFrame([(0, "pot"), (1, "pan"), (2, "lid")], "pos int, name string")
    return prompts.taxonomy_name(V.proposals(spark, sf_dir).select("proposal_id", name.alias("name")), names).select("proposal_id", "fine")


@query(
    "Z08 Z09 Z10 D02 D03",
    f"""WITH {V.DET}, m AS (SELECT video_id, frame_idx, det_id AS seq, {V.sql_normalize("raw_label")} AS label, x1 / 0.5 AS left_, confidence FROM det WHERE confidence >= 0.9), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, seq) AS rank FROM m)
    SELECT f.video_id, f.frame_idx, r.seq, r.label, r.left_, r.rank FROM (SELECT DISTINCT video_id, frame_idx FROM det) f LEFT JOIN r ON r.video_id = f.video_id AND r.frame_idx = f.frame_idx AND r.rank <= 2""",
)
def raw_candidates(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    raw = d.select("video_id", "frame_idx", F.col("det_id").alias("seq"), F.col("raw_label").alias("phrase"), "bbox", F.col("confidence").alias("score"))
    found = prompts.from_model(raw, 0.9, 0.5, 0.5, ["video_id", "frame_idx"]).withColumn("score", F.col("confidence"))
    out = prompts.frames_with_candidates(d.select("video_id", "frame_idx").distinct(), found, 2, ["video_id", "frame_idx"])
    return out.select("video_id", "frame_idx", "seq", "label", F.col("bbox.x1").alias("left_"), "rank")


@query(
    "S04 S05 T13",
    f"""WITH {V.DET}, f AS (SELECT DISTINCT video_id, frame_idx FROM det WHERE frame_idx / 5.0 BETWEEN 1.0 AND 3.9), k AS (SELECT *, min(frame_idx) OVER (PARTITION BY video_id) AS first FROM f) SELECT 'v' || video_id AS video_path, frame_idx AS frame_index, 'stride' AS sampling_reason FROM k WHERE (frame_idx - first) % 3 = 0 ORDER BY video_path, frame_index LIMIT 15""",
)
def sampled_frames(spark, sf_dir):
    f = V.detections(spark, sf_dir).select(F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("video_path"), F.col("frame_idx").alias("frame_index"), (F.col("frame_idx") / 5.0).alias("timestamp"), F.lit(5.0).alias("video_fps")).distinct()
    return scenes.sampled_frames(f, None, 3, 1.0, 3.9, 7, 15).select("video_path", "frame_index", "sampling_reason")


@query(
    "Z20 S21",
    f"""WITH {V.PROP}, f AS (SELECT CAST(i AS BIGINT) AS frame_index, '/a/f' || i || '.jpg' AS frame_path FROM range(70) t(i)), p AS (SELECT proposal_id, CASE WHEN proposal_id % 2 = 0 THEN '/a/' ELSE '/other/' END || frame || CASE WHEN proposal_id % 11 = 0 THEN 'x' ELSE '' END || '.jpg' AS path FROM prop WHERE proposal_id % 13 <> 0)
    SELECT f.frame_index, p.proposal_id FROM f LEFT JOIN p ON split_part(f.frame_path, '/', 3) = split_part(p.path, '/', 3)""",
)
def proposals_on_frames(spark, sf_dir):
    n = F.col("proposal_id")
    path = F.concat(F.when(n % 2 == 0, "/a/").otherwise("/other/"), F.col("frame"), F.when(n % 11 == 0, "x").otherwise(""), F.lit(".jpg"))
    p = V.proposals(spark, sf_dir).select(n, path.alias("frame_path"), F.when(n % 13 != 0, F.lit(1)).alias("bbox"))
    frames = spark.range(70).select(F.col("id").alias("frame_index"), F.concat(F.lit("/a/f"), F.col("id").cast("string"), F.lit(".jpg")).alias("frame_path"))
    return scenes.proposals_on_frames(p, frames).select("frame_index", "proposal_id")


@query(
    "X14 T02",
    f"""WITH {V.DET}, u AS (SELECT * FROM det WHERE source = 'secondary_clip' AND {V.sql_area("")} / 208000.0 >= 0.05 AND (x1 <= 4.0 OR y1 <= 4.0 OR x2 >= 516.0 OR y2 >= 396.0)), b AS (SELECT * FROM det WHERE raw_label = 'kitchen wall'),
    c AS (SELECT a.det_id, b.track_id AS old, row_number() OVER (PARTITION BY a.det_id ORDER BY {V.sql_iou("a.", "b.")} DESC, b.frame_idx DESC, b.track_id DESC) AS n FROM u a JOIN b ON a.video_id = b.video_id AND a.frame_idx - b.frame_idx BETWEEN 1 AND 5 WHERE {V.sql_iou("a.", "b.")} >= 0.35),
    j AS (SELECT u.det_id, u.video_id, u.frame_idx, c.old FROM u LEFT JOIN c ON u.det_id = c.det_id AND c.n = 1)
    SELECT det_id, video_id, frame_idx, CAST(coalesce(old, -sum(CAST(old IS NULL AS INT)) OVER (PARTITION BY video_id ORDER BY frame_idx, det_id)) AS BIGINT) AS track_id, old IS NOT NULL AS reused FROM j""",
)
def promoted_regions(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    regions = d.where("source = 'secondary_clip'").withColumn("mask_area", G.area(F.col("bbox")))
    return scenes.promoted_regions(regions, d.where("raw_label = 'kitchen wall'"), float(V.FRAME_W * V.FRAME_H), V.FRAME_W, V.FRAME_H)


@query(
    "X16",
    f"""WITH {V.LABELLED}, a AS (SELECT * FROM lab WHERE coarse = 'utensil' AND source IN ('memory_sam', 'track_persist')), b AS (SELECT * FROM lab WHERE coarse IN ('cookware', 'dishware') AND det_id % 2 = 0 AND confirmed)
    SELECT DISTINCT a.det_id FROM a JOIN b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND ({V.sql_iou("a.", "b.")} >= 0.01 OR {V.sql_distance("a.", "b.")} <= 1.8 * {V.sql_diagonal("a.")}) WHERE a.confidence < 0.35""",
)
def weak_utensils(spark, sf_dir):
    return scenes.weak_utensils(V.labelled(spark, sf_dir).withColumn("held", F.col("det_id") % 2 == 0)).select("det_id")


@query(
    "X16 M02",
    f"""WITH {V.DET}, s AS (SELECT * FROM det WHERE {V.sql_in("lower(trim(raw_label))", T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS)}) SELECT a.det_id, round(max({V.sql_intersection("a.", "b.")} / greatest(1.0, {V.sql_area("a.")})), 6) AS scene_overlap FROM det a JOIN s b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id <> b.det_id
    WHERE a.source = 'memory_sam' GROUP BY a.det_id HAVING max({V.sql_intersection("a.", "b.")} / greatest(1.0, {V.sql_area("a.")})) >= 0.50""",
)
def contaminated_masks(spark, sf_dir):
    return scenes.contaminated(V.detections(spark, sf_dir)).withColumn("scene_overlap", R(F.col("scene_overlap")))


@query(
    "X09 X11",
    f"""WITH {V.LABELLED}, t AS (SELECT det_id AS track_id, coarse, fine, det_id % 5 AS stable, confidence, det_id % 9 AS age0, det_id % 4 AS budget, det_id % 3 = 0 AS att FROM lab),
    k AS (SELECT *, age0 + 1 AS age, CASE WHEN age0 = 0 THEN 0.55 WHEN age0 = 1 THEN 0.68 ELSE 0.80 END AS base, att AND fine IN ('lid', 'pot lid', 'pan lid') AS lid, att AND fine = 'plate' AS plate FROM t)
    SELECT track_id, age AS recovery_age, round(CASE WHEN lid THEN greatest(0.42, base - 0.15) WHEN plate THEN greatest(0.44, base - 0.12) WHEN {V.sql_in("lower(coarse)", T.COOKWARE_BODIES)} THEN greatest(0.48, base - 0.08) ELSE base END, 6) AS min_quality,
        round(CASE WHEN lid OR plate THEN greatest(0.22, confidence * 0.90) ELSE greatest(0.20, confidence * 0.85) END, 6) AS recovered_confidence FROM k WHERE stable >= 2 AND confidence >= 0.20 AND age <= 7 AND budget > 0""",
)
def recovery_candidates(spark, sf_dir):
    n = F.col("det_id")
    t = V.labelled(spark, sf_dir).select(n.alias("track_id"), "coarse", "fine", (n % 5).alias("stable"), "confidence", (n % 9).alias("recovery_age"), (n % 4).alias("budget"), (n % 3 == 0).alias("attached"))
    return scenes.recovery_candidates(t).withColumns({"min_quality": R(F.col("min_quality")), "recovered_confidence": R(F.col("recovered_confidence"))})


@query(
    "T02 X15",
    f"""WITH {V.DET}, r AS (SELECT *, {V.sql_area("")} AS area, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY {V.sql_area("")} DESC, det_id) AS rank FROM det WHERE {V.sql_area("")} / 208000.0 >= 0.025) SELECT det_id AS part, rank, greatest(0.0, x1 - 12) AS left_, least(520.0, x2 + 12) AS right_ FROM r WHERE rank <= 3""",
)
def uncovered_parts(spark, sf_dir):
    parts = V.detections(spark, sf_dir).select("video_id", "frame_idx", F.col("det_id").alias("part"), "bbox", G.area(F.col("bbox")).alias("area"))
    out = scenes.uncovered_parts(parts, float(V.FRAME_W * V.FRAME_H), V.FRAME_W, V.FRAME_H)
    return out.select("part", "rank", F.col("bbox.x1").alias("left_"), F.col("bbox.x2").alias("right_"))


def _drawn(d):
    """A small mask and depth map for each detection, as bytes."""

    def run(batches):
        y, x = np.mgrid[0:24, 0:32]
        for batch in batches:
            masks, depths = [], []
            for i in batch["det_id"]:
                mask = ((x - 10 - i % 8) ** 2 + (y - 12) ** 2 < 40 + i % 30).astype(np.uint8)
                depth = 0.2 + 0.5 * mask + (i % 5) / 50.0 * x / 32.0
                masks.append(mask.tobytes())
                depths.append(depth.astype(np.float64).tobytes())
            yield pd.DataFrame({"det_id": batch["det_id"], "mask": masks, "depth": depths, "h": 24, "w": 32})

    return V.spread(d.select("det_id"), "det_id").mapInPandas(run, "det_id bigint, mask binary, depth binary, h int, w int")


@query("M09 M11 Z21 Z31 Z22")
def mask_depths(spark, sf_dir):
    rows = _drawn(V.detections(spark, sf_dir))
    m = rasters.pandas_metrics("mask", "depth", "h", "w")
    return rows.select("det_id", m.alias("m")).select("det_id", *[R(F.col(f"m.{k}")).alias(k) for k in ("median", "std", "compactness", "separation", "edge_alignment", "largest_ratio")], "m.area")


@query(
    "D01 D06 D14 S24 V11",
    """WITH p AS (SELECT event_id, x, y FROM events, range(32) a(x), range(24) b(y) WHERE (x - 10 - event_id % 8) * (x - 10 - event_id % 8) + (y - 12) * (y - 12) < 40 + event_id % 30)
    SELECT event_id AS frame_idx, 'pot' AS label, CAST(min(x) AS DOUBLE) AS x1, CAST(min(y) AS DOUBLE) AS y1, CAST(max(x) + 1 AS DOUBLE) AS x2, CAST(max(y) + 1 AS DOUBLE) AS y2, round(least(0.95, greatest(0.2, 0.2 + 5.0 * count(*) / 768)), 6) AS confidence FROM p GROUP BY event_id""",
)
def detected_blobs(spark, sf_dir):
    from frameloom import models

    rows = _drawn(V.detections(spark, sf_dir))
    scaled = rows.select(F.lit(0).cast("bigint").alias("video_id"), F.col("det_id").alias("frame_idx"), F.col("mask").alias("image"), F.col("h").alias("height"), F.col("w").alias("width"))
    return models.hybrid(_bright(scaled), "blobs", "none", ["pot", "lid"], ["wall"]).select("frame_idx", "label", "x1", "y1", "x2", "y2", R(F.col("confidence")).alias("confidence"))


def _bright(d):

    @F.pandas_udf("binary")
    def bright(m: pd.Series) -> pd.Series:
        return m.map(lambda b: np.where(np.frombuffer(b, np.uint8), 255, 0).astype(np.uint8).tobytes())

    return d.withColumn("image", bright("image"))
