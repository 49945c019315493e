"""Projections, casts, labels and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import casts as C
from frameloom.functions import geometry as G
from frameloom.functions import jsontext as J
from frameloom.functions import labels as L
from frameloom.functions import scores as S
from frameloom.plans import views as V
from frameloom.plans.catalog import query


@query(
    "P01 P02 P03 P28 P30",
    """SELECT event_id,
        coalesce(TRY_CAST(trunc(TRY_CAST(json_extract_string(props, '$.page') AS DOUBLE)) AS BIGINT), -1) AS page_or,
        coalesce(TRY_CAST(trunc(TRY_CAST(event_type || event_id AS DOUBLE)) AS BIGINT), -1) AS never,
        CAST(trunc(value) AS BIGINT) AS whole,
        CASE CASE event_id % 5 WHEN 0 THEN ' YES' WHEN 1 THEN '0' WHEN 2 THEN 'n' WHEN 3 THEN '' ELSE 'True ' END
             WHEN ' YES' THEN true WHEN 'True ' THEN true WHEN '' THEN true ELSE false END AS flag,
        regexp_replace(regexp_replace(lower(trim(event_type || ' #' || event_id || '.')), '[^a-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug
       FROM events""",
)
def scalar_casts(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    n = F.col("event_id")
    flag = F.when(n % 5 == 0, " YES").when(n % 5 == 1, "0").when(n % 5 == 2, "n").when(n % 5 == 3, "").otherwise("True ")
    return e.select(
        "event_id",
        C.to_int(F.get_json_object("props", "$.page")).alias("page_or"),
        C.to_int(F.concat("event_type", n.cast("string"))).alias("never"),
        C.to_int(F.col("value")).alias("whole"),
        C.to_bool(flag, True).alias("flag"),
        L.slug(F.concat(F.col("event_type"), F.lit(" #"), n.cast("string"), F.lit("."))).alias("slug"),
    )


@query(
    "P04 P05 P06 P07 P08 P09 P10 P34 P36",
    f"""WITH {V.PROP},
    p AS (SELECT proposal_id, CASE WHEN proposal_id % 13 = 0 THEN '##s' WHEN proposal_id % 7 = 0 THEN '  ' || upper(predicted_label) || '  ' ELSE predicted_label END AS raw, human_label FROM prop),
    c AS (SELECT proposal_id, CASE WHEN trim(raw) = '' OR starts_with(trim(raw), '##') OR trim(raw) = '#' THEN 'unknown' ELSE trim(raw) END AS pred, human_label AS human FROM p)
    SELECT proposal_id, {V.sql_review_coarse("pred")} || ':' || {V.sql_normalize("pred")} AS display_predicted,
        CASE WHEN human = '' THEN '' ELSE {V.sql_review_coarse("human")} || ':' || {V.sql_normalize("human")} END AS display_human,
        {V.sql_review_coarse("coalesce(nullif(human, ''), pred)")} AS coarse_group,
        CASE WHEN {V.sql_normalize("pred")} = {V.sql_normalize("coalesce(nullif(human, ''), pred)")} THEN 'match'
             WHEN {V.sql_review_coarse("pred")} = {V.sql_review_coarse("coalesce(nullif(human, ''), pred)")} THEN 'fine_conflict' ELSE 'coarse_conflict' END AS conflict_level,
        {V.sql_normalize("pred")} AS shown_fine, {V.sql_review_coarse("pred")} AS shown_coarse FROM c""",
)
def label_display_fields(spark, sf_dir):
    n, p = F.col("proposal_id"), F.col("predicted_label")
    raw = F.when(n % 13 == 0, "##s").when(n % 7 == 0, F.concat(F.lit("  "), F.upper(p), F.lit("  "))).otherwise(p)
    rows = V.proposals(spark, sf_dir).select("proposal_id", L.clean_display(raw).alias("pred"), F.col("human_label").alias("human"))
    pred, human = F.col("pred"), F.col("human")
    train = C.first_present(human, pred)
    return rows.select(
        "proposal_id",
        L.display(pred).alias("display_predicted"),
        F.when(human == "", "").otherwise(L.display(human)).alias("display_human"),
        L.review_coarse(train).alias("coarse_group"),
        L.conflict_level(pred, train).alias("conflict_level"),
        L.shown(L.display(pred), "fine").alias("shown_fine"),
        L.shown(L.display(pred), "coarse").alias("shown_coarse"),
    )


@query(
    "P12 P13 P14 P15 P16 P17 P18 F01 F02 K05 X05",
    f"""WITH {V.LABELLED},
    f AS (SELECT *, CASE lower(coarse) WHEN 'cookware' THEN 0.35 WHEN 'dishware' THEN 0.40 WHEN 'utensil' THEN 0.50 WHEN 'appliance' THEN 0.45 WHEN 'hand' THEN 0.30 ELSE 0.28 END AS floor_ FROM lab)
    SELECT det_id, coarse, fine, trim(raw_label) AS raw, confidence >= floor_ AS may_start,
        CASE WHEN {V.sql_in("lower(trim(raw_label))", T.COOKWARE_BODIES)} THEN 'body' WHEN {V.sql_in("lower(trim(raw_label))", T.COOKWARE_LIDS)} THEN 'lid' END AS kind,
        {V.sql_in("lower(trim(raw_label))", T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS)} AS scene,
        confirmed AND track_id >= 0 AS confirmed_out,
        CASE WHEN track_id < 0 THEN 'negative_track_id' WHEN confidence < floor_ THEN 'low_confidence_new_track' END AS reason FROM f""",
)
def detection_label_fields(spark, sf_dir):
    from frameloom.operators import filters

    d = filters.new_track_floor(V.labelled(spark, sf_dir))
    raw = F.col("raw_label")
    return d.select(
        "det_id",
        "coarse",
        "fine",
        F.trim(raw).alias("raw"),
        "may_start",
        L.cookware_kind(raw).alias("kind"),
        L.is_scene(raw).alias("scene"),
        (F.col("confirmed") & (F.col("track_id") >= 0)).alias("confirmed_out"),
        F.when(F.col("track_id") < 0, "negative_track_id").when(~F.col("may_start"), "low_confidence_new_track").alias("reason"),
    )


@query(
    "P11 U04 W13",
    f"""WITH {V.PROP}, f AS (SELECT DISTINCT {V.sql_normalize("predicted_label")} AS fine FROM prop),
    c AS (SELECT fine, {V.sql_review_coarse("fine")} AS coarse FROM f)
    SELECT coarse, array_to_string(list_sort(list(fine)), ',') AS fines, count(*) AS n, dense_rank() OVER (ORDER BY coarse) - 1 AS idx FROM c GROUP BY coarse""",
)
def label_hierarchy(spark, sf_dir):
    from frameloom.operators import labels_ops

    return labels_ops.hierarchy(V.proposals(spark, sf_dir), "predicted_label")


@query(
    "P19 P20 P21 P22",
    """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lid, Pot ,lid' WHEN 1 THEN 'cooktop,,Burner' WHEN 2 THEN 'Cup, cup , wall' ELSE 'hand' END AS prompt FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lid|pot lid|pan lid|Pot' WHEN 1 THEN 'cooktop|stovetop|electric range|stove burner|burner'
        WHEN 2 THEN 'Cup|wall|kitchen wall|backsplash' ELSE 'hand' END AS labels, substring(md5(prompt), 1, 8) AS signature,
        event_id % 4 = 0 AS matches_lid FROM p""",
)
def prompt_expansion(spark, sf_dir):
    n = F.col("event_id")
    prompt = F.when(n % 4 == 0, "lid, Pot ,lid").when(n % 4 == 1, "cooktop,,Burner").when(n % 4 == 2, "Cup, cup , wall").otherwise("hand")
    labels = L.prompt_labels(prompt)
    return V.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws("|", labels).alias("labels"),
        F.substring(F.md5(prompt.cast("binary")), 1, 8).alias("signature"),
        F.exists(labels, lambda x: L.prompt_matches(F.lit("pot-lid"), x)).alias("matches_lid"),
    )


@query(
    "P25 P26 P27 G15 Z36",
    f"""WITH {V.DET} SELECT det_id, x1 / 520.0 AS u1, least(1.0, y1 / 100.0) AS v1, least(1.0, x2 / 520.0) AS u2, least(1.0, y2 / 100.0) AS v2, 8 AS points,
        round(x1 / 520.0, 6) AS u1_rounded FROM det""",
)
def polygon_normalisation(spark, sf_dir):
    ring = G.ring(F.col("bbox"))
    unit = G.clamped_unit(ring, F.lit(float(V.FRAME_W)), F.lit(100.0))
    return V.detections(spark, sf_dir).select("det_id", unit[0].alias("u1"), unit[1].alias("v1"), unit[4].alias("u2"), unit[5].alias("v2"), F.size(unit).alias("points"), F.round(unit[0], 6).alias("u1_rounded"))


@query(
    "K11 P31 P32",
    f"""WITH {V.PROP}, k AS (SELECT proposal_id, cluster_id, {V.sql_review_coarse("predicted_label")} AS coarse, '/data/' || frame || '.v1/img_' || proposal_id || '.jpg' AS path FROM prop),
    m AS (SELECT *, coarse || '_b' || lpad(CAST(proposal_id % 3 AS VARCHAR), 3, '0') || '_' || CASE WHEN cluster_id < 0 THEN 'noise' ELSE 'c' || lpad(CAST(cluster_id AS VARCHAR), 3, '0') END AS cluster_key FROM k)
    SELECT proposal_id, 'img_' || proposal_id || '_' || substring(sha1(path), 1, 10) AS stem, cluster_key, coarse AS prefix FROM m""",
)
def file_and_cluster_keys(spark, sf_dir):
    from frameloom.operators import clusters

    path = F.concat(F.lit("/data/"), F.col("frame"), F.lit(".v1/img_"), F.col("proposal_id").cast("string"), F.lit(".jpg"))
    p = V.proposals(spark, sf_dir).withColumn("coarse", L.review_coarse(F.col("predicted_label")))
    key = clusters.cluster_key(F.col("coarse"), F.col("proposal_id") % 3, F.col("cluster_id"))
    return p.select("proposal_id", L.file_stem(path).alias("stem"), key.alias("cluster_key"), clusters.key_prefix(key).alias("prefix"))


@query(
    "P33 P35 Z29 Z28",
    """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'relabel' WHEN 1 THEN 'delete' WHEN 2 THEN 'accept' END AS decision,
        CASE (conv_id + turn) % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 END AS confidence,
        CASE (conv_id + turn) % 4 WHEN 0 THEN 'relabel' WHEN 1 THEN 'delete' WHEN 2 THEN 'reviewed' ELSE 'none' END AS plan FROM conversations""",
)
def reviewer_responses(spark, sf_dir):
    from frameloom.operators import review

    k = (F.col("conv_id") + F.col("turn")) % 4
    text = F.when(k == 0, 'Sure:\n```json\n{"decision": "relabel", "confidence": 0.9}\n```').when(k == 1, '{"decision": "delete", "confidence": 0.4} done').when(k == 2, '{"decision": "accept').otherwise("no idea")
    found = J.response(text, "decision string, confidence double")
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", found["decision"].alias("decision"), found["confidence"].alias("confidence"), review.planned_action(found["decision"]).alias("plan"))


@query(
    "G01 G02 G03 G04 G05 G06 G07 G08 G14",
    f"""WITH {V.DET}, p AS (SELECT a.det_id AS a_id, b.det_id AS b_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
        FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id)
    SELECT a_id, b_id, round({V.sql_iou("a", "b")}, 6) AS iou, round({V.sql_overlap("a", "b")}, 6) AS overlap, round({V.sql_containment("a", "b")}, 6) AS containment,
        round({V.sql_distance("a", "b")}, 6) AS distance, round({V.sql_diagonal("a")}, 6) AS diagonal, {V.sql_area("a")} AS area_a,
        greatest(ax2, bx2) - least(ax1, bx1) AS union_w,
        round({V.sql_intersection("a", "b")} / greatest(1.0, {V.sql_area("a")} + {V.sql_area("b")} - {V.sql_intersection("a", "b")}), 6) AS iou_floored FROM p""",
)
def box_pairs(spark, sf_dir):
    from frameloom.operators import joins

    p = joins.frame_pairs(V.detections(spark, sf_dir).select("det_id", "video_id", "frame_idx", "bbox"))
    a, b = F.col("a.bbox"), F.col("b.bbox")
    r = lambda c: F.round(c, 6)
    return p.select(
        F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), r(G.iou(a, b)).alias("iou"), r(G.overlap_ratio(a, b)).alias("overlap"), r(G.containment(a, b)).alias("containment"),
        r(G.distance(a, b)).alias("distance"), r(G.diagonal(a)).alias("diagonal"), G.area(a).alias("area_a"), G.width(G.union(a, b)).alias("union_w"), r(G.iou_floored(a, b)).alias("iou_floored"),
    )


@query(
    "G09 G10 G11 G12 G13 M04",
    f"""WITH {V.DET}, s AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, 1.0 + (det_id % 3) / 10.0 AS f FROM det)
    SELECT det_id, least(greatest(0.0, x1 - 40.0), 519.0) AS sx1,
        nullif(concat_ws('+', CASE WHEN x1 <= 31.2 THEN 'left' END, CASE WHEN x2 >= 488.8 THEN 'right' END, CASE WHEN y1 <= 24.0 THEN 'top' END, CASE WHEN y2 >= 376.0 THEN 'bottom' END), '') AS edges,
        x1 <= 4.0 OR y1 <= 4.0 OR x2 >= 516.0 OR y2 >= 396.0 AS border,
        round(CASE WHEN det_id % 3 = 0 THEN x1 ELSE greatest(0.0, cx - (x2 - x1) * f / 2.0) END, 6) AS gx1, x2 / 0.5 AS rx2 FROM s""",
)
def box_moves(spark, sf_dir):
    b = F.col("bbox")
    scale = 1.0 + (F.col("det_id") % 3) / 10.0
    return V.detections(spark, sf_dir).select(
        "det_id",
        G.shifted(b, F.lit(-40.0), F.lit(0.0), V.FRAME_W, V.FRAME_H)["x1"].alias("sx1"),
        G.near_edge(b, V.FRAME_W, V.FRAME_H).alias("edges"),
        G.touches_border(b, V.FRAME_W, V.FRAME_H).alias("border"),
        F.round(G.scaled(b, scale, V.FRAME_W, V.FRAME_H)["x1"], 6).alias("gx1"),
        G.restored(b, F.lit(0.5), F.lit(0.5))["x2"].alias("rx2"),
    )


@query(
    "G16 G17 G20 G21 G22 D17 D18 X10",
    f"""WITH {V.DET} SELECT det_id, CASE WHEN confidence >= .92 THEN 5 WHEN confidence >= .85 THEN 4 WHEN confidence >= .75 THEN 3 WHEN confidence >= .65 THEN 2 WHEN confidence >= .55 THEN 1 ELSE 0 END AS budget,
        CASE WHEN confidence >= .78 AND confidence / 4 >= .22 THEN 2 WHEN confidence >= .58 AND confidence / 4 >= .12 THEN 1 ELSE 0 END AS secondary,
        CASE WHEN confidence < .25 THEN 'low' WHEN confidence < .45 THEN 'medium' ELSE 'high' END AS tier,
        CASE WHEN confidence < .45 THEN 'rejected' WHEN det_id % 3 = 0 OR confidence < .65 THEN 'needs_vlm' WHEN confidence >= .80 THEN 'accepted' ELSE 'uncertain' END AS status,
        round(exp(-abs(confidence - .5) / .12), 6) AS depth_like FROM det""",
)
def score_steps(spark, sf_dir):
    c = F.col("confidence")
    return V.detections(spark, sf_dir).select("det_id", S.recovery_budget(c).alias("budget"), S.secondary_budget(c, c / 4).alias("secondary"), S.tier(c).alias("tier"), S.record_status(c, F.col("det_id") % 3 == 0).alias("status"), F.round(S.depth_similarity(c, F.lit(0.5)), 6).alias("depth_like"))


@query(
    "G18 G19 A12",
    f"""WITH {V.DET}, t AS (SELECT track_id, raw_label, count(*) AS n FROM det GROUP BY ALL), s AS (SELECT track_id, sum(n) AS total FROM t GROUP BY track_id),
    e AS (SELECT t.track_id, round(-sum(n * 1.0 / total * ln(n * 1.0 / total + 1e-9)), 6) AS entropy FROM t JOIN s USING (track_id) GROUP BY t.track_id),
    d AS (SELECT track_id, round(CASE WHEN count(*) < 2 THEN 0.5 ELSE exp(-stddev_pop(confidence) / 0.1) END, 6) AS stability FROM det GROUP BY track_id)
    SELECT track_id, entropy, stability FROM e JOIN d USING (track_id)""",
)
def track_entropy_and_stability(spark, sf_dir):
    from frameloom.operators import aggregates

    return aggregates.track_spread(V.detections(spark, sf_dir))


@query(
    "G24 F03",
    f"""WITH {V.LABELLED}, a AS (SELECT *, greatest(greatest(1.0, x2 - x1) / greatest(1.0, y2 - y1), greatest(1.0, y2 - y1) / greatest(1.0, x2 - x1)) AS aspect FROM lab)
    SELECT det_id, round(aspect, 6) AS aspect, coarse <> 'utensil' OR confidence >= .60 OR (aspect >= 2.2 AND confirmed) AS plausible FROM a""",
)
def plausible_utensils(spark, sf_dir):
    from frameloom.operators import filters

    d = V.labelled(spark, sf_dir)
    return d.select("det_id", F.round(G.aspect(F.col("bbox")), 6).alias("aspect"), filters.plausible_utensil(F.col("coarse"), F.col("confidence"), F.col("bbox"), F.col("confirmed")).alias("plausible"))


@query("P38", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'gamma|clahe' WHEN 1 THEN 'sharpen' ELSE '' END AS steps FROM events")
def preprocess_steps(spark, sf_dir):
    n = F.col("event_id")
    text = F.when(n % 3 == 0, " gamma + clahe").when(n % 3 == 1, ",sharpen,").otherwise(" ")
    return V.table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", F.filter(F.transform(F.split(text, "[,+]"), lambda x: F.trim(x)), lambda x: x != "")).alias("steps"))
