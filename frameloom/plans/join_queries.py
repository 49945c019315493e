"""Joins: by equality, by overlap, best match, intervals, one to one."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import joins
from frameloom.plans import views as V
from frameloom.plans.catalog import query

R = lambda c: F.round(c, 6)
_PAIR = "a.video_id = b.video_id AND a.frame_idx = b.frame_idx"


@query(
    "P06 P12 P13 F02 G01 J12 A01",
    f"""WITH {V.LABELLED}, ok AS (SELECT * FROM lab WHERE confirmed AND track_id IS NOT NULL)
    SELECT a.video_id, a.frame_idx, a.det_id AS first_id, a.track_id AS first_track, a.coarse AS first_coarse, b.det_id AS second_id, b.track_id AS second_track, b.coarse AS second_coarse,
        round({V.sql_iou("a.", "b.")}, 6) AS iou
    FROM ok a JOIN ok b ON {_PAIR} AND a.det_id < b.det_id AND lower(a.coarse) <> lower(b.coarse) WHERE {V.sql_iou("a.", "b.")} > 0.75""",
)
def overlap_conflicts(spark, sf_dir):
    return joins.overlap_conflicts(V.labelled(spark, sf_dir)).withColumn("iou", R(F.col("iou")))


@query(
    "J01 J23 J29",
    f"""WITH {V.LABELLED}, m AS (SELECT video_id, frame_idx, coarse AS label, x1, y1, x2, y2, max(det_id) AS seq, arg_max(CAST({V.sql_area("")} / 2 AS DOUBLE), det_id) AS mask_area FROM lab WHERE det_id % 3 <> 0 GROUP BY ALL)
    SELECT d.det_id, m.mask_area, m.mask_area IS NOT NULL AS has_mask FROM lab d LEFT JOIN m ON d.video_id = m.video_id AND d.frame_idx = m.frame_idx AND d.coarse = m.label AND d.x1 = m.x1 AND d.y1 = m.y1 AND d.x2 = m.x2 AND d.y2 = m.y2""",
)
def mask_by_box(spark, sf_dir):
    d = V.labelled(spark, sf_dir).withColumn("label", F.col("coarse"))
    masks = d.where("det_id % 3 <> 0").select("video_id", "frame_idx", "label", "bbox", F.col("det_id").alias("seq"), (G.area(F.col("bbox")) / 2).alias("mask_area"))
    return joins.with_mask(d, masks).select("det_id", "mask_area", F.col("mask_area").isNotNull().alias("has_mask"))


@query(
    "J02 J28 D10",
    f"""WITH {V.LABELLED}, p AS (SELECT a.det_id, b.coarse AS other, {V.sql_iou("a.", "b.")} AS iou, b.det_id AS other_id,
        CAST(contains(lower(trim(a.raw_label)), lower(b.coarse)) OR contains(lower(b.coarse), lower(trim(a.raw_label))) AS INT) AS related FROM lab a JOIN lab b ON {_PAIR} AND (a.det_id // 4) % 2 = 0 AND (b.det_id // 4) % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY related DESC, iou DESC, other_id) AS n FROM p WHERE related = 1 OR iou >= 0.1)
    SELECT det_id, other, round(iou, 6) AS iou, related FROM r WHERE n = 1""",
)
def best_label_match(spark, sf_dir):
    d = V.labelled(spark, sf_dir)
    left = d.where("det_id div 4 % 2 = 0").withColumn("label", F.col("raw_label"))
    right = d.where("det_id div 4 % 2 = 1").withColumn("label", F.col("coarse"))
    return joins.best_label(left, right).withColumn("iou", R(F.col("iou")))


@query(
    "J03 J11",
    f"""WITH {V.LABELLED}, k AS (SELECT *, CASE WHEN {V.sql_in("lower(trim(coarse))", T.COOKWARE_BODIES)} THEN 'body' WHEN {V.sql_in("lower(trim(coarse))", T.COOKWARE_LIDS)} THEN 'lid' END AS kind FROM lab)
    SELECT a.det_id FROM k a WHERE a.source <> 'yolo_world' AND NOT EXISTS (SELECT 1 FROM k b WHERE {_PAIR} AND b.source = 'yolo_world'
        AND (lower(trim(a.coarse)) = lower(trim(b.coarse)) OR a.kind = b.kind) AND {V.sql_iou("a.", "b.")} >= 0.18)""",
)
def uncovered_redetections(spark, sf_dir):
    d = V.labelled(spark, sf_dir).withColumn("label", F.col("coarse"))
    return joins.without_covered(d.where("source <> 'yolo_world'"), d.where("source = 'yolo_world'"), 0.18).select("det_id")


@query(
    "J06 J08 X07",
    f"""WITH {V.LABELLED}, h AS (SELECT * FROM lab WHERE lower(trim(raw_label)) = 'hand'), p AS (SELECT a.det_id, b.det_id AS hand_id, {V.sql_iou("a.", "b.")} AS hand_iou, {V.sql_distance("a.", "b.")} AS d, {V.sql_diagonal("a.")} AS diag, b.confidence < 0.66 AS grab
        FROM lab a JOIN h b ON {_PAIR} AND a.det_id <> b.det_id), r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY hand_iou DESC, hand_id) AS n FROM p WHERE hand_iou > 0)
    SELECT l.det_id, r.hand_id, round(r.hand_iou, 6) AS hand_iou, coalesce(r.hand_iou >= 0.01 OR r.d <= 1.4 * r.diag OR r.grab, false) AS attached FROM lab l LEFT JOIN r ON l.det_id = r.det_id AND r.n = 1""",
)
def nearest_hands(spark, sf_dir):
    d = V.labelled(spark, sf_dir)
    hands = d.where(L.lowered(F.col("raw_label")) == "hand").withColumn("grabbing", F.col("confidence") < 0.66)
    return joins.nearest_hand(d, hands).select("det_id", "hand_id", R(F.col("hand_iou")).alias("hand_iou"), "attached")


@query(
    "J07 G07 U06",
    f"""WITH {V.LABELLED}, h AS (SELECT video_id, frame_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lab WHERE coarse = 'hand' GROUP BY ALL),
    t AS (SELECT video_id, frame_idx + 1 AS frame_idx, track_id, x1, y1, x2, y2 FROM lab WHERE confirmed AND track_id >= 0 AND coarse <> 'hand')
    SELECT a.video_id, a.frame_idx, count(DISTINCT b.track_id) AS affected FROM h a JOIN t b ON {_PAIR} WHERE {V.sql_iou("a.", "b.")} >= 0.15 OR {V.sql_containment("a.", "b.")} >= 0.40 GROUP BY ALL HAVING count(DISTINCT b.track_id) >= 3""",
)
def occlusion_events(spark, sf_dir):
    d = V.labelled(spark, sf_dir)
    return joins.occluded_frames(d.where("coarse <> 'hand'"), d.where("coarse = 'hand'"))


@query(
    "J04 J05 S20",
    f"""WITH {V.LABELLED}, r AS (SELECT a.det_id, b.track_id AS past_track, b.det_id AS past_id, {V.sql_iou("a.", "b.")} AS iou, row_number() OVER (PARTITION BY a.det_id ORDER BY {V.sql_iou("a.", "b.")} DESC, b.frame_idx DESC, b.det_id DESC) AS n
        FROM lab a JOIN lab b ON a.video_id = b.video_id AND a.coarse = b.coarse AND a.frame_idx - b.frame_idx BETWEEN 1 AND 4 AND b.track_id >= 0 WHERE {V.sql_iou("a.", "b.")} >= 0.35)
    SELECT det_id, past_track, past_id, round(iou, 6) AS iou FROM r WHERE n = 1""",
)
def recent_track_candidates(spark, sf_dir):
    return joins.recent_candidates(V.labelled(spark, sf_dir), 4, 0.35).withColumn("iou", R(F.col("iou")))


@query(
    "J05 X13",
    f"""WITH {V.LABELLED}, s AS (SELECT * FROM lab WHERE {V.sql_in("lower(trim(raw_label))", T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS)}), m AS (SELECT * FROM lab WHERE {V.sql_in("coarse", T.MOVABLE)} AND track_id >= 0),
    p AS (SELECT a.det_id, b.track_id AS track, b.det_id AS bid, {V.sql_iou("a.", "b.")} AS i, {V.sql_containment("a.", "b.")} AS c FROM s a JOIN m b ON a.video_id = b.video_id AND a.frame_idx - b.frame_idx BETWEEN 1 AND 5),
    r AS (SELECT *, greatest(i / 0.35, c / 0.65) AS score, row_number() OVER (PARTITION BY det_id ORDER BY greatest(i / 0.35, c / 0.65) DESC, bid DESC) AS n FROM p WHERE i >= 0.35 OR c >= 0.65)
    SELECT det_id, track, round(score, 6) AS score FROM r WHERE n = 1""",
)
def scene_takeovers(spark, sf_dir):
    d = V.labelled(spark, sf_dir)
    found = joins.scene_takeovers(d.where(L.is_scene(F.col("raw_label"))), d.where(F.col("coarse").isin(*T.MOVABLE) & (F.col("track_id") >= 0)))
    return found.withColumn("score", R(F.col("score")))


@query(
    "J09 J08 Z06",
    f"""WITH {V.LABELLED}, p AS (SELECT a.det_id, b.det_id AS cookware_id, {V.sql_iou("a.", "b.")} AS i FROM lab a JOIN lab b ON {_PAIR} AND a.det_id <> b.det_id
        WHERE {V.sql_in("lower(trim(b.raw_label))", T.COOKWARE_BODIES)} AND {V.sql_in("a.fine", ("lid", "pot lid", "pan lid", "plate"))} AND {V.sql_iou("a.", "b.")} >= 0.12
        AND greatest(1.0, {V.sql_area("a.")}) / greatest(1.0, {V.sql_area("b.")}) BETWEEN 0.08 AND 1.20 AND {V.sql_distance("a.", "b.")} <= greatest(18.0, {V.sql_diagonal("b.")} * 0.38)
        AND a.confirmed AND a.track_id >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY i DESC, cookware_id) AS n FROM p)
    SELECT det_id, cookware_id, round(i, 6) AS cookware_iou FROM r WHERE n = 1""",
)
def lids_on_cookware(spark, sf_dir):
    from frameloom.operators import relations

    return relations.snapshot(V.labelled(spark, sf_dir)).where("cookware_id is not null").select("det_id", "cookware_id", R(F.col("cookware_iou")).alias("cookware_iou"))


@query(
    "J13 G14",
    f"""WITH {V.DET}, p AS (SELECT a.det_id AS x, b.det_id AS y FROM det a JOIN det b ON {_PAIR} AND a.det_id < b.det_id WHERE {V.sql_iou("a.", "b.")} > 0.25
        OR {V.sql_distance("a.", "b.")} / sqrt(pow(greatest(a.x2 - a.x1, b.x2 - b.x1, 1.0), 2) + pow(greatest(a.y2 - a.y1, b.y2 - b.y1, 1.0), 2)) < 0.08), q AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p)
    SELECT x AS det_id, count(*) AS partners, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS partner_ids FROM q GROUP BY x""",
)
def conflict_zones(spark, sf_dir):
    return joins.conflict_zones(V.detections(spark, sf_dir))


@query(
    "J10",
    f"""WITH {V.DET} SELECT a.det_id AS a_id, b.det_id AS b_id, round({V.sql_iou("a.", "b.")}, 6) AS iou FROM det a JOIN det b ON a.video_id = b.video_id AND a.det_id < b.det_id AND a.frame_idx // 50 = b.frame_idx // 50 WHERE {V.sql_iou("a.", "b.")} >= 0.8""",
)
def spatial_grid_join(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumn("era", F.floor(F.col("frame_idx") / 50)).select("det_id", "video_id", "era", "bbox")
    pairs = joins.grid_pairs(d, d, 80.0, 0.8, ["video_id", "era"]).where(F.col("a.det_id") < F.col("b.det_id"))
    return pairs.select(F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), R(G.iou(F.col("a.bbox"), F.col("b.bbox"))).alias("iou"))


@query(
    "J16 J17 J26 J27 J30 S12",
    f"""WITH {V.PROP}, s AS (SELECT proposal_id, CASE WHEN proposal_id % 6 = 0 THEN 'saved_' || predicted_label WHEN proposal_id % 6 = 1 THEN ' ' ELSE '' END AS human_label, '' AS status FROM prop WHERE proposal_id % 2 = 0),
    m AS (SELECT proposal_id, proposal_id AS embedding_idx FROM prop WHERE proposal_id % 10 <> 9)
    SELECT p.proposal_id, coalesce(nullif(trim(s.human_label), ''), nullif(trim(p.human_label), ''), '') AS human_label, p.status, coalesce(m.embedding_idx, -1) AS embedding_idx,
        coalesce(nullif(trim(s.human_label), ''), nullif(trim(p.human_label), ''), predicted_label) AS label FROM prop p LEFT JOIN m USING (proposal_id) LEFT JOIN s USING (proposal_id)""",
)
def coalesced_sources(spark, sf_dir):
    from frameloom.functions import casts as C
    from frameloom.operators import review

    p = V.proposals(spark, sf_dir)
    n = F.col("proposal_id")
    saved = p.where(n % 2 == 0).select(n, F.when(n % 6 == 0, F.concat(F.lit("saved_"), F.col("predicted_label"))).otherwise("").alias("human_label"), F.lit("").alias("status"))
    meta = p.where(n % 10 != 9).select(n, n.alias("embedding_idx"))
    rows = review.overlaid(p, saved, "proposal_id", ["human_label", "status"]).join(meta, "proposal_id", "left")
    return rows.select("proposal_id", "human_label", "status", F.coalesce("embedding_idx", F.lit(-1)).alias("embedding_idx"), C.first_present(F.col("human_label"), F.col("predicted_label")).alias("label"))


@query(
    "J19 A06 K13 U03 S15",
    f"""WITH {V.PROP}, g AS (SELECT frame AS stem, row_number() OVER (PARTITION BY frame ORDER BY proposal_id) - 1 AS pos, (proposal_id * 7) % 10 AS c FROM prop WHERE proposal_id % 9 <> 0),
    p AS (SELECT frame AS stem, row_number() OVER (PARTITION BY frame ORDER BY proposal_id) - 1 AS pos, (proposal_id * 3) % 10 AS c FROM prop WHERE proposal_id % 11 <> 0),
    n AS (SELECT i AS idx, {V._NAMES_SQL}[i + 1] AS name, {V.sql_review_coarse(f"{V._NAMES_SQL}[i + 1]")} AS coarse FROM range(10) t(i)),
    j AS (SELECT a.name AS t, b.name AS q, a.coarse AS tc, b.coarse AS qc FROM g FULL JOIN p ON g.stem = p.stem AND g.pos = p.pos LEFT JOIN n a ON a.idx = g.c LEFT JOIN n b ON b.idx = p.c)
    SELECT count(*) FILTER (t IS NOT NULL AND q IS NOT NULL) AS matched, count(*) FILTER (t IS NULL OR q IS NULL) AS unmatched, count(*) FILTER (t = q) AS fine_correct, count(*) FILTER (tc = qc) AS coarse_correct,
        count(*) FILTER (t = q) / count(*) FILTER (t IS NOT NULL AND q IS NOT NULL) AS fine_accuracy, count(*) FILTER (tc = qc) / count(*) FILTER (t IS NOT NULL AND q IS NOT NULL) AS coarse_accuracy FROM j""",
)
def hierarchical_accuracy(spark, sf_dir):
    from frameloom.operators import evaluation

    truth, predicted, names = _label_files(spark, sf_dir)
    return evaluation.accuracy(truth, predicted, names)


def _label_files(spark, sf_dir):
    from pyspark.sql import Window

    p = V.proposals(spark, sf_dir)
    n = F.col("proposal_id")
    pos = F.row_number().over(Window.partitionBy("stem").orderBy("proposal_id")) - 1
    file = lambda d, k: d.select(F.col("frame").alias("stem"), "proposal_id", ((n * k) % 10).cast("int").alias("class_id")).withColumn("pos", pos).drop("proposal_id")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(["pot", "pan", "lid", "plate", "bowl", "cup", "knife", "spoon", "sponge", "gadget"])], "idx int, name string")
    return file(p.where(n % 9 != 0), 7), file(p.where(n % 11 != 0), 3), names


@query(
    "A06 K13",
    f"""WITH {V.PROP}, x AS (SELECT predicted_label AS t, {V._NAMES_SQL}[(label + vec_id % 2) % 10 + 1] AS p FROM embeddings JOIN prop ON vec_id = proposal_id),
    l AS (SELECT t AS label FROM x UNION SELECT p FROM x), s AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted, (SELECT count(*) FROM x WHERE t = label AND p = label) AS hits FROM l)
    SELECT label, support, predicted, hits, CASE WHEN predicted > 0 THEN round(hits / predicted, 6) ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN round(hits / support, 6) ELSE 0.0 END AS recall FROM s""",
)
def class_report(spark, sf_dir):
    from frameloom.operators import evaluation

    v = V.table(spark, sf_dir, "embeddings")
    names = F.array(*map(F.lit, ["pot", "pan", "lid", "plate", "bowl", "cup", "knife", "spoon", "sponge", "gadget"]))
    pairs = v.select(F.element_at(names, (F.col("label") + 1).cast("int")).alias("truth"), F.element_at(names, ((F.col("label") + F.col("vec_id") % 2) % 10 + 1).cast("int")).alias("predicted"))
    return evaluation.class_report(pairs)


@query(
    "J24 J25 T13 K22",
    """SELECT o_orderkey AS video_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND o_totalprice > 100000""",
)
def pending_videos(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    videos = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("video_id"))
    ledger = o.select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("state"))
    return joins.pending(videos, ledger)


@query(
    "J28",
    f"""WITH {V.DET}, q AS (SELECT video_id, frame_idx, det_id AS point_id, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y FROM det WHERE det_id % 5 = 0),
    r AS (SELECT q.point_id, d.det_id, {V.sql_area("d.")} AS area, row_number() OVER (PARTITION BY point_id ORDER BY {V.sql_area("d.")}, d.det_id) AS n FROM q JOIN det d ON q.video_id = d.video_id AND q.frame_idx = d.frame_idx AND q.x BETWEEN d.x1 AND d.x2 AND q.y BETWEEN d.y1 AND d.y2)
    SELECT point_id, det_id, area FROM r WHERE n = 1""",
)
def picked_boxes(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    points = d.where("det_id % 5 = 0").select("video_id", "frame_idx", F.col("det_id").alias("point_id"), G.center_x(F.col("bbox")).alias("x"), G.center_y(F.col("bbox")).alias("y"))
    return joins.smallest_at(d, points)


@query(
    "J18 K03 X21",
    f"""WITH {V.PROP}, l AS (SELECT i - 1 AS cluster_id, ['keep','delete','uncertain','merge'][i % 4 + 1] AS action, CASE WHEN i % 5 = 0 THEN '' ELSE 'cl_' || i END AS cluster_label FROM range(14) t(i)),
    r AS (SELECT p.*, l.action, l.cluster_label, p.cluster_id >= 0 AND l.action IS NOT NULL AS decided FROM prop p LEFT JOIN l USING (cluster_id)),
    o AS (SELECT proposal_id, cluster_id, CASE WHEN decided THEN coalesce(nullif(cluster_label, ''), predicted_label) ELSE predicted_label END AS label,
        CASE WHEN NOT decided THEN 'unreviewed' WHEN action = 'uncertain' THEN 'review_needed' ELSE 'approved' END AS review_status, CASE WHEN decided AND action = 'merge' THEN 'merged' ELSE '' END AS merge_note FROM r WHERE NOT decided OR action <> 'delete')
    SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS class_idx FROM o""",
)
def applied_cluster_labels(spark, sf_dir):
    from frameloom.operators import clusters

    i = F.col("id")
    labels = spark.range(14).select((i - 1).alias("cluster_id"), F.element_at(F.array(*map(F.lit, ["keep", "delete", "uncertain", "merge"])), (i % 4 + 1).cast("int")).alias("action"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("cl_"), i.cast("string"))).alias("cluster_label"))
    return clusters.applied_labels(V.proposals(spark, sf_dir), labels)
