"""Aggregations, windows, ranking, sets and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import aggregates, clusters, filters, topk, windows
from frameloom.plans import views as V
from frameloom.plans.catalog import query

R = lambda c: F.round(c, 6)


@query(
    "A01 A18 A08",
    f"""WITH {V.LABELLED} SELECT 'coarse' AS metric, coarse AS key, count(*) AS n FROM lab GROUP BY ALL UNION ALL SELECT 'fine', fine, count(*) FROM lab GROUP BY ALL
    UNION ALL SELECT 'raw_label', raw_label, count(*) FROM lab GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM lab GROUP BY ALL""",
)
def counts_by_label(spark, sf_dir):
    return aggregates.counts_by(V.labelled(spark, sf_dir), "coarse", "fine", "raw_label", "source")


@query(
    "A01 A18 A09",
    f"""WITH {V.LABELLED} SELECT count(*) AS detections, count(DISTINCT (video_id, frame_idx)) AS frames, count(DISTINCT CASE WHEN track_id >= 0 THEN track_id END) AS tracks, count(*) FILTER (NOT confirmed) AS unconfirmed,
        count(*) FILTER (track_id < 0) AS negative_tracks, round(avg(confidence), 6) AS mean_confidence FROM lab""",
)
def run_totals(spark, sf_dir):
    return aggregates.run_totals(V.labelled(spark, sf_dir))


@query(
    "A10 G18",
    f"""WITH {V.LABELLED}, v AS (SELECT track_id, coarse, sum(confidence * CASE source WHEN 'yolo_world' THEN 1.0 WHEN 'track_persist' THEN 0.2 ELSE 0.5 END) AS w FROM lab WHERE track_id >= 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(w, 6) DESC, coarse DESC) AS n FROM v)
    SELECT track_id, max(coarse) FILTER (n = 1) AS label, round(max(w) / sum(w), 6) AS share, count(*) AS labels FROM r GROUP BY track_id""",
)
def track_label_votes(spark, sf_dir):
    return aggregates.label_votes(V.labelled(spark, sf_dir))


@query(
    "A11 A13 A14 F15 Z24",
    f"""WITH {V.LABELLED}, v AS (SELECT track_id, coarse, sum(confidence * CASE source WHEN 'yolo_world' THEN 1.0 WHEN 'track_persist' THEN 0.2 ELSE 0.5 END) AS w FROM lab WHERE track_id >= 0 GROUP BY ALL),
    s AS (SELECT track_id, round(max(w) / sum(w), 6) AS share FROM v GROUP BY track_id), b AS (SELECT track_id, count(*) AS n, avg(confidence) AS c, avg(CAST(confirmed AS DOUBLE)) AS ok, stddev_pop({V.sql_area("")}) AS sp, avg({V.sql_area("")}) AS ar FROM lab WHERE track_id >= 0 GROUP BY track_id),
    x AS (SELECT track_id, n, share, ok, 0.35 * c + 0.25 * share + 0.20 * ok + 0.10 * exp(-sp / ar) + 0.10 * least(1.0, n / 20.0) AS score FROM b JOIN s USING (track_id))
    SELECT track_id, n AS length, round(score, 6) AS score, concat_ws(',', CASE WHEN share < 0.5 THEN 'label_jitter' END, CASE WHEN n < 3 THEN 'short' END, CASE WHEN ok < 0.5 THEN 'unconfirmed' END) AS flags,
        CASE WHEN score >= 0.75 THEN 'gold' WHEN score >= 0.60 THEN 'silver' WHEN score >= 0.45 THEN 'review' ELSE 'reject' END AS category FROM x""",
)
def track_quality(spark, sf_dir):
    return aggregates.track_quality(V.labelled(spark, sf_dir))


@query(
    "W03 A01",
    f"""WITH {V.LABELLED}, f AS (SELECT video_id, frame_idx, count(*) FILTER (coarse = 'hand') AS hands, count(*) FILTER (coarse = 'hand' AND confirmed) AS confirmed_hands FROM lab GROUP BY ALL)
    SELECT *, coalesce(lag(hands) OVER (PARTITION BY video_id ORDER BY frame_idx), 0) > 0 AND hands = 0 AS disappeared FROM f""",
)
def hand_frames(spark, sf_dir):
    return aggregates.hand_frames(V.labelled(spark, sf_dir))


@query(
    "A01 J12",
    f"""WITH {V.LABELLED}, o AS (SELECT * FROM lab WHERE confirmed AND coarse IN ('cookware', 'dishware')) SELECT CASE WHEN a.coarse = 'cookware' THEN a.track_id ELSE b.track_id END AS cookware_track, CASE WHEN a.coarse = 'cookware' THEN b.track_id ELSE a.track_id END AS dishware_track, count(*) AS frames
    FROM o a JOIN o b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id AND a.coarse <> b.coarse WHERE {V.sql_iou("a.", "b.")} > 0.60 GROUP BY ALL""",
)
def overlapping_track_pairs(spark, sf_dir):
    return aggregates.overlap_tracks(V.labelled(spark, sf_dir), 0.60)


@query(
    "A02 A03 Z37",
    f"""WITH {V.PROP}, l AS (SELECT cluster_id, predicted_label AS label, count(*) AS n, min(proposal_id) AS first, sum(confidence) AS sc, sum(area) AS sa, sum(probability) AS sp, sum(outlier) AS so FROM prop GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS k FROM l),
    a AS (SELECT cluster_id, sum(n) AS num_instances, string_agg(label || '=' || n, ',' ORDER BY k) FILTER (k <= 8) AS top_labels, max(label) FILTER (k = 1) AS display_label, max(n) AS top, round(sum(sc) / sum(n), 6) AS average_confidence, round(sum(sa) / sum(n), 6) AS average_area, round(sum(sp) / sum(n), 6) AS average_probability, round(sum(so) / sum(n), 6) AS average_outlier FROM r GROUP BY cluster_id),
    m AS (SELECT cluster_id, median(confidence) AS median_confidence, median(area) AS median_area FROM prop GROUP BY cluster_id),
    o AS (SELECT cluster_id, num_instances, top_labels, display_label, round(top / num_instances, 6) AS purity, average_confidence, average_area, average_probability, average_outlier, median_confidence, median_area, cluster_id < 0 AS is_noise FROM a JOIN m USING (cluster_id))
    SELECT *, CASE WHEN is_noise THEN 'review_noise' WHEN purity >= 0.85 THEN 'keep' ELSE 'review' END AS suggested_action, dense_rank() OVER (ORDER BY cluster_id) - 1 AS numeric_id FROM o""",
)
def cluster_summary(spark, sf_dir):
    return clusters.summary(V.proposals(spark, sf_dir), "cluster_id")


@query(
    "A05 P32",
    f"""WITH {V.PROP}, k AS (SELECT *, {V.sql_review_coarse("predicted_label")} AS own, {V.sql_review_coarse("coalesce(nullif(human_label, ''), predicted_label)")} AS coarse_group FROM prop),
    c AS (SELECT *, CASE WHEN proposal_id % 20 = 0 THEN 'broken' ELSE own || '_b000_' || CASE WHEN cluster_id < 0 THEN 'noise' ELSE 'c' || lpad(CAST(cluster_id AS VARCHAR), 3, '0') END END AS key FROM k)
    SELECT 'rows' AS "check", count(*) AS n FROM c UNION ALL SELECT 'rows_without_cluster', count(*) FROM c WHERE cluster_id = -1 UNION ALL SELECT 'keys', count(DISTINCT key) FROM c UNION ALL SELECT 'keys_among_unclustered', count(DISTINCT key) FROM c WHERE cluster_id = -1
    UNION ALL SELECT 'malformed_keys', count(*) FROM c WHERE key = 'broken' UNION ALL SELECT 'group_mismatches', count(*) FROM c WHERE key <> 'broken' AND own <> coarse_group""",
)
def cluster_diagnosis(spark, sf_dir):
    p = clusters.coarse_of(V.proposals(spark, sf_dir))
    key = F.when(F.col("proposal_id") % 20 == 0, "broken").otherwise(clusters.cluster_key(L.review_coarse(F.col("predicted_label")), F.lit(0), F.col("cluster_id")))
    return clusters.diagnosis(p.withColumn("cluster_key", key), "cluster_key")


@query(
    "A15 Z38 Z03",
    """SELECT event_type AS label, round(avg(1.0 + (event_id % 7) / 10.0), 3) AS bbox_scale, CAST(round(avg(event_id % 5)) AS BIGINT) AS mask_grow, count(*) AS sample_count FROM events WHERE event_id % 3 = 0 GROUP BY event_type HAVING count(*) >= 1""",
)
def tuning_profile(spark, sf_dir):
    n = F.col("event_id")
    corrections = V.table(spark, sf_dir, "events").select(F.when(n % 3 == 0, "geometry").otherwise("rename").alias("action"), F.col("event_type").alias("label"), (1.0 + (n % 7) / 10.0).alias("bbox_scale"), (n % 5).alias("mask_grow"))
    return aggregates.tuning_profile(corrections)


@query(
    "A16",
    f"""WITH {V.LABELLED}, c AS (SELECT * FROM lab WHERE coarse = 'cookware'), l AS (SELECT video_id, frame_idx, fine, sum(confidence * CASE WHEN lower(trim(raw_label)) IN ('lid', 'pot lid', 'pan lid') THEN 0.92 ELSE 1.18 END) AS w, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(confidence) AS m, count(*) AS n FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY round(w, 6) DESC, fine DESC) AS k FROM l)
    SELECT video_id, frame_idx, max(fine) FILTER (k = 1) AS label, least(0.99, max(m) + 0.04) AS confidence, CAST(sum(n) AS BIGINT) AS members, max(x2) - min(x1) AS width FROM r GROUP BY ALL""",
)
def merged_cookware(spark, sf_dir):
    merged = aggregates.merged_cluster(V.labelled(spark, sf_dir).where("coarse = 'cookware'"), ["video_id", "frame_idx"])
    return merged.select("video_id", "frame_idx", "label", "confidence", "members", G.width(F.col("bbox")).alias("width"))


@query(
    "W01",
    f"""WITH {V.LABELLED}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id) AS rn FROM lab WHERE confirmed AND track_id >= 0),
    w AS (SELECT a.det_id, a.coarse AS last, a.rn, b.coarse AS l, b.confidence AS c, b.rn - greatest(a.rn - 12, 0) AS i, least(a.rn, 12) AS n FROM o a JOIN o b ON a.video_id = b.video_id AND a.track_id = b.track_id AND b.rn BETWEEN a.rn - 11 AND a.rn),
    s AS (SELECT det_id, l, sum(greatest(0.01, c) * i) AS s, min(i) AS first, avg(c) AS usual FROM w GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY s DESC, first) AS k FROM s),
    t AS (SELECT det_id, any_value(last) AS last, any_value(n) AS n, coalesce(max(i) FILTER (l <> last), 0) AS other FROM w GROUP BY det_id), u AS (SELECT w.det_id, avg(c) AS recent FROM w JOIN t USING (det_id) WHERE w.i > t.other GROUP BY w.det_id)
    SELECT t.det_id, CASE WHEN t.last <> b.l AND t.n - t.other >= 3 AND u.recent + 0.05 >= b.usual THEN t.last ELSE b.l END AS smoothed FROM t JOIN b ON t.det_id = b.det_id AND b.k = 1 JOIN u ON t.det_id = u.det_id""",
)
def smoothed_labels(spark, sf_dir):
    return windows.smoothed(V.labelled(spark, sf_dir)).select("det_id", "smoothed")


@query(
    "W02 W10",
    f"""WITH {V.LABELLED}, o AS (SELECT *, lag(coarse) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id) AS before FROM lab WHERE track_id >= 0), r AS (SELECT * FROM o WHERE before IS NULL OR before <> coarse)
    SELECT video_id, track_id, count(*) AS runs, count(*) - 1 AS switches, string_agg(coarse, '>' ORDER BY frame_idx, det_id) AS history FROM r GROUP BY ALL""",
)
def label_runs(spark, sf_dir):
    return windows.runs(V.labelled(spark, sf_dir).where("track_id >= 0"), "coarse")


@query(
    "W05 W11",
    f"""WITH {V.DET}, o AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM det WHERE track_id >= 0 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id))
    SELECT det_id, round(coalesce({V.sql_distance("", "p")}, 0.0), 6) AS motion_px, round(coalesce({V.sql_distance("", "p")}, 0.0) / greatest(1.0, sqrt({V.sql_area("")})), 6) AS motion_norm, CASE WHEN px1 IS NULL THEN NULL ELSE round({V.sql_area("")} / greatest(1.0, {V.sql_area("p")}), 6) END AS area_ratio FROM o""",
)
def track_motion(spark, sf_dir):
    rows = windows.motion(V.detections(spark, sf_dir).where("track_id >= 0"))
    had = F.col("area_ratio")
    return rows.select("det_id", R(F.col("motion_px")).alias("motion_px"), R(F.col("motion_norm")).alias("motion_norm"), R(had).alias("area_ratio"))


@query(
    "W04 T01 T12 W14",
    f"""WITH {V.LABELLED}, r AS (SELECT video_id, frame_idx, det_id, confidence, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, det_id) AS rank FROM lab) SELECT * FROM r WHERE rank <= 3""",
)
def top_per_frame(spark, sf_dir):
    d = V.labelled(spark, sf_dir).select("video_id", "frame_idx", "det_id", "confidence")
    return topk.per_group(d, ["video_id", "frame_idx"], [F.col("confidence").desc(), F.col("det_id")], 3)


@query("W04", f"WITH {V.DET} SELECT track_id, count(*) AS n FROM det WHERE track_id >= 0 GROUP BY track_id ORDER BY n DESC, track_id LIMIT 10")
def longest_tracks(spark, sf_dir):
    return V.detections(spark, sf_dir).where("track_id >= 0").groupBy("track_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "track_id").limit(10)


@query(
    "W08 W09 T06",
    f"""WITH {V.LABELLED}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, coarse ORDER BY confidence DESC, det_id) AS k FROM lab), b AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, det_id) AS m FROM a WHERE k <= 2) SELECT det_id, coarse FROM b WHERE m <= 5""",
)
def nested_caps(spark, sf_dir):
    d = V.labelled(spark, sf_dir)
    order = [F.col("confidence").desc(), F.col("det_id")]
    return windows.capped(windows.capped(d, ["video_id", "frame_idx", "coarse"], order, 2), ["video_id", "frame_idx"], order, 5).select("det_id", "coarse")


@query(
    "W12 V06",
    f"""WITH {V.PROP}, f AS (SELECT predicted_label, cluster_id, min(proposal_id) AS first FROM prop WHERE cluster_id >= 0 GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY predicted_label, first) - 1 AS new_id FROM f)
    SELECT p.proposal_id, coalesce(i.new_id, -1) AS new_id FROM prop p LEFT JOIN i ON p.predicted_label = i.predicted_label AND p.cluster_id = i.cluster_id""",
)
def remapped_clusters(spark, sf_dir):
    return windows.dense_first_seen(V.proposals(spark, sf_dir), ["predicted_label"], "cluster_id", "proposal_id").select("proposal_id", "new_id")


@query(
    "S01 S03 W07",
    f"""WITH {V.DET}, f AS (SELECT video_id, frame_idx, max(confidence) AS change FROM det GROUP BY ALL), h AS (SELECT *, max(CASE WHEN change > 0.98 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS held FROM f)
    SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS frame_id FROM h WHERE frame_idx % 5 = 0 OR (held AND frame_idx % 2 = 0)""",
)
def adaptive_frames(spark, sf_dir):
    f = V.detections(spark, sf_dir).groupBy("video_id", "frame_idx").agg(F.max("confidence").alias("change"))
    return windows.motion_hold(f, "change", 0.98, 5, 2).select("video_id", "frame_idx", "frame_id")


@query(
    "W06",
    f"""WITH {V.LABELLED}, h AS (SELECT *, confidence >= 0.5 AS hit, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id) AS rn FROM lab WHERE track_id >= 0), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY rn) AS island FROM h)
    SELECT det_id, CASE WHEN hit THEN CAST(sum(CAST(hit AS INT)) OVER (PARTITION BY video_id, track_id, island ORDER BY rn) AS BIGINT) ELSE 0 END AS streak FROM g""",
)
def confidence_streaks(spark, sf_dir):
    d = V.labelled(spark, sf_dir).where("track_id >= 0")
    return windows.streaks(d, ["video_id", "track_id"], ["frame_idx", "det_id"], F.col("confidence") >= 0.5).select("det_id", "streak")


@query("T06", f"WITH {V.PROP} SELECT proposal_id, (proposal_id * 1103515245 + 12345) & 2147483647 AS h FROM prop ORDER BY h, proposal_id LIMIT 100")
def random_sample(spark, sf_dir):
    return topk.sampled(V.proposals(spark, sf_dir), "random", 100).select("proposal_id", topk.lcg(F.col("proposal_id")).alias("h"))


@query("T06", f"WITH {V.PROP} SELECT proposal_id, outlier FROM prop ORDER BY outlier DESC, proposal_id LIMIT 100")
def outlier_sample(spark, sf_dir):
    return topk.sampled(V.proposals(spark, sf_dir), "outliers", 100).select("proposal_id", "outlier")


@query(
    "T07",
    f"""WITH {V.PROP}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, proposal_id) - 1 AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM prop) SELECT cluster_id, proposal_id FROM r WHERE rn % greatest(1, n // 6) = 0 AND rn // greatest(1, n // 6) < 6""",
)
def systematic_sample(spark, sf_dir):
    return topk.systematic(V.proposals(spark, sf_dir), ["cluster_id"], [F.col("confidence").desc(), F.col("proposal_id")], 6).select("cluster_id", "proposal_id")


@query("T08 S10 Z19", f"WITH {V.PROP} SELECT proposal_id, predicted_label FROM prop WHERE cluster_id = 3 ORDER BY proposal_id LIMIT 10 OFFSET 10")
def cluster_page(spark, sf_dir):
    return topk.page(V.proposals(spark, sf_dir).where("cluster_id = 3").select("proposal_id", "predicted_label"), [F.col("proposal_id")], 1, 10)


@query(
    "T14 Z30 Z27 Z08",
    f"""WITH {V.DET}, s AS (SELECT det_id, unnest(['cup', 'lid', 'pan', 'pot']) AS label, unnest([0.5, 1.0 - confidence, 1.0 - confidence, confidence]) AS score FROM det), e AS (SELECT *, exp(4 * score) / sum(exp(4 * score)) OVER (PARTITION BY det_id) AS p, row_number() OVER (PARTITION BY det_id ORDER BY score DESC, label) AS n FROM s)
    SELECT det_id, max(label) FILTER (n = 1) AS best, max(label) FILTER (n = 2) AS second, round(max(p) FILTER (n = 1) - max(p) FILTER (n = 2), 6) AS margin FROM e GROUP BY det_id""",
)
def top_two_labels(spark, sf_dir):
    """Softmax over four labels, two of which always tie; ties go to the smaller label."""
    c = F.col("confidence")
    each = (("cup", F.lit(0.5)), ("lid", 1.0 - c), ("pan", 1.0 - c), ("pot", c))
    total = sum(F.exp(4 * score) for _, score in each)
    # equal scores have equal shares, whatever the order of the sum
    scores = F.array(*[F.struct(F.lit(label).alias("label"), (F.exp(4 * score) / total).alias("score")) for label, score in each])
    t = topk.top_two(scores)
    return V.detections(spark, sf_dir).select("det_id", t["best"].alias("best"), t["second"].alias("second"), R(t["margin"]).alias("margin"))


@query(
    "A19 U01",
    f"""WITH {V.PROP}, t AS (SELECT proposal_id FROM prop ORDER BY confidence DESC, proposal_id LIMIT 20), b AS (SELECT proposal_id FROM prop ORDER BY confidence, proposal_id LIMIT 20), l AS (SELECT proposal_id, row_number() OVER (PARTITION BY predicted_label ORDER BY proposal_id) AS n FROM prop)
    SELECT proposal_id FROM t UNION SELECT proposal_id FROM b UNION SELECT proposal_id FROM l WHERE n <= 2""",
)
def diverse_sample(spark, sf_dir):
    p = V.proposals(spark, sf_dir)
    top = p.orderBy(F.col("confidence").desc(), "proposal_id").limit(20).select("proposal_id")
    low = p.orderBy("confidence", "proposal_id").limit(20).select("proposal_id")
    each = topk.per_group(p, ["predicted_label"], [F.col("proposal_id")], 2).select("proposal_id")
    return top.unionByName(low).unionByName(each).distinct()


@query(
    "U05 U07 Z02",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,c' ELSE 'b,c' END AS joined, CASE event_id % 3 WHEN 0 THEN 'a' ELSE '' END AS missing FROM events""",
)
def set_arrays(spark, sf_dir):
    n = F.col("event_id")
    mine = F.when(n % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    other = F.array(F.lit("b"), F.lit("c"))
    return V.table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.array_union(mine, other)).alias("joined"), F.concat_ws(",", F.array_except(mine, other)).alias("missing"))


@query("F05", f"WITH {V.PROP} SELECT proposal_id FROM prop WHERE confidence < 0.5 AND area > 1000")
def quality_filter(spark, sf_dir):
    return filters.quality_filter(V.proposals(spark, sf_dir), confidence_below=0.5, area_above=1000.0).select("proposal_id")


@query(
    "F08 F01",
    f"""WITH {V.PROP}, s AS (SELECT cluster_id, bool_or(status IN ('reviewed', 'unreviewed') AND confidence > 0.9) AS has_one FROM prop GROUP BY ALL) SELECT p.proposal_id FROM prop p JOIN s USING (cluster_id) WHERE (status IN ('reviewed', 'unreviewed') AND confidence > 0.9) OR NOT has_one""",
)
def kept_or_all(spark, sf_dir):
    keep = F.col("status").isin("reviewed", "unreviewed") & (F.col("confidence") > 0.9)
    return filters.kept_or_all(V.proposals(spark, sf_dir), keep, ["cluster_id"]).select("proposal_id")


@query(
    "F06",
    f"""WITH {V.PROP}, l AS (SELECT cluster_id, predicted_label, count(*) AS n FROM prop GROUP BY ALL), p AS (SELECT cluster_id, round(max(n) / sum(n), 6) AS purity FROM l GROUP BY cluster_id), o AS (SELECT cluster_id, avg(outlier) AS o FROM prop GROUP BY cluster_id)
    SELECT 'mixed' AS filter, cluster_id FROM p WHERE purity < 0.65 UNION ALL SELECT 'noise', -1 UNION ALL SELECT 'outliers', cluster_id FROM o WHERE o > 0.7""",
)
def cluster_filters(spark, sf_dir):
    p = V.proposals(spark, sf_dir)
    children = p.withColumn("conflict", F.lit(False))
    s = clusters.summary(p, "cluster_id").withColumns({"review_status": F.lit("unreviewed"), "coarse_group": L.review_coarse(F.col("display_label"))})
    out = None
    for name in ("mixed", "noise", "outliers"):
        part = clusters.matching(s, children, name).select(F.lit(name).alias("filter"), "cluster_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "F09 F10 F11 F12 F13 F14 F16",
    f"""WITH {V.DET}, m AS (SELECT *, {V.sql_area("")} / 208000.0 AS ratio, greatest(greatest(1.0, x2 - x1) / greatest(1.0, y2 - y1), greatest(1.0, y2 - y1) / greatest(1.0, x2 - x1)) AS aspect FROM det),
    f AS (SELECT *, NOT (confidence > 0.82 OR {V.sql_area("")} / 100 < 50 OR (det_id % 10) / 10.0 > 0.80) AS mask_ok, CAST(ratio < 0.03 AS INT) + CAST(aspect > 2.5 AS INT) AS n FROM m)
    SELECT det_id, ratio <= 0.40 AND aspect BETWEEN 0.125 AND 8.0 AS rescue_ok, mask_ok, round(greatest(0.0, least(1.0, 0.8 - 0.18 * n + CASE WHEN confidence >= 0.5 THEN 0.05 ELSE -0.05 END)), 6) AS objectness,
        concat_ws(',', CASE WHEN confidence < 0.35 THEN 'low_appearance' END, CASE WHEN aspect > 2.5 AND confidence < 0.75 THEN 'size_ratio' END) AS gates FROM f""",
)
def gate_chain(spark, sf_dir):
    b, c = F.col("bbox"), F.col("confidence")
    ratio, aspect = G.area(b) / float(V.FRAME_W * V.FRAME_H), G.aspect(b)
    flags = F.array_compact(F.array(F.when(ratio < 0.03, "tiny"), F.when(aspect > 2.5, "aspect")))
    score, _ = filters.objectness(flags, c)
    return V.detections(spark, sf_dir).select(
        "det_id",
        ((ratio <= 0.40) & aspect.between(0.125, 8.0)).alias("rescue_ok"),
        filters.valid_mask(c, G.area(b) / 100, (F.col("det_id") % 10) / 10.0).alias("mask_ok"),
        R(score).alias("objectness"),
        F.concat_ws(",", filters.hard_gate_reasons(c, aspect, F.lit(0.0), F.lit(0.0), F.lit(False))).alias("gates"),
    )


@query(
    "F17 A21",
    """WITH i AS (SELECT l_linenumber AS class_id, l_orderkey AS image_id FROM lineitem), c AS (SELECT i AS class_id FROM range(10) t(i)), n AS (SELECT class_id, count(*) AS instances, count(DISTINCT image_id) AS images FROM i GROUP BY ALL)
    SELECT CAST(class_id AS INT) AS class_id, coalesce(instances, 0) AS instances, coalesce(images, 0) AS images, CASE WHEN coalesce(instances, 0) = 0 THEN 'none' WHEN instances < 300 THEN 'rare' ELSE 'ok' END AS state FROM c LEFT JOIN n USING (class_id)""",
)
def class_balance(spark, sf_dir):
    i = V.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("class_id"), F.col("l_orderkey").alias("image_id"))
    return filters.class_balance(i, spark.range(10).select(F.col("id").cast("int").alias("class_id")))
