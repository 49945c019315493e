"""Order-dependent operators, relations, masks and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G
from frameloom.functions import labels as L
from frameloom.operators import masks, perframe, relations
from frameloom.plans import views as V
from frameloom.plans import summary_queries  # noqa: F401  its SQL is used again
from frameloom.plans.catalog import REGISTRY, query
from frameloom.sinks import writers
from frameloom.streaming import frames, steps

R = lambda c: F.round(c, 6)
VIDEO = ["video_id"]


def flat(spark, sf_dir):
    """Labelled detections with the box as four columns."""
    d = V.labelled(spark, sf_dir)
    return d.select("det_id", "video_id", "frame_idx", "raw_label", "coarse", "source", "track_id", "confidence", "confirmed", "fine", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")


IDS = "det_id bigint, video_id bigint, frame_idx bigint"


_CONFLICT = f"{V.sql_in('lower(trim(a.raw_label))', T.COOKWARE_BODIES + T.COOKWARE_LIDS)} AND {V.sql_in('lower(trim(b.raw_label))', T.COOKWARE_BODIES + T.COOKWARE_LIDS)} AND lower(trim(a.raw_label)) <> lower(trim(b.raw_label))"


def _greedy(order: str, removes: str, never: str = "FALSE", source: str = "lab") -> str:
    """SQL of a greedy choice: rows of a frame in an order; ``removes`` says when a row a that stays removes a later b, ``never`` which rows a row b of any place removes."""
    return f"""WITH RECURSIVE {V.LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY {order}) AS k FROM {source}),
    e AS (SELECT b.video_id, b.frame_idx, b.k, list(a.k) FILTER (a.k < b.k AND {removes}) AS before, coalesce(bool_or({never}), FALSE) AS never FROM r a JOIN r b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx GROUP BY ALL),
    fold(video_id, frame_idx, k, kept) AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r UNION ALL
        SELECT f.video_id, f.frame_idx, e.k, CASE WHEN e.never OR list_has_any(f.kept, coalesce(e.before, [])) THEN f.kept ELSE list_append(f.kept, e.k) END FROM fold f JOIN e ON e.video_id = f.video_id AND e.frame_idx = f.frame_idx AND e.k = f.k + 1),
    done AS (SELECT video_id, frame_idx, max_by(kept, k) AS kept FROM fold GROUP BY ALL)"""


@query("T04 T05", f"{_greedy('confidence DESC, det_id', f'{V.sql_iou("a.", "b.")} >= CASE WHEN {_CONFLICT} THEN 0.82 ELSE 0.45 END')} SELECT det_id, video_id, frame_idx, confidence FROM r JOIN done USING (video_id, frame_idx) WHERE list_contains(kept, k)")
def suppressed_boxes(spark, sf_dir):
    return perframe.suppressed(flat(spark, sf_dir))


@query("T03", f"{_greedy(V.sql_area('') + ' DESC, det_id', f'({V.sql_iou("a.", "b.")} >= 0.45 OR {V.sql_overlap("a.", "b.")} >= 0.8)')} SELECT det_id, video_id, frame_idx FROM r JOIN done USING (video_id, frame_idx) WHERE list_position(kept, k) <= 4")
def diverse_boxes(spark, sf_dir):
    return perframe.diverse(flat(spark, sf_dir))


_KIND = "CASE WHEN {0} IN ('pot', 'cooking pot', 'saucepan', 'pan', 'frying pan', 'cookware') THEN 'body' WHEN {0} IN ('lid', 'pot lid', 'pan lid') THEN 'lid' ELSE {0} END"
_COVERS = f"({V.sql_in('b.source', T.TEMPORAL_SOURCES)} AND {_KIND.format('lower(a.coarse)')} = {_KIND.format('lower(b.coarse)')} AND {V.sql_iou('a.', 'b.')} >= 0.45 AND ({V.sql_rank('a.source', T.SOURCE_RANK)}, a.confidence) > ({V.sql_rank('b.source', T.SOURCE_RANK)}, b.confidence))"


@query("J11 F04", f"{_greedy('det_id', _COVERS, f'a.k > b.k AND {_COVERS}')} SELECT det_id, video_id, frame_idx, source FROM r JOIN done USING (video_id, frame_idx) WHERE list_contains(kept, k)")
def redundant_dropped(spark, sf_dir):
    return perframe.without_redundant(flat(spark, sf_dir))


def _side(x: str) -> str:
    """Columns of one row of a pair, named with its letter in front."""
    names = {"id": "det_id", "g": "lower(coarse)", "raw": "raw_label", "c": "confidence", "conf": "coalesce(confirmed, FALSE)", "seen": "CASE WHEN track_id >= 0 THEN 2 ELSE 1 END", "strong": f"CAST({V.sql_in('source', T.STRONG_SOURCES)} AS INT)", "rank": V.sql_rank("source", T.SOURCE_RANK), "group": V.sql_rank("lower(coarse)", T.GROUP_RANK),
             "long": "greatest(greatest(1.0, x2 - x1) / greatest(1.0, y2 - y1), greatest(1.0, y2 - y1) / greatest(1.0, x2 - x1)) >= 2.2"}
    return ", ".join(f"{expression} AS {x}_{name}" for name, expression in names.items())


_SOLID = "('cookware', 'dishware', 'appliance')"
_BETTER = "(b_g = 'dishware' AND a_g = 'cookware' AND ((a_c >= 0.30 AND b_c < a_c + 0.20) OR (sa, a_strong, a_group, a_c) >= (sb, b_strong, b_group, b_c)))"
_WORSE = "(a_g = 'dishware' AND b_g = 'cookware' AND ((b_c >= 0.30 AND a_c < b_c + 0.20) OR (sb, b_strong, b_group, b_c) >= (sa, a_strong, a_group, a_c)))"


@query(
    "J10 Z01 Z02 F03 F04",
    f"""WITH RECURSIVE {V.LABELLED}, l AS (SELECT *, {_side("a")} FROM lab), r AS (SELECT *, {_side("b")} FROM lab),
    p AS (SELECT a.video_id, a.frame_idx, {", ".join(f"{x}_{n}" for x in "ab" for n in ("id", "g", "raw", "c", "conf", "seen", "strong", "rank", "group", "long"))}, row_number() OVER (PARTITION BY a.video_id, a.frame_idx ORDER BY a.det_id, b.det_id) AS k
        FROM l a JOIN r b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id WHERE ({V.sql_iou("a.", "b.")} >= 0.60 OR {V.sql_containment("a.", "b.")} >= 0.70) AND (a_g = b_g OR (a_g <> 'hand' AND b_g <> 'hand'))),
    fold(video_id, frame_idx, k, cur, cur_gone, cur_conf, gone, weak, notes) AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), FALSE, FALSE, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS STRUCT(w BIGINT, t VARCHAR)[]) FROM p UNION ALL
        SELECT video_id, frame_idx, k, a_id, cg, cc, CASE WHEN active AND NOT doubt THEN list_append(gone, loser) ELSE gone END, CASE WHEN active AND doubt THEN list_append(weak, loser) ELSE weak END,
            CASE WHEN active AND (doubt OR a_g <> b_g OR a_raw <> b_raw) THEN list_append(notes, {{'w': winner, 't': trim(CASE WHEN loser = a_id THEN a_raw ELSE b_raw END)}}) ELSE notes END FROM (
            SELECT *, da OR db AS doubt, CASE WHEN da THEN b_id WHEN db THEN a_id WHEN wins THEN a_id ELSE b_id END AS winner, CASE WHEN da THEN a_id WHEN db THEN b_id WHEN wins THEN b_id ELSE a_id END AS loser FROM (
                SELECT *, a_g = 'utensil' AND b_g IN {_SOLID} AND a_c < 0.60 AND NOT (a_long AND sa >= 1) AS da, b_g = 'utensil' AND a_g IN {_SOLID} AND b_c < 0.60 AND NOT (b_long AND sb >= 1) AS db,
                    CASE WHEN {_BETTER} THEN TRUE WHEN {_WORSE} THEN FALSE ELSE (sa, a_strong, a_rank, a_group, a_c) >= (sb, b_strong, b_rank, b_group, b_c) END AS wins, NOT cg AND NOT list_contains(gone, b_id) AS active FROM (
                    SELECT *, CASE WHEN cc THEN a_seen ELSE 0 END AS sa, CASE WHEN b_conf AND NOT list_contains(weak, b_id) THEN b_seen ELSE 0 END AS sb FROM (
                        SELECT p.*, f.gone, f.weak, f.notes, CASE WHEN p.a_id <> f.cur THEN list_contains(f.gone, p.a_id) ELSE f.cur_gone END AS cg, CASE WHEN p.a_id <> f.cur THEN p.a_conf AND NOT list_contains(f.weak, p.a_id) ELSE f.cur_conf END AS cc
                        FROM fold f JOIN p ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx AND p.k = f.k + 1))))),
    done AS (SELECT video_id, frame_idx, max_by(gone, k) AS gone, max_by(weak, k) AS weak, max_by(notes, k) AS notes FROM fold GROUP BY ALL),
    told AS (SELECT w, t, min(i) AS i FROM (SELECT n.w AS w, n.t AS t, i FROM (SELECT unnest(notes) AS n, unnest(range(len(notes))) AS i FROM done)) GROUP BY ALL)
    SELECT lab.det_id, video_id, frame_idx, coarse, coalesce(confirmed, FALSE) AND NOT coalesce(list_contains(weak, lab.det_id), FALSE) AS confirmed, coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM told WHERE told.w = lab.det_id), '') AS alternatives
    FROM lab LEFT JOIN done USING (video_id, frame_idx) WHERE NOT coalesce(list_contains(gone, lab.det_id), FALSE)""",
)
def conflicts_resolved(spark, sf_dir):
    return perframe.resolved(flat(spark, sf_dir))


_POT = f"{V.sql_in('lower(trim(raw_label))', T.COOKWARE_BODIES)}"
_LID = f"{V.sql_in('lower(trim(raw_label))', T.COOKWARE_LIDS)}"


@query(
    "V15",
    f"""WITH RECURSIVE {V.LABELLED}, r AS (SELECT *, CASE WHEN {_POT} THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) AS k FROM lab WHERE {_POT} OR {_LID}),
    e AS (SELECT b.video_id, b.frame_idx, b.k, list(a.k) FILTER (a.k < b.k AND {V.sql_iou("a.", "b.")} >= 0.35) AS near FROM r a JOIN r b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx GROUP BY ALL),
    fold(video_id, frame_idx, k, label) AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r UNION ALL
        SELECT f.video_id, f.frame_idx, e.k, list_append(f.label, coalesce(list_min(list_transform(e.near, lambda x: f.label[x])), e.k)) FROM fold f JOIN e ON e.video_id = f.video_id AND e.frame_idx = f.frame_idx AND e.k = f.k + 1),
    g AS (SELECT video_id, frame_idx, max_by(label, k) AS label FROM fold GROUP BY ALL), c AS (SELECT r.*, label[k] AS cluster, count(*) OVER (PARTITION BY video_id, frame_idx, label[k]) AS crowd FROM r JOIN g USING (video_id, frame_idx)),
    h AS (SELECT DISTINCT c.video_id, c.frame_idx, c.cluster FROM c JOIN lab b ON c.video_id = b.video_id AND c.frame_idx = b.frame_idx AND lower(trim(b.raw_label)) = 'hand' WHERE {V.sql_iou("c.", "b.")} >= 0.05),
    m AS (SELECT *, lead(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id) AS after FROM lab WHERE track_id >= 0),
    l AS (SELECT c.det_id, max({V.sql_iou("c.", "m.")}) AS recent FROM c JOIN m ON m.video_id = c.video_id AND c.frame_idx - m.frame_idx BETWEEN 1 AND 2 AND c.frame_idx <= coalesce(m.after, c.frame_idx) WHERE c.kind = 2 AND m.fine IN ('lid', 'pot lid', 'pan lid') GROUP BY ALL),
    s AS (SELECT c.*, row_number() OVER (PARTITION BY c.video_id, c.frame_idx, c.cluster, kind ORDER BY confidence + CASE WHEN kind = 2 AND crowd > 1 AND h.cluster IS NOT NULL THEN 0.08 ELSE 0.0 END + CASE WHEN kind = 2 THEN 0.12 * coalesce(recent, 0.0) ELSE 0.0 END DESC, det_id) AS place
        FROM c LEFT JOIN h ON h.video_id = c.video_id AND h.frame_idx = c.frame_idx AND h.cluster = c.cluster LEFT JOIN l USING (det_id))
    SELECT det_id, video_id, frame_idx, raw_label FROM s WHERE place = 1 UNION ALL SELECT det_id, video_id, frame_idx, raw_label FROM lab WHERE NOT ({_POT} OR {_LID})""",
)
def cookware_clusters(spark, sf_dir):
    return perframe.best_cookware(flat(spark, sf_dir))


@query(
    "V14",
    f"""WITH RECURSIVE {V.LABELLED}, c AS (SELECT * FROM lab WHERE {V.sql_in("lower(trim(raw_label))", T.COOKWARE_BODIES + T.COOKWARE_LIDS)}),
    e AS (SELECT a.det_id AS x, b.det_id AS y FROM c a JOIN c b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx WHERE {V.sql_overlap("a.", "b.")} >= 0.28),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS det_id, min(y) AS component FROM r GROUP BY x""",
)
def overlap_components(spark, sf_dir):
    return perframe.cookware_components(flat(spark, sf_dir)).select("det_id", "component")


@query(
    "X03",
    f"""WITH RECURSIVE {V.LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, det_id) AS k, {{'c': coarse, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b FROM lab),
    fold(video_id, k, tracks, det_id, frame_idx, assigned) AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(c VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM r UNION ALL
        SELECT video_id, k, CASE WHEN own > len(tracks) THEN list_append(tracks, b) ELSE list_transform(tracks, lambda t, i: CASE WHEN i = own THEN b ELSE t END) END, det_id, frame_idx, own FROM (
            SELECT *, CASE WHEN best.s >= 0.25 THEN -best.i ELSE len(tracks) + 1 END AS own FROM (
                SELECT f.video_id, r.k, f.tracks, r.det_id, r.frame_idx, r.b, list_max(list_transform(f.tracks, lambda t, i: {{'s': CASE WHEN t.c = r.coarse THEN {V.sql_iou("r.", "t.")} ELSE -1.0 END, 'i': -i}})) AS best FROM fold f JOIN r ON r.video_id = f.video_id AND r.k = f.k + 1)))
    SELECT det_id, video_id, frame_idx, assigned FROM fold WHERE det_id IS NOT NULL""",
)
def simple_tracks(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.SimpleTracker, f"{IDS}, assigned bigint", VIDEO)


@query("X02 X18 X19 J15 Z23")
def two_stage_tracks(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.TwoStageTracker, f"{IDS}, assigned bigint", VIDEO)


_SEEN = "STRUCT(t BIGINT, f BIGINT, c VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]"


@query(
    "J04 X17",
    f"""WITH RECURSIVE {V.LABELLED}, q AS (SELECT video_id, frame_idx, list(track_id) AS present FROM lab GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, det_id) AS k FROM lab JOIN q USING (video_id, frame_idx)),
    fold(video_id, k, seen, pending, used, det_id, frame_idx, track_id, reassigned) AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT), CAST([] AS {_SEEN}), CAST([] AS {_SEEN}), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), FALSE FROM lab UNION ALL
        SELECT video_id, k, now, CASE WHEN own >= 0 THEN list_append(list_filter(held, lambda p: p.t <> own), {{'t': own, 'f': frame_idx, 'c': coarse, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE held END, CASE WHEN found IS NOT NULL THEN list_append(taken, found) ELSE taken END, det_id, frame_idx, own, found IS NOT NULL FROM (
            SELECT *, coalesce(found, track_id) AS own FROM (SELECT *, CASE WHEN best.s >= 0.35 THEN -best.t END AS found FROM (
                SELECT *, list_max(list_transform(list_filter(now, lambda s: NOT list_contains(taken, s.t) AND NOT list_contains(present, s.t) AND s.c = coarse AND frame_idx - s.f BETWEEN 1 AND 4), lambda s: {{'s': {V.sql_iou("u.", "s.")}, 't': -s.t}})) AS best FROM (
                    SELECT r.*, CASE WHEN f.frame_idx = r.frame_idx THEN f.seen ELSE list_concat(list_filter(f.seen, lambda s: NOT list_contains(list_transform(f.pending, lambda p: p.t), s.t) AND r.frame_idx - s.f <= 4), f.pending) END AS now,
                        CASE WHEN f.frame_idx = r.frame_idx THEN f.pending ELSE CAST([] AS {_SEEN}) END AS held, CASE WHEN f.frame_idx = r.frame_idx THEN f.used ELSE CAST([] AS BIGINT[]) END AS taken FROM fold f JOIN r ON r.video_id = f.video_id AND r.k = f.k + 1) u))))
    SELECT det_id, video_id, frame_idx, track_id, reassigned FROM fold WHERE det_id IS NOT NULL""",
)
def reassigned_tracks(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.Reassign, f"{IDS}, track_id bigint, reassigned boolean", VIDEO)


_TRACK_ORDER = "(PARTITION BY video_id, track_id ORDER BY frame_idx, det_id)"
_ABSENT = "NOT EXISTS (SELECT 1 FROM lab p WHERE p.video_id = f.video_id AND p.frame_idx = f.frame_idx AND p.track_id = o.track_id)"


@query(
    "X04 X06 X11",
    f"""WITH {V.LABELLED}, f AS (SELECT DISTINCT video_id, frame_idx FROM lab), o AS (SELECT *, lead(frame_idx) OVER {_TRACK_ORDER} AS after, CASE coarse WHEN 'hand' THEN 5 WHEN 'cookware' THEN 4 ELSE 3 END AS most FROM lab WHERE confirmed AND track_id >= 0),
    lost AS (SELECT DISTINCT o.det_id FROM o JOIN f ON f.video_id = o.video_id AND f.frame_idx > o.frame_idx + o.most AND f.frame_idx < o.after WHERE {_ABSENT}),
    b AS (SELECT *, lag(det_id IN (SELECT det_id FROM lost), 1, FALSE) OVER {_TRACK_ORDER} AS anew FROM o), c AS (SELECT *, sum(CAST(anew AS INT)) OVER {_TRACK_ORDER} AS life FROM b),
    s AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id, life ORDER BY frame_idx, det_id) AS stable FROM c),
    e AS (SELECT o.det_id, o.video_id, f.frame_idx, o.track_id, coarse, f.frame_idx - o.frame_idx AS age, greatest(0.05, confidence * pow(0.92, f.frame_idx - o.frame_idx)) AS confidence FROM s o JOIN f ON f.video_id = o.video_id AND f.frame_idx > o.frame_idx AND f.frame_idx <= o.frame_idx + o.most AND (o.after IS NULL OR f.frame_idx < o.after)
        WHERE {_ABSENT} AND stable >= 2 AND confidence >= CASE coarse WHEN 'hand' THEN 0.18 - 0.04 ELSE 0.18 END)
    SELECT det_id, video_id, frame_idx, track_id, 'track_persist' AS source, round(confidence, 6) AS confidence, age <= CASE coarse WHEN 'hand' THEN 4 ELSE 2 END AND confidence >= 0.16 AS confirmed, CAST(age AS INT) AS persisted_age FROM e
    UNION ALL SELECT det_id, video_id, frame_idx, track_id, source, round(confidence, 6), confirmed, 0 FROM lab""",
)
def persisted_rows(spark, sf_dir):
    rows = frames.by_frame(flat(spark, sf_dir), steps.Persist, f"{IDS}, track_id bigint, source string, confidence double, confirmed boolean, persisted_age int", VIDEO)
    return rows.withColumn("confidence", R(F.col("confidence")))


@query(
    "X08 U06",
    f"""WITH {V.LABELLED}, f AS (SELECT *, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS before FROM (SELECT DISTINCT video_id, frame_idx FROM lab)), h AS (SELECT video_id, frame_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lab WHERE coarse = 'hand' GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, track_id ORDER BY det_id DESC) AS n FROM lab WHERE coarse <> 'hand' AND confirmed AND track_id >= 0),
    a AS (SELECT f.video_id, f.frame_idx, t.track_id FROM f JOIN h ON h.video_id = f.video_id AND h.frame_idx = f.frame_idx JOIN t ON t.video_id = f.video_id AND t.frame_idx = f.before AND t.n = 1 WHERE {V.sql_iou("h.", "t.")} >= 0.15 OR {V.sql_containment("h.", "t.")} >= 0.40),
    c AS (SELECT f.video_id, f.frame_idx, count(DISTINCT a.track_id) >= 3 AS hit FROM f LEFT JOIN a ON a.video_id = f.video_id AND a.frame_idx = f.frame_idx GROUP BY ALL),
    l AS (SELECT *, max(CASE WHEN hit THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS last FROM c), g AS (SELECT *, sum(CAST(NOT hit AND (last IS NULL OR frame_idx > last + 8) AS INT)) OVER (PARTITION BY video_id ORDER BY frame_idx) AS part FROM l),
    x AS (SELECT g.video_id, g.part, g.frame_idx, a.track_id FROM g JOIN a ON a.video_id = g.video_id AND a.frame_idx = g.frame_idx WHERE g.hit)
    SELECT g.video_id, g.frame_idx, coalesce(g.frame_idx <= any_value(g.last) + 8, FALSE) AS occluded, CAST(count(DISTINCT x.track_id) AS INT) AS affected FROM g LEFT JOIN x ON x.video_id = g.video_id AND x.part = g.part AND x.frame_idx <= g.frame_idx GROUP BY g.video_id, g.frame_idx""",
)
def occlusion_states(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.Occlusion, "video_id bigint, frame_idx bigint, occluded boolean, affected int", VIDEO)


@query(
    "J14 D18",
    f"""WITH RECURSIVE {V.DET}, s AS (SELECT *, (det_id // 4) % 2 = 0 AS is_left FROM det), p AS (SELECT a.video_id, a.frame_idx, a.det_id AS x, b.det_id AS y, {V.sql_iou("a.", "b.")} AS iou, {V.sql_containment("a.", "b.")} AS inside, {V.sql_distance("a.", "b.")} AS far FROM s a JOIN s b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.is_left AND NOT b.is_left),
    e AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY iou DESC, inside DESC, far, x, y) AS k FROM p WHERE iou >= 0.5 OR inside >= 0.8),
    fold(video_id, frame_idx, k, used, chosen) AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM e UNION ALL
        SELECT f.video_id, f.frame_idx, e.k, CASE WHEN list_has_any(f.used, [e.x, e.y]) THEN f.used ELSE list_concat(f.used, [e.x, e.y]) END, CASE WHEN list_has_any(f.used, [e.x, e.y]) THEN f.chosen ELSE list_append(f.chosen, e.k) END FROM fold f JOIN e ON e.video_id = f.video_id AND e.frame_idx = f.frame_idx AND e.k = f.k + 1),
    g AS (SELECT video_id, frame_idx, max_by(chosen, k) AS chosen FROM fold GROUP BY ALL), m AS (SELECT e.* FROM e JOIN g USING (video_id, frame_idx) WHERE list_contains(chosen, k))
    SELECT video_id, frame_idx, x AS left_id, y AS right_id, iou FROM m UNION ALL SELECT video_id, frame_idx, CASE WHEN is_left THEN det_id END, CASE WHEN NOT is_left THEN det_id END, 0.0 FROM s WHERE det_id NOT IN (SELECT x FROM m) AND det_id NOT IN (SELECT y FROM m)""",
)
def matched_detectors(spark, sf_dir):
    return perframe.matched_sides(flat(spark, sf_dir), F.floor(F.col("det_id") / 4) % 2 == 0)


_CANONICAL = "CASE lower(trim(raw_label)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SCENE_CANONICAL.items()) + " ELSE lower(trim(raw_label)) END"


@query(
    "A17 X12",
    f"""WITH RECURSIVE {V.LABELLED}, r AS (SELECT *, {_CANONICAL} AS name, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, det_id) AS k FROM lab WHERE {V.sql_in("lower(trim(raw_label))", T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS)}),
    fold(video_id, frame_idx, k, boxes) AS (SELECT DISTINCT video_id, frame_idx, CAST(0 AS BIGINT), CAST([] AS STRUCT(name VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, confidence DOUBLE, members INT)[]) FROM r UNION ALL
        SELECT video_id, frame_idx, k, CASE WHEN home = 0 THEN list_append(boxes, {{'name': name, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'confidence': confidence, 'members': 1}})
            ELSE list_transform(boxes, lambda b, i: CASE WHEN i = home THEN {{'name': b.name, 'x1': least(b.x1, x1), 'y1': least(b.y1, y1), 'x2': greatest(b.x2, x2), 'y2': greatest(b.y2, y2), 'confidence': greatest(b.confidence, confidence), 'members': b.members + 1}} ELSE b END) END FROM (
            SELECT r.*, f.boxes, coalesce(list_position(list_transform(f.boxes, lambda b: b.name = r.name AND ({V.sql_iou("b.", "r.")} >= 0.55 OR {V.sql_overlap("b.", "r.")} >= 0.82)), TRUE), 0) AS home FROM fold f JOIN r ON r.video_id = f.video_id AND r.frame_idx = f.frame_idx AND r.k = f.k + 1)),
    last AS (SELECT video_id, frame_idx, max_by(boxes, k) AS boxes FROM fold GROUP BY ALL), done AS (SELECT video_id, frame_idx, unnest(boxes) AS b FROM last) SELECT video_id, frame_idx, b.name AS label, b.confidence AS confidence, CAST(b.members AS INT) AS members FROM done""",
)
def merged_scenes(spark, sf_dir):
    return perframe.merged_scenes(flat(spark, sf_dir).where(L.is_scene(F.col("raw_label"))))


@query(
    "T09 T10",
    f"""WITH RECURSIVE {V.DET}, t AS (SELECT video_id, track_id, list({{'f': frame_idx, 'c': confidence, 'd': det_id}}) AS members FROM det WHERE track_id >= 0 GROUP BY ALL),
    fold(video_id, track_id, members, chosen, ids, n) AS (SELECT video_id, track_id, members, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0 FROM t UNION ALL
        SELECT video_id, track_id, members, list_append(chosen, best.f), list_append(ids, -best.d), n + 1 FROM (SELECT *, list_max(list_transform(list_filter(members, lambda x: len(chosen) = 0 OR list_min(list_transform(chosen, lambda c: abs(x.f - c))) >= 3),
            lambda x: {{'s': 0.7 * x.c + 0.3 * least(1.0, coalesce(list_min(list_transform(chosen, lambda c: abs(x.f - c))), 20) / 20.0), 'd': -x.d, 'f': x.f}})) AS best FROM fold WHERE n < 8) WHERE best IS NOT NULL),
    last AS (SELECT video_id, track_id, max_by(ids, n) AS ids FROM fold GROUP BY ALL), done AS (SELECT video_id, track_id, unnest(ids) AS det_id, unnest(range(len(ids))) AS place FROM last) SELECT det_id, video_id, frame_idx, track_id, CAST(place AS INT) AS place FROM done JOIN (SELECT det_id, frame_idx FROM det) USING (det_id)""",
)
def track_representatives(spark, sf_dir):
    return perframe.representatives(flat(spark, sf_dir).where("track_id >= 0"))


@query("W01 X01 D11", f"SELECT event_id AS det_id, event_id % 4 AS video_id, CAST(floor(event_id / 40) AS BIGINT) AS frame_idx, s.smoothed FROM events LEFT JOIN ({REGISTRY['smoothed_labels'].sql}) s ON s.det_id = event_id")
def smoothed_step(spark, sf_dir):
    return frames.by_frame(flat(spark, sf_dir), steps.Smooth, f"{IDS}, smoothed string", VIDEO)


_SCENE = T.SCENE_SUPPORTS + T.SCENE_BACKGROUNDS
_OVERLAP = V.sql_iou("a.", "b.")
_FAR = V.sql_distance("a.", "b.")


def _nearest(name: str, columns: str, where: str, order: str) -> str:
    return f"{name} AS (SELECT a.det_id, {columns}, row_number() OVER (PARTITION BY a.det_id ORDER BY {order} DESC, b.det_id) AS n FROM obj a JOIN lab b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id <> b.det_id WHERE {where})"


#: Confirmed objects with their hand, surface and cookware, for a WITH clause.
_SNAPSHOT = f"""{V.LABELLED}, obj AS (SELECT * FROM lab WHERE coarse <> 'hand' AND NOT {V.sql_in("lower(trim(raw_label))", _SCENE)} AND confirmed AND track_id >= 0),
    {_nearest("h", f"b.det_id AS hand_id, {_OVERLAP} AS hand_iou, {_FAR} AS far, {V.sql_area('b.')} AS hand_area", "lower(trim(b.raw_label)) = 'hand'", f"{_OVERLAP} - {_FAR} / greatest(1.0, sqrt({V.sql_area('a.')}))")},
    {_nearest("s", f"CASE WHEN {V.sql_in('lower(trim(b.raw_label))', T.SCENE_SUPPORTS)} THEN 'support_surface' ELSE 'background_surface' END AS surface, {_OVERLAP} AS surface_iou", f"{V.sql_in('lower(trim(b.raw_label))', _SCENE)} AND {_OVERLAP} > 0", _OVERLAP)},
    {_nearest("c", f"b.det_id AS cookware_id, {_OVERLAP} AS cookware_iou", f"{V.sql_in('lower(trim(b.raw_label))', T.COOKWARE_BODIES)} AND {V.sql_in('lower(trim(a.fine))', T.COOKWARE_LIDS + T.PLATE_PROXIES)} AND {_OVERLAP} >= 0.12 AND greatest(1.0, {V.sql_area('a.')}) / greatest(1.0, {V.sql_area('b.')}) BETWEEN 0.08 AND 1.20 AND {_FAR} <= greatest(18.0, {V.sql_diagonal('b.')} * 0.38)", _OVERLAP)},
    snap AS (SELECT o.*, hand_id, hand_iou, surface, surface_iou, cookware_id, cookware_iou, m.free, coalesce(m.free AND (hand_iou >= 0.03 OR far <= greatest(14.0, sqrt({V.sql_area('o.')}) * 0.45)) AND greatest(1.0, {V.sql_area('o.')}) / greatest(1.0, hand_area) <= 4.5 AND hand_iou >= 0.06, FALSE) AS attached
        FROM obj o JOIN (SELECT det_id, {V.sql_in("lower(trim(coarse))", T.MANIPULABLE)} OR {V.sql_in("lower(trim(fine))", T.COOKWARE_LIDS + T.PLATE_PROXIES)} AS free FROM obj) m USING (det_id) LEFT JOIN h ON h.det_id = o.det_id AND h.n = 1 LEFT JOIN s ON s.det_id = o.det_id AND s.n = 1 LEFT JOIN c ON c.det_id = o.det_id AND c.n = 1)"""


@query(
    "J08 J09",
    f"""WITH {_SNAPSHOT} SELECT det_id, 'hand_object' AS type, CAST(hand_id AS VARCHAR) AS other, round(hand_iou, 6) AS strength FROM snap WHERE hand_id IS NOT NULL UNION ALL SELECT det_id, 'object_scene', surface, round(surface_iou, 6) FROM snap WHERE surface IS NOT NULL
    UNION ALL SELECT det_id, 'object_cookware', CAST(cookware_id AS VARCHAR), round(cookware_iou, 6) FROM snap WHERE cookware_id IS NOT NULL""",
)
def relation_rows(spark, sf_dir):
    return relations.relation_rows(relations.snapshot(V.labelled(spark, sf_dir))).withColumn("strength", R(F.col("strength")))


_ROWS = "OVER (PARTITION BY video_id, track_id ORDER BY frame_idx, det_id)"
_CANDIDATES = {
    "pick_candidate": "free AND attached AND NOT was",
    "lift_candidate": "free AND attached AND before >= 0.18 AND now < greatest(0.10, before * 0.65)",
    "place_candidate": "free AND was AND NOT attached AND coalesce(surface, '') = 'support_surface'",
    "cover_candidate": f"{V.sql_in('lower(trim(fine))', T.COOKWARE_LIDS + T.PLATE_PROXIES)} AND NOT attached AND now >= 0.18 AND was",
}


@query(
    "W06",
    f"""WITH {_SNAPSHOT}, w AS (SELECT *, coalesce(lag(attached) {_ROWS}, FALSE) AS was, coalesce(lag(cookware_iou) {_ROWS}, 0.0) AS before, coalesce(cookware_iou, 0.0) AS now, row_number() {_ROWS} AS k FROM snap),
    u AS ({" UNION ALL ".join(f"SELECT *, '{name}' AS type, {test} AS hit FROM w" for name, test in _CANDIDATES.items())}),
    z AS (SELECT *, k - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY type, video_id, track_id ORDER BY k), 0) AS streak FROM u) SELECT det_id, video_id, frame_idx, track_id, type, streak FROM z WHERE hit""",
)
def event_candidates(spark, sf_dir):
    return relations.events(relations.snapshot(V.labelled(spark, sf_dir)), since_transition=True)


@query(
    "M01 M02 F12 X10",
    f"""WITH {V.DET}, p AS (SELECT a.det_id AS a_id, b.det_id AS b_id, {V.sql_intersection("a.", "b.")} AS i, {V.sql_area("a.")} AS aa, {V.sql_area("b.")} AS ba FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_id < b.det_id)
    SELECT a_id, b_id, CAST(i AS BIGINT) AS common, round(i / (aa + ba - i), 6) AS iou FROM p WHERE i > 0""",
)
def mask_overlaps(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumn("runs", masks.of_box(F.col("bbox"), V.FRAME_W))
    return perframe.mask_pairs(d, V.FRAME_W).withColumn("iou", R(F.col("iou")))


@query(
    "M01 M06 G06",
    f"""WITH {V.DET} SELECT det_id, CAST({V.sql_area("")} AS BIGINT) AS pixels, x1, y1, x2, y2 FROM det""",
)
def mask_boxes(spark, sf_dir):
    runs = masks.of_box(F.col("bbox"), V.FRAME_W)
    t = masks.tight_box(runs, V.FRAME_W)
    return V.detections(spark, sf_dir).select("det_id", masks.area(runs).alias("pixels"), *[t[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "K04 K09 G15",
    f"""WITH {V.LABELLED}, i AS (SELECT video_id, frame_idx, row_number() OVER (ORDER BY min(det_id)) AS image_id FROM lab GROUP BY ALL), c AS (SELECT fine, row_number() OVER (ORDER BY min(det_id)) AS category_id FROM lab GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY image_id, det_id) AS id, image_id, category_id, x1 AS left_, x2 - x1 AS width, {V.sql_area("")} AS area FROM lab JOIN i USING (video_id, frame_idx) JOIN c USING (fine)""",
)
def coco_annotations(spark, sf_dir):
    _, _, a = writers.coco_tables(V.labelled(spark, sf_dir))
    return a.select("id", "image_id", "category_id", F.col("bbox")[0].alias("left_"), F.col("bbox")[2].alias("width"), "area")


@query(
    "K08 P27 K01",
    f"""WITH {V.LABELLED}, c AS (SELECT *, dense_rank() OVER (ORDER BY fine) - 1 AS k FROM lab), l AS (SELECT video_id || '_' || frame_idx AS frame, det_id, k || ' ' || concat_ws(' ', printf('%.6f', x1 / 520.0), printf('%.6f', y1 / 400.0), printf('%.6f', least(1.0, x2 / 520.0)), printf('%.6f', y1 / 400.0),
        printf('%.6f', least(1.0, x2 / 520.0)), printf('%.6f', least(1.0, y2 / 400.0)), printf('%.6f', x1 / 520.0), printf('%.6f', least(1.0, y2 / 400.0))) AS line FROM c) SELECT frame, string_agg(line, chr(10) ORDER BY det_id) AS text, count(*) AS n FROM l GROUP BY frame""",
)
def yolo_files(spark, sf_dir):
    from frameloom.operators.labels_ops import class_index

    d = class_index(V.labelled(spark, sf_dir), "fine").select(F.concat_ws("_", "video_id", "frame_idx").alias("frame"), F.col("det_id").alias("proposal_id"), "class_idx", G.ring(F.col("bbox")).alias("polygon"), F.lit(float(V.FRAME_W)).alias("w"), F.lit(float(V.FRAME_H)).alias("h"))
    return writers.yolo_lines(d, "w", "h")


@query(
    "K12 T13 A21",
    f"""WITH {V.PROP}, r AS (SELECT predicted_label AS label, 'crop_' || proposal_id AS crop_path, row_number() OVER (PARTITION BY predicted_label ORDER BY md5('7|crop_' || proposal_id), 'crop_' || proposal_id) AS n FROM prop), k AS (SELECT * FROM r WHERE n <= 30)
    SELECT label, crop_path, CASE WHEN n <= round(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'val' END AS split FROM k""",
)
def class_folder_split(spark, sf_dir):
    d = V.proposals(spark, sf_dir).select(F.col("predicted_label").alias("label"), F.concat(F.lit("crop_"), F.col("proposal_id").cast("string")).alias("crop_path"))
    return writers.class_folders(d, 30, 7, 0.2)


@query(
    "K21",
    f"""WITH {V.DET}, h AS (SELECT det_id, md5(raw_label) AS m FROM det) SELECT det_id, CAST(('0x' || substring(m, 1, 2)) AS INT) % 192 + 64 AS red, CAST(('0x' || substring(m, 3, 2)) AS INT) % 192 + 64 AS green, CAST(('0x' || substring(m, 5, 2)) AS INT) % 192 + 64 AS blue FROM h""",
)
def display_colors(spark, sf_dir):
    c = writers.display_color(F.col("raw_label"))
    return V.detections(spark, sf_dir).select("det_id", c[0].alias("red"), c[1].alias("green"), c[2].alias("blue"))


@query("K16", f"WITH {V.PROP}, r AS (SELECT cluster_id, proposal_id, row_number() OVER (PARTITION BY cluster_id ORDER BY proposal_id) AS n FROM prop) SELECT cluster_id, string_agg(CAST(proposal_id AS VARCHAR), ',' ORDER BY proposal_id) AS samples FROM r WHERE n <= 32 GROUP BY cluster_id")
def review_sheet(spark, sf_dir):
    from frameloom.operators.topk import per_group

    rows = per_group(V.proposals(spark, sf_dir), ["cluster_id"], [F.col("proposal_id")], 32)
    return rows.groupBy("cluster_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("proposal_id")), lambda x: x.cast("string"))).alias("samples"))


@query("K19", "SELECT DISTINCT strftime(ts, '%Y%m%d') AS session FROM events WHERE strftime(ts, '%Y%m%d') NOT IN (SELECT DISTINCT strftime(ts, '%Y%m%d') AS s FROM events ORDER BY s DESC LIMIT 10)")
def prunable_sessions(spark, sf_dir):
    s = V.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("session")).distinct()
    return writers.newest(s, "session", 10)


def _number(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT)"


@query(
    "S23",
    f"""WITH {V.PROP}, f AS (SELECT DISTINCT frame AS image_id FROM prop), n AS (SELECT image_id, unnest(range(1, {_number("image_id || '|n'")} % 5 + 2)) AS i FROM f)
    SELECT image_id, i, ['pot', 'pan'][{_number("image_id || '|' || i || '|l'")} % 2 + 1] AS label, 0.3 + ({_number("image_id || '|' || i || '|c'")} % 70) / 100.0 AS confidence FROM n""",
)
def synthetic_proposals(spark, sf_dir):
    from frameloom.sources.readers import synthetic_proposals as made

    images = V.proposals(spark, sf_dir).select(F.col("frame").alias("image_id")).distinct()
    return made(images, ["pot", "pan"], V.FRAME_W, V.FRAME_H).select("image_id", "i", "label", "confidence")
