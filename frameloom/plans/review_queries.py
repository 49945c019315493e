"""Review replay, roll-up, cleaned export, memory and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import vectors as X
from frameloom.operators import memory, review, vectors
from frameloom.plans import views as V
from frameloom.plans.catalog import query

R = lambda c: F.round(c, 6)

#: Review commands made of the events table: click = instance status, view = cluster label, others = cluster action.
EVENTS = """ev AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'instance' WHEN 'view' THEN 'label' ELSE 'action' END AS kind,
    CASE WHEN event_type = 'click' THEN user_id * 3 + event_id % 3 ELSE event_id % 17 - 1 END AS target,
    CASE WHEN event_type = 'click' THEN ['deleted','reviewed','uncertain',''][event_id % 4 + 1] WHEN event_type = 'view' THEN '' ELSE ['deleted','uncertain','reviewed'][event_id % 3 + 1] END AS status,
    CASE WHEN event_type IN ('click','view') AND event_id % 5 <> 0 THEN ['pot','pan','lid'][event_id % 3 + 1] ELSE '' END AS label,
    CASE WHEN event_id % 7 = 0 THEN 'r' || event_id % 10 ELSE '' END AS reason FROM events)"""


def review_events(spark, sf_dir):
    e, n, t = V.table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    at = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (n % k + 1).cast("int"))
    return e.select(
        n.alias("seq"),
        F.when(t == "click", "instance").when(t == "view", "label").otherwise("action").alias("kind"),
        F.when(t == "click", F.col("user_id") * 3 + n % 3).otherwise(n % 17 - 1).alias("target"),
        F.when(t == "click", at(["deleted", "reviewed", "uncertain", ""], 4)).when(t == "view", "").otherwise(at(["deleted", "uncertain", "reviewed"], 3)).alias("status"),
        F.when(t.isin("click", "view") & (n % 5 != 0), at(["pot", "pan", "lid"], 3)).otherwise("").alias("label"),
        F.when(n % 7 == 0, F.concat(F.lit("r"), (n % 10).cast("string"))).otherwise("").alias("reason"),
    )


_REPLAY = f"""WITH {V.PROP}, {EVENTS},
    rows_ AS (SELECT p.proposal_id, p.human_label, e.* FROM prop p JOIN ev e ON e.kind = 'instance' AND e.target = p.proposal_id UNION ALL SELECT p.proposal_id, p.human_label, e.* FROM prop p JOIN ev e ON e.kind <> 'instance' AND e.target = p.cluster_id),
    now AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'label' THEN nullif(status, '') END IGNORE NULLS) OVER (PARTITION BY proposal_id ORDER BY seq), 'unreviewed') <> 'deleted' AS alive FROM rows_),
    fold AS (SELECT proposal_id, max_by(coalesce(nullif(status, ''), 'reviewed'), seq) FILTER (CASE WHEN kind = 'label' THEN alive ELSE status <> '' END) AS status,
        max_by(label, seq) FILTER (CASE kind WHEN 'label' THEN alive WHEN 'instance' THEN label <> '' ELSE FALSE END) AS label, max_by(reason, seq) FILTER (kind <> 'label' AND reason <> '') AS reason FROM now GROUP BY proposal_id)
    SELECT p.proposal_id, p.cluster_id, coalesce(f.status, 'unreviewed') AS status, coalesce(f.label, p.human_label) AS label, coalesce(f.reason, '') AS reason FROM prop p LEFT JOIN fold f USING (proposal_id)"""


@query("X20 J18", _REPLAY)
def replayed_review(spark, sf_dir):
    p = V.proposals(spark, sf_dir).select("proposal_id", "cluster_id", "human_label", F.lit("unreviewed").alias("review_status"))
    return review.replayed(p, review_events(spark, sf_dir))


@query(
    "A04",
    f"""WITH {V.PROP}, r AS (SELECT *, {V.sql_normalize("coalesce(nullif(human_label, ''), predicted_label)")} AS lab FROM prop), l AS (SELECT cluster_id, lab, count(*) AS n, min(proposal_id) AS first FROM r GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS k FROM l),
    a AS (SELECT cluster_id, count(*) AS num_instances, count(*) FILTER (status NOT IN ('deleted', 'uncertain')) AS num_kept, count(*) FILTER (status = 'deleted') AS num_deleted, count(*) FILTER (status = 'uncertain') AS num_uncertain,
        CASE WHEN bool_and(status = 'deleted') THEN 'deleted' WHEN bool_and(status = 'uncertain') THEN 'uncertain' WHEN bool_and(status IN ('reviewed', 'corrected')) THEN 'reviewed' ELSE 'unreviewed' END AS review_status, round(avg(confidence), 4) AS avg_confidence FROM r GROUP BY cluster_id)
    SELECT a.*, m.lab AS current_label, {V.sql_review_coarse("m.lab")} AS coarse_group, CASE review_status WHEN 'deleted' THEN 'delete' WHEN 'uncertain' THEN 'uncertain' ELSE 'keep' END AS action FROM a JOIN m ON a.cluster_id = m.cluster_id AND m.k = 1""",
)
def cluster_rollup(spark, sf_dir):
    return review.rolled_up(V.proposals(spark, sf_dir))


@query(
    "F07 W13 X22",
    f"""WITH {V.PROP}, c AS (SELECT i - 1 AS cluster_id, CASE i % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'uncertain' ELSE 'reviewed' END AS cs FROM range(12) t(i)),
    o AS (SELECT proposal_id, {V.sql_normalize("coalesce(nullif(human_label, ''), predicted_label)")} AS label FROM prop LEFT JOIN c USING (cluster_id) WHERE status NOT IN ('deleted', 'uncertain') AND coalesce(cs, '') NOT IN ('deleted', 'uncertain'))
    SELECT proposal_id, label, dense_rank() OVER (ORDER BY label) - 1 AS class_idx FROM o""",
)
def cleaned_export(spark, sf_dir):
    i = F.col("id")
    clusters = spark.range(12).select((i - 1).alias("cluster_id"), F.when(i % 4 == 0, "deleted").when(i % 4 == 1, "uncertain").otherwise("reviewed").alias("review_status"))
    return review.cleaned(V.proposals(spark, sf_dir), clusters)


@query(
    "X22",
    f"""WITH {V.PROP} SELECT proposal_id, CASE WHEN proposal_id % 7 = 0 THEN 'bbox_only' WHEN proposal_id % 2 = 0 AND proposal_id % 3 = 0 THEN 'bbox_and_mask_corrected' WHEN proposal_id % 2 = 0 THEN 'bbox_corrected' WHEN proposal_id % 3 = 0 THEN 'mask_corrected' ELSE 'original' END AS correction_status FROM prop""",
)
def correction_states(spark, sf_dir):
    n = F.col("proposal_id")
    return V.proposals(spark, sf_dir).select("proposal_id", review.correction_state(n % 2 == 0, n % 3 == 0, n % 7 == 0).alias("correction_status"))


@query(
    "X21 Z16 Z17 Z18",
    f"""WITH {V.PROP} SELECT proposal_id, CASE WHEN proposal_id < 20 THEN cluster_id WHEN cluster_id = 3 AND proposal_id % 2 = 0 THEN 16 WHEN cluster_id = 5 THEN 6 ELSE cluster_id END AS cluster_id FROM prop""",
)
def split_merge_undo(spark, sf_dir):
    p = V.proposals(spark, sf_dir).select("proposal_id", "cluster_id")
    split = review.split_off(p, p.where("cluster_id = 3 AND proposal_id % 2 = 0").select("proposal_id"))
    merged = review.merged_clusters(split, spark.createDataFrame([(5, 6)], "source bigint, target bigint"))
    before = p.where("proposal_id < 20").withColumn("change_id", F.lit(1))
    return review.undone(merged, before, "proposal_id", 1)


_MEMORY = f"""{V.PROP}, e AS (SELECT 's1' AS source_session, proposal_id, 's1_' || lpad(CAST(proposal_id AS VARCHAR), 7, '0') AS memory_id, coalesce(nullif(human_label, ''), predicted_label) AS label,
    CASE status WHEN 'deleted' THEN 'delete' WHEN 'uncertain' THEN 'uncertain' ELSE 'keep' END AS action, embedding FROM prop WHERE status IN ('reviewed','deleted','uncertain','corrected'))"""


def _memory(spark, sf_dir):
    p = V.proposals(spark, sf_dir)
    old = memory.entries(p.where("proposal_id % 3 = 0"), "s1", "2026-01-01T00:00:00").withColumn("label", F.lit("old"))
    return memory.upserted(old, memory.entries(p, "s1", "2026-02-01T00:00:00"))


@query(
    "X23 W08 K15 Z14",
    f"""WITH {_MEMORY}, r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN action = 'keep' THEN 'keep:' || label ELSE action END ORDER BY proposal_id) AS n FROM e)
    SELECT memory_id, label, action, CASE WHEN proposal_id % 3 = 0 THEN '2026-01-01T00:00:00' ELSE '2026-02-01T00:00:00' END AS created_at, n <= CASE action WHEN 'keep' THEN 20 WHEN 'delete' THEN 50 ELSE 0 END AS active FROM r""",
)
def memory_upsert(spark, sf_dir):
    from frameloom.parameters import DEFAULTS

    return memory.with_activity(_memory(spark, sf_dir), DEFAULTS.with_(active_per_label=20, active_negative=50)).select("memory_id", "label", "action", "created_at", "active")


@query("K15 A08", f"WITH {_MEMORY} SELECT label, count(*) AS n FROM e WHERE action = 'keep' GROUP BY label UNION ALL SELECT '(deleted)', count(*) FROM e WHERE action = 'delete'")
def memory_manifest(spark, sf_dir):
    return memory.manifest(memory.with_activity(_memory(spark, sf_dir)).withColumn("active", F.col("action") != "uncertain"))


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 9)"
_KNN = f"""{_MEMORY}, k AS (SELECT q.proposal_id AS query_id, q.predicted_label, m.proposal_id AS memory_id, m.label, m.action, {_COS} AS similarity FROM prop q, e m WHERE q.proposal_id % 50 = 0 AND m.action <> 'uncertain'),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM k), n AS (SELECT * FROM t WHERE rank <= 5)"""


def _neighbours(spark, sf_dir, k=5, bonus=0.0, search=vectors.nearest):
    m = _memory(spark, sf_dir).where("action <> 'uncertain'").select(F.col("proposal_id").alias("memory_id"), "label", "action", F.col("embedding").alias("vector"))
    q = V.proposals(spark, sf_dir).where("proposal_id % 50 = 0").select(F.col("proposal_id").alias("query_id"), F.col("predicted_label").alias("query_class"), F.col("embedding").alias("vector"))
    return search(q, m, k, bonus_same=bonus), q.select("query_id", F.col("query_class").alias("predicted_label"))


@query("J20 V01", f"WITH {_KNN} SELECT query_id, rank, memory_id, action, round(similarity, 6) AS similarity FROM n")
def nearest_memory(spark, sf_dir):
    return _neighbours(spark, sf_dir)[0].select("query_id", "rank", "memory_id", "action", R(F.col("similarity")).alias("similarity"))


@query("J20")
def indexed_memory(spark, sf_dir):
    """The same search over an index; the tests measure its recall."""
    return _neighbours(spark, sf_dir, search=vectors.nearest_indexed)[0].select("query_id", "rank", "memory_id", "action", R(F.col("similarity")).alias("similarity"))


@query(
    "A07 X24 J22",
    f"""WITH {_KNN}, b AS (SELECT query_id, any_value(predicted_label) AS predicted_label, max(similarity) AS best, max(similarity) FILTER (action = 'delete') AS neg FROM n GROUP BY query_id),
    v AS (SELECT query_id, label, count(*) AS c, min(rank) AS first FROM n WHERE action = 'keep' AND similarity >= 0.2 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first) AS k FROM v)
    SELECT b.query_id, round(best, 4) AS similarity, coalesce(w.label, '') AS suggested_label, CASE WHEN neg >= 0.3 THEN 'delete' WHEN neg >= 0.25 THEN 'uncertain' WHEN w.label IS NULL THEN '' WHEN w.label <> predicted_label THEN 'relabel' ELSE 'keep' END AS suggested_action
    FROM b LEFT JOIN w ON b.query_id = w.query_id AND w.k = 1""",
)
def memory_decisions(spark, sf_dir):
    from frameloom.parameters import DEFAULTS

    found, predicted = _neighbours(spark, sf_dir)
    return memory.decided(found, predicted, DEFAULTS.with_(positive_similarity=0.2, uncertain_similarity=0.25, delete_similarity=0.3))


@query(
    "J21 J22",
    f"""WITH {_KNN.replace(_COS + " AS", f"{_COS} + CASE WHEN m.label = q.predicted_label THEN 0.03 ELSE 0.0 END AS")}, a AS (SELECT query_id, coalesce(max(similarity) FILTER (action = 'keep'), 0.0) AS p, coalesce(max(similarity) FILTER (action = 'delete'), 0.0) AS g FROM n GROUP BY query_id)
    SELECT query_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN p >= 0.88 THEN 0.12 WHEN p >= 0.78 THEN 0.06 ELSE 0.0 END)), 6) AS adjusted FROM a WHERE NOT (g >= 0.88 AND g >= p - 0.03)""",
)
def memory_boost(spark, sf_dir):
    found, predicted = _neighbours(spark, sf_dir, 5, 0.03)
    return memory.boosted(found, predicted.select("query_id", F.lit(0.5).alias("score"))).select("query_id", R(F.col("adjusted")).alias("adjusted"))


@query(
    "V04 V01 A12",
    """WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT label, i, avg(v[i]) AS m FROM u, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS m FROM d GROUP BY label),
    p AS (SELECT vec_id, u.label, c.label AS k, list_distance(v, m) AS dist FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS n FROM p)
    SELECT vec_id, CAST(k AS BIGINT) AS nearest, round(dist, 5) AS distance FROM r WHERE n = 1""",
)
def lloyd_step(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    rows = vectors.assigned(v, vectors.centroids(v, "label", "embedding", 64), "label", "embedding")
    return rows.select("vec_id", "nearest", F.round(F.sqrt("distance2"), 5).alias("distance"))


@query("V01", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS length, 1.0 AS unit_length FROM embeddings")
def unit_vectors(spark, sf_dir):
    e = F.col("embedding")
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.norm(e), 5).alias("length"), F.round(X.norm(X.unit(e)), 6).alias("unit_length"))


@query("V04 V09 V10")
def kmeans_clusters(spark, sf_dir):
    return vectors.kmeans(V.proposals(spark, sf_dir), "embedding", 10).select("proposal_id", "cluster")


@query("V02 V09")
def principal_components(spark, sf_dir):
    return vectors.principal(V.proposals(spark, sf_dir), "embedding", 8).select("proposal_id", F.size("reduced").alias("size"), R(X.norm(F.col("reduced"))).alias("length"))


@query("V05 V06 V07")
def density_clusters(spark, sf_dir):
    rows = vectors.bucketed(V.proposals(spark, sf_dir), "embedding", 400, 1500)
    return vectors.density_clusters(rows, ["bucket"], "embedding").select("bucket", "proposal_id", "local_cluster_id", R(F.col("probability")).alias("probability"))
