"""Event-sourced review: replay, roll-up, export, corrections, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import casts as C
from frameloom.functions import labels as L
from frameloom.functions.ordered import modal


def planned_action(decision: Column) -> Column:
    """A reviewing model's decision as a command."""
    d = F.lower(F.coalesce(decision, F.lit("")))
    return F.when(F.contains(d, F.lit("delete")) | F.contains(d, F.lit("reject")), "delete").when(F.contains(d, F.lit("uncertain")), "uncertain").when(F.contains(d, F.lit("relabel")), "relabel").when(d.isin("accept", "keep"), "reviewed").otherwise("none")


def replayed(instances: DataFrame, events: DataFrame) -> DataFrame:
    """Status, label and reason of each instance after all events in log order.

    Instance events (kind ``instance``) set what they carry. Cluster labels
    (``label``) change rows that are not deleted at that moment; cluster actions
    (``action``) change every row. An event without a status leaves it; a label
    event without one means ``reviewed``.

    No log is gathered and no cluster's event is copied to its instances. A
    cluster's log is read once, with the moments at which an instance's own
    events set its status as points among its events (running values, which
    spill). Between two points only the cluster's events change an instance, so
    each stretch needs the last label that counted, and that is one of two: the
    last one after one of the cluster's own settings in the stretch (``_set``, the
    same for every instance), or the last one of the events right after the
    point, up to a label that deletes or a setting (a ``_seg``).
    """
    said = ["seq", "kind", F.when(F.trim("status") != "", F.col("status")).alias("status"), F.coalesce("label", F.lit("")).alias("label"), F.when(F.trim("reason") != "", F.col("reason")).alias("reason")]
    known = instances.select("proposal_id", "cluster_id", "review_status")
    direct = events.where("kind = 'instance'").select(F.col("target").alias("proposal_id"), *said).join(known, "proposal_id")
    wide = events.where("kind <> 'instance'").select(F.col("target").alias("cluster_id"), *said).where("cluster_id IS NOT NULL")
    none, ends = F.lit(None).cast("long"), (-(2**63), 2**63 - 1)
    point = lambda d, seq, status: d.select("cluster_id", "proposal_id", F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else F.col(seq).cast("long"), F.lit("point").alias("kind"), status.alias("status"), F.lit("").alias("label"))
    points = point(known, ends[0], F.col("review_status")).unionByName(point(direct.where("status IS NOT NULL"), "seq", F.col("status"))).unionByName(point(known, ends[1], F.lit(None).cast("string")))
    log = wide.select("cluster_id", none.alias("proposal_id"), F.col("seq").cast("long"), "kind", "status", "label").unionByName(points)

    is_label, is_point = F.col("kind") == "label", F.col("kind") == "point"
    sets, deletes = ~is_label & ~is_point & F.col("status").isNotNull(), is_label & (F.col("status") == "deleted")
    so_far = Window.partitionBy("cluster_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda value, when: F.last(F.when(when, value), ignorenulls=True).over(so_far)
    gone = F.count(F.when(deletes, 1)).over(so_far) - F.when(deletes, 1).otherwise(0)  # labels that deleted before this event
    log = log.withColumns({"_gone": gone, "_sets": F.count(F.when(sets, 1)).over(so_far)})
    log = log.withColumn("_set", latest(F.struct("seq", "status", "_gone"), sets)).withColumn("_seg", F.col("_sets") + F.col("_gone"))
    said_now = F.struct("seq", "label", F.coalesce("status", F.lit("reviewed")).alias("status"), F.col("_set.seq").alias("since"))
    counts = is_label & (F.col("_set.status") != "deleted") & (F.col("_set._gone") == F.col("_gone"))
    log = log.withColumns({"_counted": latest(said_now, counts), "_label": latest(said_now, is_label), "_whole": F.max(F.when(is_label, said_now)).over(Window.partitionBy("cluster_id", "_seg"))})

    following = lambda c: F.lead(c).over(Window.partitionBy("proposal_id").orderBy("seq"))
    parts = log.where(is_point).withColumns({f"_next{c}": following(c) for c in ("_counted", "_label", "_seg")}).withColumn("_more", following("seq").isNotNull())
    after = lambda c: F.when(F.col(f"{c}.seq") > F.col("seq"), F.col(c))
    at_once = F.when(F.coalesce(F.col("status") != "deleted", F.lit(False)), F.when(F.col("_seg") == F.col("_next_seg"), after("_next_label")).otherwise(after("_whole")))
    counted = F.when(F.col("_more"), F.coalesce(F.when(F.col("_next_counted.since") > F.col("seq"), F.col("_next_counted")), at_once))
    last = lambda value, by, when: F.max_by(F.struct(value.alias("v")), F.when(when, by))
    inner = (F.col("seq") > ends[0]) & (F.col("seq") < ends[1])
    folded = parts.withColumn("_c", counted).groupBy("proposal_id").agg(
        F.max("_c").alias("_c"), F.max(F.when(F.col("seq") == ends[1], F.struct(F.col("_set.seq").alias("seq"), F.col("_set.status").alias("status")))).alias("_wide"), F.max(F.when(inner, F.struct("seq", "status"))).alias("_own")
    )
    own = direct.groupBy("proposal_id").agg(last(F.col("label"), F.col("seq"), F.trim("label") != "").alias("_name"), F.max(F.when(F.trim("label") != "", F.col("seq"))).alias("_named"), F.max(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("_why"))
    reasons = wide.where(~is_label & F.col("reason").isNotNull()).groupBy("cluster_id").agg(F.max(F.struct("seq", "reason")).alias("_told"))
    rows = instances.join(folded, "proposal_id", "left").join(own, "proposal_id", "left").join(reasons, "cluster_id", "left")
    status = F.greatest(*[F.when(F.col(f"{c}.seq").isNotNull(), F.struct(F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.status").alias("status"))) for c in ("_c", "_wide", "_own")])["status"]
    label = F.when(F.col("_c.seq").isNotNull() & (F.col("_named").isNull() | (F.col("_c.seq") > F.col("_named"))), F.col("_c.label")).otherwise(F.col("_name.v"))
    return rows.select("proposal_id", "cluster_id", F.coalesce(status, "review_status").alias("status"), F.coalesce(label, F.col("human_label")).alias("label"), F.coalesce(F.greatest("_told", "_why")["reason"], F.lit("")).alias("reason"))


def rolled_up(instances: DataFrame) -> DataFrame:
    """One row per cluster: counts by status, modal label, status and action, means."""
    rows = instances.withColumn("_label", L.normalize(C.first_present(F.col("human_label"), F.col("predicted_label"))))
    label = modal(rows, ["cluster_id"], "_label", "proposal_id", "current_label").select("cluster_id", "current_label")
    n, has = F.count("*"), lambda *s: F.count_if(F.col("status").isin(*s))
    agg = rows.groupBy("cluster_id").agg(
        n.alias("num_instances"), (n - has("deleted", "uncertain")).alias("num_kept"), has("deleted").alias("num_deleted"), has("uncertain").alias("num_uncertain"),
        F.when(has("deleted") == n, "deleted").when(has("uncertain") == n, "uncertain").when(has("reviewed", "corrected") == n, "reviewed").otherwise("unreviewed").alias("review_status"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )
    return agg.join(label, "cluster_id").withColumns({"coarse_group": L.review_coarse(F.col("current_label")), "action": F.when(F.col("review_status") == "deleted", "delete").when(F.col("review_status") == "uncertain", "uncertain").otherwise("keep")})


def overlaid(base: DataFrame, saved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Saved values that are not blank win, column by column."""
    s = saved.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(s, key, "left").withColumns({c: C.first_present(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def cleaned(instances: DataFrame, clusters: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """Training rows: no deleted rows or clusters, uncertain ones on request, label by precedence, class index by sorted label."""
    rows = instances.join(clusters.select("cluster_id", F.col("review_status").alias("cluster_status")), "cluster_id", "left")
    keep = (F.col("status") != "deleted") & ~F.coalesce(F.col("cluster_status") == "deleted", F.lit(False))
    if not include_uncertain:
        keep = keep & (F.col("status") != "uncertain") & ~F.coalesce(F.col("cluster_status") == "uncertain", F.lit(False))
    out = rows.where(keep).withColumn("label", L.normalize(C.first_present(F.col("human_label"), F.col("predicted_label"))))
    names = out.select("label").distinct().withColumn("class_idx", F.dense_rank().over(Window.orderBy("label")) - 1)
    return out.join(names, "label").select("proposal_id", "label", "class_idx")


def correction_state(bbox: Column, mask: Column, bbox_only: Column) -> Column:
    return F.when(bbox_only, "bbox_only").when(bbox & mask, "bbox_and_mask_corrected").when(bbox, "bbox_corrected").when(mask, "mask_corrected").otherwise("original")


def merged_clusters(instances: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows of source clusters get the target's id (one step: targets are not sources)."""
    return instances.join(merges, instances["cluster_id"] == merges["source"], "left").withColumn("cluster_id", F.coalesce("target", "cluster_id")).drop("source", "target")


def split_off(instances: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen rows become a new cluster, numbered after the largest."""
    top = instances.agg((F.max("cluster_id") + 1).alias("_new"))
    marked = instances.join(chosen.withColumn("_hit", F.lit(True)), "proposal_id", "left")
    return marked.crossJoin(F.broadcast(top)).withColumn("cluster_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("cluster_id"))).drop("_hit", "_new")  # top: one row


def undone(current: DataFrame, before_images: DataFrame, key: str, change: int) -> DataFrame:
    """The table with the before-images of a change put back."""
    old = before_images.where(F.col("change_id") == change).drop("change_id")
    return current.join(old, key, "left_anti").unionByName(old)
