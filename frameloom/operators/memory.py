"""Teacher memory: upsert, activity caps, decisions from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import casts as C
from frameloom.parameters import DEFAULTS, Parameters


def entries(reviewed: DataFrame, session: str, now: str) -> DataFrame:
    """Memory rows of reviewed instances: action and type from the status."""
    rows = reviewed.where(F.col("status").isin("reviewed", "deleted", "uncertain", "corrected"))
    action = F.when(F.col("status") == "deleted", "delete").when(F.col("status") == "uncertain", "uncertain").otherwise("keep")
    kind = F.when(F.col("status") == "deleted", "negative_noise").when(F.col("status") == "uncertain", "uncertain_case").otherwise("positive_object")
    return rows.select(
        F.lit(session).alias("source_session"), "proposal_id", F.concat(F.lit(session + "_"), F.lpad(F.col("proposal_id").cast("string"), 7, "0")).alias("memory_id"),
        C.first_present(F.col("human_label"), F.col("predicted_label")).alias("label"), action.alias("action"), kind.alias("memory_type"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "embedding",
    )


def upserted(memory: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of their key; the first creation time stays."""
    keys = ["source_session", "proposal_id"]
    old, fresh = memory.alias("o"), new.alias("n")
    joined = old.join(fresh, keys, "full_outer")
    columns = [c for c in new.columns if c not in keys]
    has_new = F.col("n.memory_id").isNotNull()
    pick = {c: F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in columns}
    pick["created_at"] = F.coalesce(F.col("o.created_at"), F.col("n.created_at"))
    return joined.select(*keys, *[pick[c].alias(c) for c in columns])


def with_activity(memory: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Adds ``active``: the newest rows of each kept label and the newest deletions; uncertain rows never."""
    group = F.when(F.col("action") == "keep", F.concat(F.lit("keep:"), F.col("label"))).otherwise(F.col("action"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col("updated_at").desc(), "proposal_id"))
    cap = F.when(F.col("action") == "keep", p.active_per_label).when(F.col("action") == "delete", p.active_negative).otherwise(0)
    return memory.withColumn("active", n <= cap)


def decided(neighbours: DataFrame, predicted: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """Suggestion for each query from its neighbours: best similarities, label by votes (ties to the nearest), action."""
    keep, delete = F.col("action") == "keep", F.col("action") == "delete"
    best = neighbours.groupBy("query_id").agg(F.max("similarity").alias("best"), F.max(F.when(keep, F.col("similarity"))).alias("pos"), F.max(F.when(delete, F.col("similarity"))).alias("neg"))
    votes = neighbours.where(keep & (F.col("similarity") >= p.positive_similarity)).groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    label = votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("suggested_label"))
    rows = best.join(label, "query_id", "left").join(predicted, "query_id")
    by_noise = F.when(F.col("neg") >= p.delete_similarity, "delete").when(F.col("neg") >= p.uncertain_similarity, "uncertain")
    by_label = F.when(F.col("suggested_label").isNotNull(), F.when(F.col("suggested_label") != F.col("predicted_label"), "relabel").otherwise("keep"))
    return rows.select("query_id", F.round("best", 4).alias("similarity"), F.coalesce("suggested_label", F.lit("")).alias("suggested_label"), F.coalesce(by_noise, by_label, F.lit("")).alias("suggested_action"))


def boosted(neighbours: DataFrame, score: DataFrame) -> DataFrame:
    """Detection scores adjusted by memory: hard negatives go down and out, close positives up."""
    pos = F.max(F.when(F.col("action") == "keep", F.col("similarity")))
    neg = F.max(F.when(F.col("action") == "delete", F.col("similarity")))
    agg = neighbours.groupBy("query_id").agg(F.coalesce(pos, F.lit(0.0)).alias("p"), F.coalesce(neg, F.lit(0.0)).alias("n"))
    hard = (F.col("n") >= 0.88) & (F.col("n") >= F.col("p") - 0.03)
    boost = F.when(hard, -0.16).when(F.col("p") >= 0.88, 0.12).when(F.col("p") >= 0.78, 0.06).otherwise(0.0)
    rows = score.join(agg.select("query_id", hard.alias("hard"), boost.alias("boost")), "query_id", "left").na.fill({"boost": 0.0, "hard": False})
    return rows.withColumn("adjusted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("boost")))).where("not hard").drop("hard")


def manifest(memory: DataFrame) -> DataFrame:
    """(label, n) of active kept rows, and how many active deletions, as label ``(deleted)``."""
    active = memory.where("active")
    return active.where("action = 'keep'").groupBy("label").agg(F.count("*").alias("n")).unionByName(active.where("action = 'delete'").agg(F.lit("(deleted)").alias("label"), F.count("*").alias("n")))
