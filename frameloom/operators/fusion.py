"""Evidence of several models about one object, put together by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.functions import scores as S

# Labels that say "nothing here", labels that thin edges are mistaken for, and support thresholds.
NEGATIVE = ("background", "unknown", "nothing", "empty")
EDGE_PRONE = ("knife", "fork", "spoon", "spatula", "tongs", "ladle", "cutting board")
SUPPORT = {"crop": 0.20, "verifier": 0.25, "margin": 0.05, "confident": 0.45}


def _coarse(label: Column) -> Column:
    """Coarse group; null for a missing label."""
    return F.when(F.coalesce(F.trim(label), F.lit("")) != "", L.review_coarse(label))


def fused(d: DataFrame) -> DataFrame:
    """Final label, source, status and conflict of each row.

    Columns read: detector_label and _score; cluster_label; human_label;
    crop_label and _score; verifier_label, _score, _margin, _negative;
    objectness and objectness_score; noise (Boolean).
    """
    c, lit = F.col, F.lit
    n = lambda x: F.when(F.coalesce(F.trim(c(x)), lit("")) != "", L.normalize(c(x)))
    rows = d.select("*", *[n(f"{k}_label").alias(f"{k}_l") for k in ("detector", "cluster", "human", "crop", "verifier")])
    rows = rows.select("*", *[_coarse(c(f"{k}_l")).alias(f"{k}_c") for k in ("detector", "cluster", "crop", "verifier")])
    no = lambda x: F.coalesce(x, lit(False))
    by_crop = no(~c("crop_l").isin(*NEGATIVE) & (c("crop_c") == c("detector_c")) & (c("crop_score") >= SUPPORT["crop"]))
    by_verifier = no(~c("verifier_l").isin(*NEGATIVE) & (c("verifier_c") == c("detector_c")) & (c("verifier_score") >= SUPPORT["verifier"]) & (c("verifier_margin") >= SUPPORT["margin"]))
    rows = rows.withColumns({"supports": by_crop.cast("int") + by_verifier.cast("int"), "low": c("detector_score") < SUPPORT["confident"]})
    agree = no((c("crop_c") == c("verifier_c")) & (c("crop_c") != "background")) & (no(c("crop_score") >= SUPPORT["crop"]) | no(c("verifier_score") >= SUPPORT["verifier"]))
    replaced = (c("supports") == 0) & (c("detector_score") < 0.30) & agree
    differs = lambda k: no(c(f"{k}_c").isNotNull() & ~c(f"{k}_c").isin("unknown", "background") & (c(f"{k}_c") != c("detector_c")))
    known = F.filter(F.array("detector_c", "cluster_c", "crop_c", "verifier_c"), lambda x: x.isNotNull() & (x != "unknown"))
    severe = F.size(F.array_distinct(known)) >= 3
    fine = no((c("cluster_c") == c("detector_c")) & (c("cluster_l") != c("detector_l")))
    weak_same = no((c("crop_l") == c("detector_l")) & (c("verifier_l") == c("detector_l"))) & (no(c("crop_score") < SUPPORT["crop"]) | no(c("verifier_score") < SUPPORT["verifier"]))
    edge = c("detector_l").isin(*EDGE_PRONE) & (c("low") | c("noise") | weak_same) & (c("supports") < 2)
    noisy = c("noise") & c("low") & (c("supports") < 2)
    negative = no(c("verifier_negative")) & no(c("verifier_margin") > 0.05)
    refused = negative & (F.coalesce("objectness_score", lit(0.0)) < 0.55)
    human, fake = c("human_l").isNotNull(), no(c("objectness") == "fake")
    conflict = (  # the last rule that applies decides
        F.when(refused, "fake_object").when(negative, "needs_review").when(noisy, "noise_cluster_low_confidence").when(edge, "edge_fragment").when(fine, "fine_conflict_same_coarse").when(severe, "severe_coarse_conflict")
        .when(differs("verifier"), "verifier_disagrees").when(differs("crop"), "crop_disagrees").when(no(c("cluster_c") != c("detector_c")), "cluster_disagrees").otherwise("none")
    )
    quality = F.when(refused, "rejected").when(negative | severe | edge | noisy | no(c("objectness") == "uncertain"), "uncertain").otherwise("high_quality")
    final = F.when(human, c("human_l")).when(fake, "background_candidate").when(replaced, F.coalesce("crop_l", "verifier_l")).otherwise(c("detector_l"))
    kept = [x for x in d.columns]
    return rows.select(
        *kept,
        final.alias("final_label"),
        F.when(~human & fake, "background").otherwise(L.review_coarse(final)).alias("final_coarse"),
        F.when(human, "human").when(fake, "objectness").when(c("supports") > 0, "detector_supported").when(replaced, "crop_and_verifier").otherwise("detector").alias("label_source"),
        F.when(human, "high_quality").when(fake, "rejected").otherwise(quality).alias("quality"),
        F.when(human, "none").when(fake, "fake_object").otherwise(conflict).alias("conflict"),
        F.when(human | fake, False).otherwise(F.when(negative, ~refused).otherwise(severe | edge | noisy)).alias("needs_review"),
    )


def arbitrated(d: DataFrame) -> DataFrame:
    """Adds final_after and quality_after: what a reviewing model's answer makes of label and quality.

    Columns read: final_label, quality; decision, confidence, new_label,
    mask_alert, fake (of the answer, null without one).
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    alert = yes(c("decision") == "mask_alert") | yes(c("mask_alert"))
    reject = yes(c("decision") == "reject") | yes(c("fake"))
    relabel = yes(c("decision").isin("relabel", "accept_label")) & (F.coalesce("new_label", F.lit("")) != "") & yes(c("confidence") >= 0.65)
    label = F.when(alert, c("final_label")).when(reject, "background_candidate").when(relabel, F.lower(F.trim("new_label"))).otherwise(c("final_label"))
    quality = F.when(alert, "uncertain").when(reject, "rejected").when(relabel, F.when(c("confidence") >= 0.75, "high_quality").otherwise("uncertain")).when(yes(c("decision") == "uncertain"), "uncertain").otherwise(c("quality"))
    return d.withColumns({"final_after": label, "quality_after": quality})


def arbitration_summary(d: DataFrame) -> DataFrame:
    return d.agg(
        F.count("*").alias("rows"), F.count_if((F.col("quality") == "uncertain") & (F.col("quality_after") == "high_quality")).alias("rescued"), F.count_if(F.col("quality_after") == "rejected").alias("rejected"), F.count_if(F.coalesce("mask_alert", F.lit(False))).alias("mask_alerts"),
    )


# What each term of a record's score weighs.
WEIGHTS = {"proposal": 0.20, "shape": 0.20, "semantic": 0.20, "temporal": 0.20, "memory": 0.10, "relation": 0.10}


def record_quality(d: DataFrame, image_area: float) -> DataFrame:
    """Adds flags, quality_score and status of mask records (score, mask_area, bbox_area, components).

    With the usual temporal and memory terms the score stays below the limit
    for acceptance, so that only a review can accept a record.
    """
    in_image, in_box = F.col("mask_area") / image_area, F.col("mask_area") / F.greatest(F.lit(1.0), F.col("bbox_area"))
    flags = F.array_compact(
        F.array(F.when(in_image < 0.0002, "mask_area_too_small"), F.when(in_image > 0.65, "mask_area_too_large"), F.when(in_box < 0.15, "mask_bbox_area_abnormal"), F.when(F.col("components") > 4, "too_many_connected_components"))
    )
    clean = F.size(flags) == 0
    terms = {"proposal": F.col("score"), "shape": S.clipped(0.35 + in_box), "semantic": F.lit(0.55), "temporal": F.lit(0.55), "memory": F.lit(0.50), "relation": F.when(clean, 0.65).otherwise(0.35)}
    score = S.mask_quality_score(terms, WEIGHTS)
    return d.withColumns({"flags": flags, "quality_score": score, "status": S.record_status(score, ~clean)})


def repaired(d: DataFrame) -> DataFrame:
    """A reviewing model's action on a record, if it is sure enough; a new mask only if it is not worse.

    Columns read: status, label, quality_score, mask_area; action, confidence,
    new_label, needs_fix; new_score and new_area (of a mask made anew, or null).
    """
    c = F.col
    sure = F.coalesce(c("confidence") >= 0.70, F.lit(False))
    again = c("action").isin("reprompt_sam2", "add_region", "subtract_region", "split_instances") & c("new_score").isNotNull()
    jump = (c("mask_area") > 0) & (F.abs(c("new_area") - c("mask_area")) / c("mask_area") > 2.5) & ~F.coalesce("needs_fix", F.lit(False))
    better = again & ~jump & (c("new_score") + 0.03 >= c("quality_score"))
    relabel = c("action").isin("wrong_class", "relabel") & (F.coalesce("new_label", F.lit("")) != "")
    done = F.when(~sure, None).when(c("action") == "accept", "accept").when(c("action") == "reject", "reject").when(relabel, "relabel").when(better, "reprompt")
    rows = d.withColumn("repair", F.coalesce(done, F.lit("none")))
    status = F.when(c("repair") == "accept", "accepted").when(c("repair") == "reject", "rejected").when(c("repair") == "reprompt", F.when(c("new_score") >= 0.80, "accepted").otherwise("needs_vlm")).otherwise(c("status"))
    return rows.withColumns({"status": status, "label": F.when(c("repair") == "relabel", c("new_label")).otherwise(c("label")), "quality_score": F.when(c("repair") == "reprompt", c("new_score")).otherwise(c("quality_score"))})


def propagation_safety(d: DataFrame, least_area: int = 80, most_change: float = 2.5, least_iou: float = 0.35, most_jump: float = 0.18) -> DataFrame:
    """Adds ``safety`` of a propagated mask and ``chosen`` mask: original or propagated.

    Columns read: area, key_area, has_original, iou and center_jump against the
    original, in_conflict, original_quality.
    """
    c = F.col
    ratio = c("area") / F.greatest(F.lit(1), c("key_area"))
    drift = c("has_original") & ((c("iou") < least_iou) | (c("center_jump") > most_jump))
    safety = F.when((c("area") < least_area) | (ratio > most_change) | (ratio < 1.0 / most_change), "reject_area_jump").when(drift, "reject_drift").when(c("has_original") & c("in_conflict"), "review_candidate").when(~c("has_original"), "recovery_candidate").otherwise("accept_candidate")
    weak = ~c("has_original") | (c("original_quality") < 0.45)
    rows = d.withColumn("safety", safety)
    return rows.withColumn("chosen", F.when(weak & c("safety").isin("accept_candidate", "recovery_candidate"), "propagated").otherwise("original"))


def depth_action(d: DataFrame, trust: float = 0.45, risky: float = 0.62) -> DataFrame:
    """Adds ``risk`` and ``action`` for a mask's depth: compactness, separation, edge_alignment, outlier_ratio, split_score, split, trim_valid."""
    c = F.col
    risk = S.clipped(0.30 * (1.0 - c("compactness")) + 0.20 * (1.0 - c("separation")) + 0.20 * (1.0 - c("edge_alignment")) + 0.15 * c("outlier_ratio") + 0.15 * c("split_score"))
    rows = d.withColumn("risk", risk)
    poor = (c("compactness") < 0.20) & (c("separation") < 0.20)
    action = F.when(c("split"), "split_candidate_review").when(c("edge_alignment") >= trust, "accept_original").when(c("trim_valid") & (c("risk") < risky), "trim_boundary_noise").when(c("risk") >= risky, F.when(poor, "reject_or_review").otherwise("keep_original_review")).otherwise("accept_original")
    return rows.withColumn("action", action)
