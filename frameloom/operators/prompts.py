"""Mapping of raw model labels to prompt labels, and detector output to detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.functions import labels as L

# What raw labels may also mean.
ALIASES = {"person": ["hand", "person"], "refrigerator": ["fridge door", "fridge", "refrigerator"], "spoon": ["spoon"], "knife": ["knife"], "cup": ["cup", "mug"], "bowl": ["bowl"]}


def mapped(d: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds ``mapped``: exact, else (for ``coarse:fine``) the coarse prompt, else the first that contains or is contained, else the raw label.

    ``prompts`` (label, pos) is a list of a user's words, so it is broadcast as one row.
    """
    words = prompts.agg(F.array_sort(F.collect_list(F.struct("pos", F.lower(F.trim("label")).alias("l"), "label"))).alias("_p"))
    rows = d.crossJoin(F.broadcast(words))  # one row
    raw, p = F.lower(F.trim("raw_label")), F.col("_p")
    coarse = F.substring_index(raw, ":", 1)
    first = lambda test: F.get(F.filter(p, test), 0)["label"]
    has_colon = F.contains(raw, F.lit(":"))
    related = F.when(has_colon & F.exists(p, lambda x: x["l"].startswith(F.concat(coarse, F.lit(":")))), F.col("raw_label"))
    by_coarse = F.when(has_colon, first(lambda x: x["l"] == coarse))
    return rows.withColumn("mapped", F.coalesce(first(lambda x: x["l"] == raw), related, by_coarse, first(lambda x: F.contains(raw, x["l"]) | F.contains(x["l"], raw)), F.col("raw_label"))).drop("_p")


def matched(d: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows whose label is or means a prompt, with it as ``label``; others go."""
    words = prompts.agg(F.array_sort(F.collect_list(F.struct("pos", F.lower(F.trim("label")).alias("l"), "label"))).alias("_p"))
    rows = d.crossJoin(F.broadcast(words))  # one row
    raw, p = F.lower(F.trim("raw_label")), F.col("_p")
    alias = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    direct = F.get(F.filter(p, lambda x: L.prompt_matches(x["l"], raw)), 0)["label"]
    other = F.get(F.filter(p, lambda x: F.coalesce(F.array_contains(F.try_element_at(alias, raw), x["l"]), F.lit(False))), 0)["label"]
    return rows.withColumn("label", F.coalesce(direct, other)).where("label is not null").drop("_p")


def taxonomy_name(d: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``fine``: the name itself, else the first taxonomy name (by pos) inside it; rows without one get null."""
    words = names.agg(F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("n")))).alias("_p"))
    rows = d.crossJoin(F.broadcast(words))  # one row
    raw = L.lowered(F.col("name"))
    return rows.withColumn("fine", F.coalesce(F.get(F.filter("_p", lambda x: x["n"] == raw), 0)["n"], F.get(F.filter("_p", lambda x: F.contains(raw, x["n"])), 0)["n"])).drop("_p")


def from_model(raw: DataFrame, threshold: float, scale_x: float = 1.0, scale_y: float = 1.0, keys: Sequence[str] = ("frame_idx",)) -> DataFrame:
    """Model output above the threshold, labels normalised, boxes back in frame pixels."""
    kept = raw.where(F.col("score") >= threshold)
    return kept.select(*keys, "seq", L.normalize(F.col("phrase")).alias("label"), G.restored(F.col("bbox"), F.lit(scale_x), F.lit(scale_y)).alias("bbox"), F.col("score").alias("confidence"))


def frames_with_candidates(frames: DataFrame, candidates: DataFrame, k: int, keys: Sequence[str] = ("frame_idx",)) -> DataFrame:
    """Every requested frame (by ``keys``) with its k best candidates; a frame without any has one row of nulls."""
    from frameloom.operators.topk import per_group

    best = per_group(candidates, list(keys), [F.col("score").desc(), F.col("seq")], k)
    return frames.join(best, list(keys), "left")
