"""Appearance of tracks, rounds of memory, and projections of loosely named tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import casts as C
from frameloom.operators.topk import per_group

MOST_CANDIDATES = 40  # of a track


def candidates(d: DataFrame, key: str, quality: str, least: float = 0.35) -> DataFrame:
    """The best rows of each track, of enough quality."""
    return per_group(d.where(F.col(quality) >= least), [key], [F.col(quality).desc(), F.col("row_id")], MOST_CANDIDATES)


def split_candidates(d: DataFrame, key: str, vector: str, least_rows: int = 8, most_spread: float = 0.35, least_gap: float = 0.25) -> DataFrame:
    """Tracks whose appearances lie far from their mean and fall into two groups: key, spread, gap, group sizes.

    ``d`` comes from candidates(), so a track has a bounded number of rows.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "spread", "gap", "first", "second"]
        v = np.stack(group.sort_values("row_id")[vector].to_numpy()).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        mean = v.mean(axis=0)
        spread = float(np.mean(1 - np.clip(v @ (mean / max(np.linalg.norm(mean), 1e-8)), -1, 1)))
        if len(v) < least_rows or spread <= most_spread:
            return pd.DataFrame(columns=columns)
        a, b = np.unravel_index(np.argmin(v @ v.T), (len(v), len(v)))
        centres = v[[a, b]]
        for _ in range(20):
            side = np.argmax(v @ centres.T, axis=1)
            if side.all() or not side.any():
                return pd.DataFrame(columns=columns)
            centres = np.stack([v[side == k].mean(axis=0) for k in (0, 1)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-8)
        gap = float(1 - np.clip(centres[0] @ centres[1], -1, 1))
        rows = [(group[key].iloc[0], spread, gap, int((side == 0).sum()), int((side == 1).sum()))] if gap > least_gap else []
        return pd.DataFrame(rows, columns=columns)

    return d.select(key, "row_id", vector).groupBy(key).applyInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, spread double, gap double, first int, second int")


def consistency(d: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Mean cosine of each track's appearances to their mean."""
    from frameloom.functions import vectors as X

    unit = d.withColumn("_u", X.unit(F.col(vector)))
    mean = unit.groupBy(key).agg(X.mean_vector(F.col("_u"), size).alias("_m"))
    return unit.join(mean, key).groupBy(key).agg(F.avg(X.cosine(F.col("_u"), F.col("_m"))).alias("consistency"), F.count("*").alias("n"))


class Gallery:
    """A step: score of each row against its track's gallery, and the gallery's growth.

    The gallery has the ten best and the five latest appearances and the unit
    mean of the best. Rows enter it if their quality is enough, they are in no
    conflict, and they resemble it. Rows carry ``vector``, ``quality`` and
    ``in_conflict``; a missing vector scores .5.
    """

    def __init__(self, best: int = 10, recent: int = 5, least_quality: float = 0.65, least_likeness: float = 0.45):
        self.best, self.recent, self.least_quality, self.least_likeness = best, recent, least_quality, least_likeness

    def __call__(self, state: dict, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            g = state.setdefault(row["track_id"], {"best": [], "recent": [], "mean": None})
            known = [v for _, v in g["best"]] + g["recent"] + ([g["mean"]] if g["mean"] is not None else [])
            vector = None
            if row["vector"] is not None:
                vector = np.asarray(row["vector"], dtype=np.float64)
                vector = vector / max(float(np.linalg.norm(vector)), 1e-8)
            score = 0.5 if vector is None or not known else float(np.clip(max(v @ vector for v in known), 0, 1))
            added = vector is not None and row["quality"] >= self.least_quality and not row["in_conflict"] and (not known or max(v @ vector for v in known) >= self.least_likeness)
            if added:
                g["recent"] = [*g["recent"], vector][-self.recent :]
                g["best"] = sorted([*g["best"], (row["quality"], vector)], key=lambda x: -x[0])[: self.best]
                mean = np.mean([v for _, v in g["best"]], axis=0)
                g["mean"] = mean / max(float(np.linalg.norm(mean)), 1e-8)
            out.append({**row, "appearance": round(score, 6), "added": bool(added)})
        return out


def in_rounds(rows: DataFrame, rounds: int, folder: str, k: int = 5) -> DataFrame:
    """Rows scored against the memory of the rounds before theirs; what a round keeps joins the memory.

    Columns: row_id, round, label, vector, score. Each round is one distributed
    job and is written, so that memory becomes visible round by round.
    """
    from frameloom.operators import memory, vectors

    spark = rows.sparkSession
    done: DataFrame | None = None
    for r in range(rounds):
        now = rows.where(F.col("round") == r)
        if done is None:
            scored = now.withColumns({"boost": F.lit(0.0), "adjusted": F.col("score")})
        else:
            known = done.select(F.col("row_id").alias("memory_id"), "label", F.when(F.col("adjusted") >= 0.45, "keep").otherwise("delete").alias("action"), "vector")
            found = vectors.nearest(now.select(F.col("row_id").alias("query_id"), F.col("label").alias("query_class"), "vector"), known, k, 0.03)
            scored = memory.boosted(found, now.withColumnRenamed("row_id", "query_id")).withColumnRenamed("query_id", "row_id")
        path = f"{folder}/round={r}"
        scored.select("row_id", "label", "vector", "score", "boost", "adjusted").write.mode("overwrite").parquet(path)
        done = spark.read.parquet(folder)
    return done


def aliased(d: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under their own names from whichever aliases a table has, the first that is present winning; missing ones are null."""
    have = set(d.columns)
    pick = lambda aliases: [C.present(F.col(a).cast("string")) for a in aliases if a in have]
    return d.select(*[(F.coalesce(*pick(aliases)) if pick(aliases) else F.lit(None).cast("string")).alias(name) for name, aliases in names.items()])


def failure_counts(records: DataFrame) -> DataFrame:
    """(failure, n): comma lists taken apart, blank ones dropped, none at all counting as uncertain."""
    parts = F.filter(F.transform(F.split(F.coalesce("failure_type", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return records.select(F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("uncertain")))).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))
