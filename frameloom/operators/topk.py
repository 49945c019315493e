"""Ranking, sampling and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.windows import running_total


def per_group(d: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group with their rank."""
    return d.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def lcg(key: Column) -> Column:
    """A pseudo-random whole number of an id."""
    return (key.cast("bigint") * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF))


def sampled(d: DataFrame, kind: str, k: int, key: str = "proposal_id") -> DataFrame:
    """k rows: uncertain, confident, outliers, improbable or pseudo-random; ties by id."""
    order = {
        "uncertain": F.col("confidence").asc(),
        "confident": F.col("confidence").desc(),
        "outliers": F.col("outlier").desc(),
        "improbable": F.col("probability").asc(),
        "random": lcg(F.col(key)).asc(),
    }[kind]
    return d.orderBy(order, key).limit(k)


def systematic(d: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Every n/k-th row of each group in order, k at most."""
    w = Window.partitionBy(*keys)
    rows = d.withColumns({"_rn": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return rows.where((F.col("_rn") % step == 0) & (F.floor(F.col("_rn") / step) < k)).drop("_rn", "_n")


def page(d: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table; numbers below 0 count as 0."""
    return d.orderBy(*order).offset(max(0, number) * size).limit(size)


def split_index(d: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """Adds ``split``: the first share of the keys, in a seeded hash order, is val (one at least)."""
    keys = d.select(key).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    n = keys.count()
    cut = running_total(keys, "_h", F.lit(1), "_n", 1 << 52).where(F.col("_n") < max(1, int(n * share))).select(key, F.lit("val").alias("split"))
    return d.join(cut, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def top_two(scores: Column) -> Column:
    """struct(best, second, margin) of an array of struct(label, score); ties to the smaller label."""
    ordered = F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    second = F.get(ordered, 1)
    return F.struct(ordered[0]["label"].alias("best"), second["label"].alias("second"), (ordered[0]["score"] - F.coalesce(second["score"], F.lit(0.0))).alias("margin"))
