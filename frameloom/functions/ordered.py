"""Aggregates whose ties have a defined winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_map(labels: Column) -> Column:
    """Aggregate helper: a JSON object of label -> count from collected structs(label, n), most frequent first."""
    return F.to_json(F.map_from_entries(labels))


def modal(df: DataFrame, keys: list[str], value: str, position: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equals the one that comes first by ``position``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(name), F.sum("_n").alias(f"{name}_total"), F.max("_n").alias(f"{name}_count"))


def best(value: Column, *order: Column) -> Column:
    """Aggregate: the value with the largest order key."""
    return F.max_by(value, F.struct(*order))
