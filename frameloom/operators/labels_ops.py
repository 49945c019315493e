"""Label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import labels as L


def hierarchy(d: DataFrame, label: str) -> DataFrame:
    """(coarse, fines, n, idx): the sorted fine labels of each coarse group that occur."""
    fine = d.select(L.normalize(F.col(label)).alias("fine")).distinct()
    grouped = fine.withColumn("coarse", L.review_coarse(F.col("fine"))).groupBy("coarse").agg(F.concat_ws(",", F.array_sort(F.collect_set("fine"))).alias("fines"), F.count("*").alias("n"))
    return grouped.withColumn("idx", F.dense_rank().over(Window.orderBy("coarse")) - 1)  # as many rows as coarse groups


def class_index(d: DataFrame, label: str) -> DataFrame:
    """Adds ``class_idx``: the label's place among the sorted distinct labels."""
    names = d.select(label).distinct().withColumn("class_idx", F.dense_rank().over(Window.orderBy(label)) - 1)
    return d.join(names, label)
