"""Label evaluation at fine and coarse level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import labels as L
from frameloom.operators.joins import positional_outer


def accuracy(truth: DataFrame, predicted: DataFrame, names: DataFrame) -> DataFrame:
    """One row: matched and unmatched positions, fine and coarse hits and accuracies."""
    table = names
    rows = positional_outer(truth, predicted)
    rows = rows.join(table.select(F.col("idx").alias("truth"), F.col("name").alias("t")), "truth", "left").join(table.select(F.col("idx").alias("predicted"), F.col("name").alias("p")), "predicted", "left")
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    fine, coarse = F.count_if(both & (F.col("t") == F.col("p"))), F.count_if(both & L.same_coarse(F.col("t"), F.col("p")))
    matched = F.count_if(both)
    share = lambda n: F.when(matched > 0, n / matched).otherwise(0.0)
    return rows.agg(matched.alias("matched"), F.count_if(~both).alias("unmatched"), fine.alias("fine_correct"), coarse.alias("coarse_correct"), share(fine).alias("fine_accuracy"), share(coarse).alias("coarse_accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, predicted, n)."""
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    return pairs.groupBy("truth").pivot("predicted", labels).count().na.fill(0)


def class_report(pairs: DataFrame) -> DataFrame:
    """Support, predictions, hits, precision and recall of each label that occurs on either side."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("truth") == F.col("predicted")).cast("int").alias("h")))).alias("e")).select("e.*")
    agg = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    return agg.withColumns({"precision": F.when(F.col("predicted") > 0, F.round(F.col("hits") / F.col("predicted"), 6)).otherwise(0.0), "recall": F.when(F.col("support") > 0, F.round(F.col("hits") / F.col("support"), 6)).otherwise(0.0)})
