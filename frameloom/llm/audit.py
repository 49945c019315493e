"""Operator 11: how filters interact, from one SQL CUBE over their failure flags.

Every document gets five failure flags. The documents are counted by part and
flags, and the counts go through ``CUBE`` over part and flags: the grouping set
of a part and some flags, where all of those are false, holds the survivors of
that subset of the filters. Every step of every order of the filters is then a
pair of subsets, the one before it and the one after it, and a join of the
steps with both gives what the step keeps and removes.

The cube runs over counts, of which a part has at most 32 times the number of
label combinations, so the size of its input is that of the table of parts,
whatever the number of documents. Steps are a fixed table of 600 rows.

The flags: A under 50 words; B 100 * distinct words < 65 * words; C 100 *
capitals A-Z > 5 * code points; D any of ``#$%&*|``; E a smaller id has an
identical text anywhere in the table. Words are runs without blanks, case
counts.

Cases: a null text is empty, a null part is the empty string. Rows without an
id equal no smaller id and are no smaller id to others. Repeated rows of one id
count each, and are no copies of one another. A document is good or toxic if
any of its label rows says so; null labels say nothing, and rows without an id
have none. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.shared import heavy_join, only, written

FLAGS = "ABCDE"
_ALL = (1 << len(FLAGS)) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _text_flags(docs: DataFrame) -> DataFrame:
    """Flags A to D of every row, and the digest of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns({"words": _words(text), "capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")), "points": F.length(text)})
    counted = split.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    return counted.select(
        "doc_id",
        F.coalesce(F.col("part"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (F.col("n") < 50).alias("A"),
        (100 * F.col("distinct") < 65 * F.col("n")).alias("B"),
        (100 * F.col("capitals") > 5 * F.col("points")).alias("C"),
        text.rlike("[#$%&*|]").alias("D"),
    )


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic as 0 or 1; rows without an id stay out of the join."""
    rated = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL")
    rated = rated.groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "bad"))])
    named = rows.where("doc_id IS NOT NULL").join(rated, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("good", "bad")})
    unnamed = rows.where("doc_id IS NULL").withColumns({c: F.lit(0).cast("long") for c in ("good", "bad")})
    return named.unionByName(unnamed)


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, bad) of every document.

    Copies meet as digests: the least id of each text is a grouped minimum, and
    rows learn it by heavy_join, so a text with a large share of all rows is
    broadcast and its rows stay where they are.
    """
    rows = written(_labelled(_text_flags(only(docs, doc_id=id_col, text=text_col, part=part_col)), labels), "flags")
    least = written(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "least")
    met = heavy_join(rows, least, "digest", "size")
    return met.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"), "good", "bad")


def survivors(flags: DataFrame) -> DataFrame:
    """(part, subset, n, good, bad): what passes all filters of each of the 32 subsets; zeros included.

    ``subset`` has bit i set for filter i of FLAGS.
    """
    counts = written(flags.groupBy("part", *FLAGS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "counts")
    cube = counts.cube("part", *FLAGS).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"not_{f}") for f in FLAGS])
    subset, passes = F.lit(0), F.lit(True)
    for i, f in enumerate(FLAGS):
        selected = F.col(f"not_{f}") == 0
        subset = subset + F.when(selected, 1 << i).otherwise(0)
        passes = passes & ~(selected & F.coalesce(F.col(f), F.lit(False)))
    return cube.where("whole = 0").groupBy("part", subset.alias("subset")).agg(*[F.sum(F.when(passes, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "bad")])


def _steps(spark: SparkSession) -> DataFrame:
    """Every order, step by step: the subset before the step and the one after it, and the filter alone."""
    rows = []
    for order in permutations(FLAGS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FLAGS.index(letter)
            rows.append(("".join(order), step, before, before | bit, bit))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, before int, after int, bit int")


def audit(flags: DataFrame) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table = written(survivors(flags), "survivors")
    steps = F.broadcast(_steps(flags.sparkSession))
    start = table.select("part", F.col("subset").alias("before"), F.col("n").alias("n0"), F.col("good").alias("good0"), F.col("bad").alias("bad0"))
    end = table.select("part", F.col("subset").alias("after"), F.col("n").alias("n1"), F.col("good").alias("good1"), F.col("bad").alias("bad1"))
    taken = start.join(steps, "before").join(end, ["part", "after"]).withColumn("removed", F.col("n0") - F.col("n1"))
    # the step that comes first has all that fail the filter, the one that comes last those that fail nothing else
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails")
    last = F.max(F.when(F.col("after") == _ALL, F.col("removed"))).alias("unique_fails")
    each = taken.groupBy("part", "bit").agg(fails, last, F.sum("removed").alias("shapley"))
    return taken.join(each, ["part", "bit"]).select(
        "part",
        "filter_order",
        "step",
        F.col("n1").alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        (F.col("good0") - F.col("good1")).alias("good_lost"),
        (F.col("bad0") - F.col("bad1")).alias("toxic_lost"),
        "shapley",
    )
