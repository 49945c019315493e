"""Exports: JSON lines, twin CSV and Parquet, COCO documents, YOLO label files, reports.

Documents are built as DataFrames (so they can be checked) and written by
Spark's writers.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import geometry as G
from frameloom.operators.windows import running_total


def append_jsonl(d: DataFrame, path: str) -> None:
    d.write.mode("append").json(path)


def write_jsonl(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def without_rasters(d: DataFrame, columns: tuple[str, ...] = ("mask", "image", "depth")) -> DataFrame:
    """The table without columns of pixels."""
    return d.drop(*columns)


def write_twins(parts: list[DataFrame], path: str) -> None:
    """The union of tables, columns in order of first appearance, as CSV (nested values as JSON) and as Parquet."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}.parquet")
    flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def numbered_by_first(d: DataFrame, key: list[str], position: str, name: str) -> DataFrame:
    """One row per key with a number from 1, by first appearance (``position`` is a whole number)."""
    firsts = d.groupBy(*key).agg(F.min(position).alias("_first"))
    return running_total(firsts, "_first", F.lit(1), "_n").withColumn(name, F.col("_n") + 1).drop("_first", "_n")


def coco_tables(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of detections (video_id, frame_idx, det_id, fine, bbox)."""
    images = numbered_by_first(d, ["video_id", "frame_idx"], "det_id", "image_id")
    categories = numbered_by_first(d, ["fine"], "det_id", "category_id")
    rows = d.join(images, ["video_id", "frame_idx"]).join(categories, "fine")
    b = F.col("bbox")
    numbered = rows.withColumn("in_image", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")))
    before = running_total(rows.groupBy("image_id").count(), "image_id", F.col("count"), "before").select("image_id", "before")
    annotations = numbered.join(before, "image_id").select((F.col("before") + F.col("in_image")).alias("id"), "image_id", "category_id", G.xywh(b).alias("bbox"), F.array(G.ring(b)).alias("segmentation"), G.area(b).alias("area"))
    return images, categories, annotations


def coco_documents(d: DataFrame, split: str, documents: int = 1) -> DataFrame:
    """JSON documents of each value of ``split``: one, or so many, dealt by frame (a document's rows must fit a task)."""
    doc = lambda c, *fields: F.array_sort(F.collect_set(F.struct(*fields))).alias(c)
    b = F.col("bbox")
    part = F.pmod(F.xxhash64("frame"), F.lit(documents)).cast("int").alias("part")
    grouped = d.groupBy(split, part).agg(
        doc("images", F.col("frame").alias("file_name")),
        doc("categories", F.col("class_idx").alias("id"), F.col("label").alias("name")),
        F.array_sort(F.collect_list(F.struct(F.col("proposal_id").alias("id"), F.col("frame").alias("image"), F.col("class_idx").alias("category_id"), G.xywh(b).alias("bbox")))).alias("annotations"),
    )
    return grouped.select(split, *(["part"] if documents > 1 else []), F.to_json(F.struct("images", "categories", "annotations")).alias("document"))


def yolo_lines(d: DataFrame, width: str, height: str) -> DataFrame:
    """(frame, text, n): the label file of each frame, six digits; rows without class or with fewer than three points go."""
    unit = G.clamped_unit(F.col("polygon"), F.col(width), F.col(height))
    rows = d.where(F.col("class_idx").isNotNull() & (F.size("polygon") >= 6))
    line = F.concat_ws(" ", F.col("class_idx").cast("string"), F.concat_ws(" ", F.transform(unit, lambda v: F.format_string("%.6f", v))))
    lines = rows.withColumn("_line", line).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("proposal_id", "_line"))).alias("l"), F.count("*").alias("n"))
    return lines.select("frame", F.concat_ws("\n", F.transform("l", lambda x: x["_line"])).alias("text"), "n")


def write_partitioned_text(d: DataFrame, path: str, key: str) -> None:
    d.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def class_folders(d: DataFrame, most: int, seed: int, share: float) -> DataFrame:
    """Crops for class folders: distinct, in a seeded order, capped for each label, split by place."""
    order = Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("crop_path"))), "crop_path")
    rows = d.dropDuplicates(["label", "crop_path"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    n = F.count("*").over(Window.partitionBy("label"))
    return rows.withColumn("split", F.when(F.col("_n") <= F.round(n * (1 - share)), "train").otherwise("val")).drop("_n")


def newest(d: DataFrame, name: str, keep: int) -> DataFrame:
    """Names (distinct) beyond the newest ``keep``, a small number: what housekeeping may delete."""
    return d.join(d.select(name).orderBy(F.col(name).desc()).limit(keep), name, "left_anti")


def summary_text(row: dict, title: str) -> str:
    """A one-row summary as text."""
    return "\n".join([title, *[f"- {k}: {v}" for k, v in row.items()]]) + "\n"


def display_color(label) -> object:
    """A fixed colour of a label: three bytes of its MD5, each from 64 to 255."""
    digest = F.md5(label.cast("binary"))
    channel = lambda i: (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 192 + 64).cast("int")
    return F.array(channel(0), channel(1), channel(2))


def write_snapshot(instances: DataFrame, clusters: DataFrame, events: DataFrame, folder: str) -> None:
    """Instances and clusters anew, events behind those that are there."""
    instances.write.mode("overwrite").parquet(f"{folder}/instances")
    clusters.orderBy("cluster_id").write.mode("overwrite").parquet(f"{folder}/clusters")
    events.write.mode("append").json(f"{folder}/events")


def packets(d: DataFrame, key: str) -> DataFrame:
    """(key, packet): a JSON document for each row, for a reviewer."""
    return d.select(key, F.to_json(F.struct(*[c for c in d.columns if c != key])).alias("packet"))


def to_connector(d: DataFrame, send, at_once: int = 1000) -> None:
    """Rows of each partition handed to ``send(rows)``, so many at once, on the executors."""

    def run(rows):
        rows = iter(rows)
        while some := list(islice(rows, at_once)):
            send(some)

    d.foreachPartition(run)
