"""Tables, logs and annotation files.

Paths go through Spark's readers only, so any file system that Spark knows will
do. Formats: JSON lines, header CSV, Parquet with CSV fallback, COCO, VISOR and
Supervisely JSON, YOLO label text, NumPy matrices, video files by name.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import geometry as G

VIDEO_ENDINGS = ("mp4", "mov", "avi", "mkv", "webm")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table, malformed lines are errors, blank ones are skipped."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all columns as strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; the CSV of the same stem where that cannot be read."""
    if not path.endswith(".parquet"):
        return csv(spark, path)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return csv(spark, path.removesuffix(".parquet") + ".csv")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a table; of Parquet from its footers alone."""
    if not path.endswith(".parquet"):
        return csv(spark, path).count()
    key = "spark.sql.parquet.aggregatePushdown"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return table(spark, path).count()
    finally:
        spark.conf.set(key, old)


def frames(spark: SparkSession, path: str, schema: str, stride: int = 1, start: float | None = None, end: float | None = None, most: int | None = None) -> DataFrame:
    """Frame rows of the stride and the time range, at most so many in order of video and frame."""
    d = spark.read.schema(schema).parquet(path).where(F.col("frame_index") % stride == 0)
    if start is not None:
        d = d.where(F.col("timestamp") >= start)
    if end is not None:
        d = d.where(F.col("timestamp") <= end)
    return d.orderBy("video_path", "frame_index").limit(most) if most else d


def videos(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Paths of video files, in order."""
    glob = "*.{" + ",".join([*VIDEO_ENDINGS, *map(str.upper, VIDEO_ENDINGS)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder).select("path").orderBy("path")


def detections_replay(spark: SparkSession, path: str) -> DataFrame:
    """Recorded detections: of several lines for a frame the last counts; missing confidence is 1."""
    raw = spark.read.schema("frame_idx bigint, detections array<struct<label: string, bbox: array<double>, confidence: double>>").json(path).withColumn("_line", F.monotonically_increasing_id())
    last = raw.groupBy("frame_idx").agg(F.max_by("detections", "_line").alias("detections"))
    return last.select("frame_idx", F.posexplode("detections").alias("seq", "d")).select("frame_idx", "seq", F.col("d.label").alias("label"), G.from_array(F.col("d.bbox")).alias("bbox"), F.coalesce("d.confidence", F.lit(1.0)).alias("confidence"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of COCO files with image and category, boxes as corners, the largest polygon."""
    schema = "images array<struct<id: bigint, file_name: string, width: int, height: int>>, categories array<struct<id: bigint, name: string>>, annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, segmentation: array<array<double>>, area: double>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    images = doc.select("_file", F.explode("images").alias("i")).select("_file", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    names = doc.select("_file", F.explode("categories").alias("c")).select("_file", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    rows = doc.select("_file", F.explode("annotations").alias("a")).select("_file", "a.*")
    x, y, w, h = (F.get("bbox", i) for i in range(4))
    largest = F.aggregate("segmentation", F.array().cast("array<double>"), lambda a, p: F.when(F.size(p) > F.size(a), p).otherwise(a))
    return rows.join(images, ["_file", "image_id"], "left").join(names, ["_file", "category_id"], "left").select("id", "image_id", "file_name", "width", "height", "label", G.box(x, y, x + w, y + h).alias("bbox"), largest.alias("polygon"), "area")


def visor(spark: SparkSession, path: str) -> DataFrame:
    """VISOR frame documents: one row per annotation with its segments."""
    schema = "image struct<image_path: string, name: string>, annotations array<struct<name: string, segments: array<array<array<double>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.coalesce("image.image_path", "image.name").alias("image"), F.posexplode("annotations").alias("seq", "a")).select("image", "seq", F.col("a.name").alias("name"), F.col("a.segments").alias("segments"))


def supervisely(spark: SparkSession, path: str, label_map: DataFrame) -> DataFrame:
    """Polygon objects of mapped classes with three points or more."""
    schema = "size struct<height: int, width: int>, objects array<struct<geometryType: string, classTitle: string, points: struct<exterior: array<array<double>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    rows = doc.select("file", "size.height", "size.width", F.explode("objects").alias("o"))
    rows = rows.where((F.col("o.geometryType") == "polygon") & (F.size("o.points.exterior") >= 3))
    return rows.withColumn("title", F.lower(F.trim("o.classTitle"))).join(label_map, "title").select("file", "width", "height", "label", F.flatten("o.points.exterior").alias("points"))  # the map is a fixed dimension


def yolo_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, pos, class_id, points) of label files; lines without a number in front are skipped."""
    rows = spark.read.text(folder, wholetext=True).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1))
    lines = rows.select("stem", F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    parts = lines.select("stem", F.filter(F.transform("lines", lambda x: F.split(x, r"\s+")), lambda p: p[0].try_cast("double").isNotNull()).alias("rows"))
    return parts.select("stem", F.posexplode("rows").alias("pos", "p")).select("stem", "pos", F.col("p")[0].cast("double").cast("int").alias("class_id"), F.transform(F.slice("p", 2, 10_000), lambda x: x.try_cast("double")).alias("points"))


def npy(spark: SparkSession, path: str, name: str = "embedding") -> DataFrame:
    """Rows of NumPy matrices with their number: (embedding_idx, vector)."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                for first in range(0, len(matrix), 4096):
                    part = matrix[first : first + 4096]
                    yield pd.DataFrame({"embedding_idx": np.arange(first, first + len(part)), name: list(part.astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"embedding_idx bigint, {name} array<float>")


def record(d: DataFrame, key: str, value) -> DataFrame:
    """The row of a key (none if there is none; of several the first by all columns)."""
    return d.where(F.col(key) == value).orderBy(*[c for c, t in d.dtypes if not t.startswith("map")]).limit(1)


def cluster_states(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Saved cluster states: a JSON list of them, or an object with the list under ``clusters``; without a file no rows."""
    kind = f"array<struct<{fields}>>"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], fields)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<clusters: {kind}>")["clusters"])
    return raw.select(F.explode(listed).alias("s")).select("s.*")


def synthetic_proposals(images: DataFrame, labels: list[str], width: int, height: int) -> DataFrame:
    """One to five boxes for each image, decided by a hash of its id."""
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 8), 16, 10).cast("bigint")
    part = lambda salt, n: number("image_id", F.col("i").cast("string"), F.lit(salt)) % n
    n = number("image_id", F.lit("n")) % 5 + 1
    rows = images.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    x, y = part("x", width // 2), part("y", height // 2)
    return rows.select("image_id", "i", F.element_at(F.array(*map(F.lit, labels)), (part("l", len(labels)) + 1).cast("int")).alias("label"), G.box(x, y, x + 10 + part("w", width // 2 - 10), y + 10 + part("h", height // 2 - 10)).alias("bbox"), (0.3 + part("c", 70) / 100.0).alias("confidence"))
