"""Files written and read back: logs, twins, annotation documents, snapshots, reports."""

from __future__ import annotations

import tempfile
from datetime import datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom import config, models
from frameloom.functions import geometry as G
from frameloom.operators import masks, perframe, rasters, vectors
from frameloom.parameters import DEFAULTS
from frameloom.plans import views as V
from frameloom.plans.catalog import query
from frameloom.session import shared_folder
from frameloom.sinks import writers
from frameloom.sources import readers

R = lambda c: F.round(c, 6)


@query("S06 S07 K01 K02 K18", "SELECT event_id, user_id, event_type, value FROM events")
def json_lines_round_trip(spark, sf_dir):
    path = shared_folder(spark, "events-jsonl")
    e = V.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    writers.write_jsonl(e.where("event_id % 2 = 0"), path)
    writers.append_jsonl(e.where("event_id % 2 = 1"), path)
    return readers.jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("K03 Z35 S08 S11 S07", f"WITH {V.PROP} SELECT CAST(proposal_id AS VARCHAR) AS proposal_id, predicted_label, CASE WHEN proposal_id % 2 = 0 THEN CAST(cluster_id AS VARCHAR) END AS cluster_id, CASE WHEN proposal_id % 2 = 1 THEN '[' || proposal_id || ',' || cluster_id || ']' END AS both FROM prop")
def twin_files(spark, sf_dir):
    """Parquet and CSV of one stem; the CSV is read, as where the Parquet is missing."""
    path = shared_folder(spark, "twins")
    p, n = V.proposals(spark, sf_dir), F.col("proposal_id")
    writers.write_twins([p.where(n % 2 == 0).select("proposal_id", "predicted_label", "cluster_id"), p.where(n % 2 == 1).select("proposal_id", "predicted_label", F.array("proposal_id", "cluster_id").alias("both"))], path)
    spark.read.csv(f"{path}.csv", header=True).write.option("header", True).csv(f"{path}-alone.csv")
    return readers.table(spark, f"{path}-alone.parquet")


@query("S09", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def footer_counts(spark, sf_dir):
    return spark.createDataFrame([(name, readers.row_count(spark, f"{sf_dir}/{name}.parquet")) for name in ("events", "lineitem", "documents")], "name string, n bigint")


@query(
    "S19",
    f"""WITH {V.DET} SELECT frame_idx * 4 + video_id AS frame_idx, row_number() OVER (PARTITION BY frame_idx, video_id ORDER BY det_id) - 1 AS seq, raw_label AS label, x1 AS left_, y2 AS bottom, CASE WHEN det_id % 3 = 0 THEN 1.0 ELSE round(confidence, 6) END AS confidence FROM det""",
)
def replayed_detections(spark, sf_dir):
    path = shared_folder(spark, "replay")
    d = V.detections(spark, sf_dir)
    one = F.struct("det_id", F.col("raw_label").alias("label"), G.to_array(F.col("bbox")).alias("bbox"), F.when(F.col("det_id") % 3 != 0, F.col("confidence")).alias("confidence"))
    lines = d.groupBy((F.col("frame_idx") * 4 + F.col("video_id")).alias("frame_idx")).agg(F.array_sort(F.collect_list(one)).alias("detections"))
    writers.write_jsonl(lines, path)
    found = readers.detections_replay(spark, path)
    return found.select("frame_idx", F.col("seq").cast("bigint").alias("seq"), "label", F.col("bbox.x1").alias("left_"), F.col("bbox.y2").alias("bottom"), R(F.col("confidence")).alias("confidence"))


def _documents(d, path: str, document, key):
    """One file for each ``key``: a JSON array of the documents."""
    files = d.groupBy(key.alias("file")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(document)), F.lit("]")).alias("text"))
    writers.write_partitioned_text(files, path, "file")


def _era():
    """Files of fifty frames."""
    return F.floor(F.col("frame_idx") / 50) * 4 + F.col("video_id")


@query("S17", f"WITH {V.DET} SELECT video_id || '/' || frame_idx AS image, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) - 1 AS seq, raw_label AS name, x1 AS left_, y2 AS bottom FROM det")
def visor_documents(spark, sf_dir):
    path = shared_folder(spark, "visor")
    d = V.detections(spark, sf_dir)
    corners = F.array(F.array(F.array("bbox.x1", "bbox.y1"), F.array("bbox.x2", "bbox.y1"), F.array("bbox.x2", "bbox.y2")))
    frames = d.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_id", F.col("raw_label").alias("name"), corners.alias("segments")))).alias("annotations"))
    image = F.struct(F.concat_ws("/", "video_id", "frame_idx").alias("image_path"))
    _documents(frames.withColumn("_doc", F.to_json(F.struct(image.alias("image"), "annotations"))), path, F.col("_doc"), _era())
    s = F.col("segments")[0]
    return readers.visor(spark, path).select("image", F.col("seq").cast("bigint").alias("seq"), "name", s[0][0].alias("left_"), s[2][1].alias("bottom"))


@query("S18", f"WITH {V.DET} SELECT det_id, CASE lower(trim(raw_label)) WHEN 'pot' THEN 'cookware' ELSE 'dishware' END AS label, x1 AS left_, y2 AS bottom FROM det WHERE lower(trim(raw_label)) IN ('pot', 'plate') AND det_id % 5 <> 0")
def supervisely_documents(spark, sf_dir):
    path = shared_folder(spark, "supervisely")
    d = V.detections(spark, sf_dir)
    ring = F.array(F.array("bbox.x1", "bbox.y1"), F.array("bbox.x2", "bbox.y2"), F.array(F.col("det_id").cast("double"), F.lit(0.0)))
    shape = F.when(F.col("det_id") % 5 == 0, "bitmap").otherwise("polygon")
    one = F.struct(shape.alias("geometryType"), F.col("raw_label").alias("classTitle"), F.struct(ring.alias("exterior")).alias("points"))
    frames = d.groupBy("video_id", "frame_idx").agg(F.collect_list(one).alias("objects"))
    size = F.struct(F.lit(V.FRAME_H).alias("height"), F.lit(V.FRAME_W).alias("width"))
    _documents(frames.withColumn("_doc", F.to_json(F.struct(size.alias("size"), "objects"))), path, F.col("_doc"), _era())
    names = spark.createDataFrame([("pot", "cookware"), ("plate", "dishware")], "title string, label string")
    p = F.col("points")
    return readers.supervisely(spark, path, names).select(p[4].cast("bigint").alias("det_id"), "label", p[0].alias("left_"), p[3].alias("bottom"))


@query("S16", f"WITH {V.LABELLED} SELECT det_id AS id, 'f' || (frame_idx * 4 + video_id) AS file_name, fine AS label, x1 AS left_, y2 AS bottom, 10 AS numbers FROM lab")
def coco_documents(spark, sf_dir):
    """Annotation documents of fifty frames each, read back with images and categories joined per file."""
    path = shared_folder(spark, "coco")
    d = V.labelled(spark, sf_dir).withColumns({"_image": F.col("frame_idx") * 4 + F.col("video_id"), "file": _era()})
    d = d.withColumn("_category", F.dense_rank().over(Window.partitionBy("file").orderBy("fine")).cast("bigint"))
    ring = G.ring(F.col("bbox"))
    parts = d.groupBy("file").agg(
        F.collect_set(F.struct(F.col("_image").alias("id"), F.concat(F.lit("f"), F.col("_image").cast("string")).alias("file_name"))).alias("images"),
        F.collect_set(F.struct(F.col("_category").alias("id"), F.col("fine").alias("name"))).alias("categories"),
        F.collect_list(F.struct(F.col("det_id").alias("id"), F.col("_image").alias("image_id"), F.col("_category").alias("category_id"), G.xywh(F.col("bbox")).alias("bbox"), F.array(F.slice(ring, 1, 6), F.concat(ring, F.slice(ring, 1, 2))).alias("segmentation"))).alias("annotations"),
    )
    writers.write_partitioned_text(parts.select("file", F.to_json(F.struct("images", "categories", "annotations")).alias("text")), path, "file")
    return readers.coco(spark, path).select("id", "file_name", "label", F.col("bbox.x1").alias("left_"), F.col("bbox.y2").alias("bottom"), F.size("polygon").alias("numbers"))


@query("K14", f"WITH {V.PROP} SELECT 'instances' AS part, count(*) AS n FROM prop UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM prop UNION ALL SELECT 'events', 2 * count(*) FROM events")
def snapshot_counts(spark, sf_dir):
    """Two snapshots: tables are written anew, events behind one another."""
    folder = shared_folder(spark, "snapshot")
    p, e = V.proposals(spark, sf_dir), V.table(spark, sf_dir, "events").select("event_id", "event_type")
    for rows in (p.where("proposal_id % 2 = 0"), p):
        writers.write_snapshot(rows, rows.groupBy("cluster_id").count(), e, folder)
    counts = [spark.read.parquet(f"{folder}/{part}").select(F.lit(part).alias("part")) for part in ("instances", "clusters")]
    events = readers.jsonl(spark, f"{folder}/events", "event_id bigint").select(F.lit("events").alias("part"))
    return counts[0].unionByName(counts[1]).unionByName(events).groupBy("part").agg(F.count("*").alias("n"))


@query("K20 K06 P03", f"WITH {V.PROP} SELECT proposal_id, predicted_label, cluster_id, round(confidence, 6) AS confidence FROM prop")
def review_packets(spark, sf_dir):
    """Packets for a reviewer, without pixels, and what a reader finds in them."""
    p = V.proposals(spark, sf_dir).select("proposal_id", "predicted_label", "cluster_id", "confidence", F.lit("pixels").alias("mask"), F.lit("pixels").alias("depth"))
    packets = writers.packets(writers.without_rasters(p), "proposal_id")
    found = packets.select("proposal_id", F.from_json("packet", "predicted_label string, cluster_id bigint, confidence double, mask string").alias("m"))
    return found.where("m.mask is null").select("proposal_id", "m.predicted_label", "m.cluster_id", R(F.col("m.confidence")).alias("confidence"))


@query("K07 A18", f"WITH {V.DET} SELECT 'Run' || chr(10) || '- frames: ' || count(DISTINCT frame_idx * 4 + video_id) || chr(10) || '- detections: ' || count(*) || chr(10) || '- tracks: ' || count(DISTINCT track_id) || chr(10) AS text FROM det")
def summary_report(spark, sf_dir):
    totals = V.detections(spark, sf_dir).agg(F.countDistinct("frame_idx", "video_id").alias("frames"), F.count("*").alias("detections"), F.countDistinct("track_id").alias("tracks")).first().asDict()
    return spark.createDataFrame([(writers.summary_text(totals, "Run"),)], "text string")


@query(
    "K10 K23",
    f"""WITH {V.LABELLED}, n AS (SELECT fine, row_number() OVER (ORDER BY fine) - 1 AS i FROM (SELECT DISTINCT fine FROM lab)), g AS (SELECT coarse, string_agg('  - "' || fine || '"' || chr(10), '' ORDER BY fine) AS t FROM (SELECT DISTINCT coarse, fine FROM lab) GROUP BY coarse)
    SELECT 'dataset' AS name, 'path: /data' || chr(10) || 'train: images/train' || chr(10) || 'val: images/val' || chr(10) || 'nc: ' || count(*) || chr(10) || 'names:' || chr(10) || string_agg('  ' || i || ': "' || fine || '"', chr(10) ORDER BY i) || chr(10) AS text FROM n
    UNION ALL SELECT 'hierarchy', string_agg(coarse || ':' || chr(10) || t, '' ORDER BY coarse) FROM g""",
)
def dataset_descriptions(spark, sf_dir):
    """The class list and the hierarchy of an export; labels are the taxonomy's, so few."""
    groups: dict[str, list[str]] = {}
    for r in V.labelled(spark, sf_dir).select("coarse", "fine").distinct().toLocalIterator():
        groups.setdefault(r["coarse"], []).append(r["fine"])
    names = sorted({f for fine in groups.values() for f in fine})
    return spark.createDataFrame([("dataset", config.dataset_yaml("/data", names)), ("hierarchy", config.hierarchy_yaml(groups))], "name string, text string")


@query("Z15", f"WITH {V.PROP} SELECT cluster_id, count(*) AS n, CAST(min(proposal_id) AS BIGINT) AS first FROM prop GROUP BY cluster_id UNION ALL SELECT p.cluster_id, -1, p.proposal_id FROM prop p WHERE proposal_id = 7")
def saved_states(spark, sf_dir):
    """Cluster states from a file (an object with a list), and the record of one key."""
    path, p = shared_folder(spark, "states"), V.proposals(spark, sf_dir)
    state = p.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("proposal_id").alias("first"))
    state.agg(F.to_json(F.struct(F.collect_list(F.struct("cluster_id", "n", "first")).alias("clusters"))).alias("value")).coalesce(1).write.text(path)
    one = readers.record(p, "proposal_id", 7).select("cluster_id", F.lit(-1).cast("bigint").alias("n"), F.col("proposal_id").alias("first"))
    return readers.cluster_states(spark, path, "cluster_id bigint, n bigint, first bigint").unionByName(one)


@query("Z07 D03", f"WITH {V.DET} SELECT frame_idx, video_id, label, CASE WHEN side THEN 'scene' ELSE 'object' END AS part FROM (SELECT frame_idx, video_id, raw_label AS label, det_id % 3 = 0 AS side FROM det)")
def detections_apart(spark, sf_dir):
    """A detector that replays the detections, its rows told apart by source."""
    d = V.detections(spark, sf_dir)
    frames = d.select("video_id", "frame_idx", F.to_json(F.struct("raw_label", (F.col("det_id") % 3 == 0).alias("scene"))).cast("binary").alias("image"), F.lit(1).alias("height"), F.lit(1).alias("width"))
    objects, scenes = models.detected_apart(frames, "recorded", [])
    part = lambda rows, name: rows.select("frame_idx", "video_id", "label", F.lit(name).alias("part"))
    return part(objects, "object").unionByName(part(scenes, "scene"))


@query("V08 V07")
def safe_mode_clusters(spark, sf_dir):
    p = V.proposals(spark, sf_dir).withColumn("coarse", F.col("predicted_label"))
    rows, _ = vectors.safe_clusters(p, shared_folder(spark, "clusters"), target=40, most=120)
    return rows.select("proposal_id", "coarse", "bucket", "cluster_key", R(F.col("probability")).alias("probability"))


@query("S02", "SELECT 'v' || v || CASE WHEN v % 2 = 0 THEN '.mp4' ELSE '.MOV' END AS name FROM (SELECT DISTINCT event_id % 4 AS v FROM events)")
def listed_videos(spark, sf_dir):
    """A folder of video files, and files that are none, listed."""
    folder = shared_folder(spark, "videos")
    ids = sorted(r["video_id"] for r in V.detections(spark, sf_dir).select("video_id").distinct().toLocalIterator())  # one for each video
    for name in [f"v{v}{'.mp4' if v % 2 == 0 else '.MOV'}" for v in ids] + ["notes.txt", "deep/v9.jpg"]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(1)
        out.close()
    return readers.videos(spark, folder).select(F.substring_index("path", "/", -1).alias("name"))


@query("Z39", "SELECT * FROM (VALUES ('duckdb', 'OK'), ('no_such_module', 'missing'), ('numpy', 'OK')) t(name, state)")
def capability_rows(spark, sf_dir):
    return spark.createDataFrame(models.capabilities(["duckdb", "no_such_module", "numpy"]), "name string, state string")


@query("S13 S14 P29 P37 Z04 Z05", "SELECT * FROM (VALUES ('detector.name', 'blobs'), ('detector.limit', '0.3'), ('every', '2'), ('broken', 'default'), ('missing', '0'), ('asset', 'own.yaml'), ('run', '20260102_030405_01'), ('window', '9')) t(name, value)")
def layered_settings(spark, sf_dir):
    """Settings on the driver: files over one another, broken and missing ones, the first that exists, a run's folder, a changed record."""
    with tempfile.TemporaryDirectory() as folder:
        root = Path(folder)
        (root / "base.yaml").write_text("detector: {name: none, limit: 0.3}\nevery: 1\n")
        (root / "own.yaml").write_text("detector: {name: blobs}\nevery: 2\n")
        (root / "broken.json").write_text("{")
        found = config.merged(config.read_yaml(root / "base.yaml"), config.read_yaml(root / "own.yaml"))
        now = datetime(2026, 1, 2, 3, 4, 5)
        runs = [config.new_run(root, now).name for _ in range(2)]
        rows = [
            *[(f"detector.{k}", v) for k, v in found["detector"].items()], ("every", found["every"]), ("broken", config.read_json(root / "broken.json", "default")), ("missing", len(config.read_yaml(root / "none.yaml"))),
            ("asset", config.first_existing([root / "none.yaml", root / "own.yaml"]).name), ("run", runs[1]), ("window", DEFAULTS.with_(smoothing_window=9).smoothing_window),
        ]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@query(
    "Z34 K21",
    f"""WITH {V.DET}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) AS n FROM det) SELECT video_id, frame_idx, CAST(2 * (floor((x2 - x1) / 4) + floor((y2 - y1) / 4)) - 4 AS BIGINT) AS pixels FROM o WHERE n = 1""",
)
def drawn_overlays(spark, sf_dir):
    """The outline of each frame's first box on a dark picture of a quarter of its size: how many pixels it has."""
    d = V.detections(spark, sf_dir)
    first = d.groupBy("video_id", "frame_idx").agg(F.min_by(F.struct("raw_label", "bbox"), "det_id").alias("m"), F.min("det_id").alias("det_id"))
    x, y = F.floor(F.col("m.bbox.x1") / 4), F.floor(F.col("m.bbox.y1") / 4)
    wide, high = (F.floor((F.col(f"m.bbox.{b}") - F.col(f"m.bbox.{a}")) / 4) for a, b in (("x1", "x2"), ("y1", "y2")))
    boxes = first.select("video_id", "frame_idx", "det_id", F.col("m.raw_label").alias("label"), x.alias("x1"), y.alias("y1"), (x + wide).alias("x2"), (y + high).alias("y2"))
    h, w = V.FRAME_H // 4, V.FRAME_W // 4
    dark = first.select("video_id", "frame_idx", F.lit(bytes(3 * h * w)).alias("image"), F.lit(h).alias("height"), F.lit(w).alias("width"))

    @F.pandas_udf("bigint")
    def lit(images: pd.Series) -> pd.Series:
        return images.map(lambda b: int((np.frombuffer(b, np.uint8).reshape(-1, 3) > 0).any(axis=1).sum()))

    return rasters.overlays(dark, boxes).select("video_id", "frame_idx", lit("image").alias("pixels"))


@query(
    "Z11",
    f"""WITH {V.DET}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY det_id) AS n FROM det), r AS (SELECT a.det_id, a.video_id, a.frame_idx, a.confidence, CAST({V.sql_area("a.")} - {V.sql_intersection("a.", "b.")} AS BIGINT) AS free FROM o a JOIN o b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND b.n = 1 AND a.n > 1)
    SELECT det_id, video_id, frame_idx, free, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, free DESC, det_id) AS rank FROM r WHERE free >= 500""",
)
def free_proposals(spark, sf_dir):
    """Masks of a frame without the pixels of its first one."""
    d = V.detections(spark, sf_dir).withColumn("runs", masks.of_box(F.col("bbox"), V.FRAME_W))
    first = d.groupBy("video_id", "frame_idx").agg(F.min("det_id").alias("_first"))
    return perframe.free_proposals(d.join(first, ["video_id", "frame_idx"]), F.col("det_id") == F.col("_first"), 500)
