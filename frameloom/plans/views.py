"""Video annotation tables made of the test tables, in Spark and as SQL.

Only whole-number arithmetic decides the values, so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import taxonomy as T
from frameloom.functions import geometry as G

FRAME_W, FRAME_H = 520, 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(d: DataFrame, key: str) -> DataFrame:
    """Rows dealt over as many tasks as shuffles have, for long work on each: a small file is one task's, and small shuffles are put together again."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_LABELS = {"click": ["Pot", "frying pan", "kettle"], "view": ["pot lid", "lid", "pot lid"], "purchase": [" Plate ", "bowl", "plate"], "signup": ["hand", "hand", "arm"], "error": ["knife", "countertop", "kitchen wall"]}
_SOURCES = ["track_persist", "memory_sam", "grounding_dino_rescue", "secondary_clip"]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detection: ids, raw label, confidence, bbox struct, track, source, confirmed."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    # looked up in literals: a small expression wherever a plan repeats it
    names = F.create_map(*[x for kind, three in _LABELS.items() for x in (F.lit(kind), F.array(*map(F.lit, three)))])
    label = F.try_element_at(F.try_element_at(names, F.col("event_type")), (n % 3 + 1).cast("int"))
    source = F.element_at(F.array(*[F.lit(s) for s in [*_SOURCES, *["yolo_world"] * (9 - len(_SOURCES))]]), (n % 9 + 1).cast("int"))
    like = F.when(F.floor(n / 4) % 5 == 4, n - 4).otherwise(n)  # some boxes lie next to the frame's box before
    x, y = (like * 37) % 300 + (n - like), (like * 53) % 200 + (n - like)
    track = F.col("user_id") % 13 - 1
    return e.select(
        n.alias("det_id"),
        (n % 4).alias("video_id"),
        F.floor(n / 40).cast("bigint").alias("frame_idx"),
        label.alias("raw_label"),
        F.least(F.lit(0.99), 0.05 + F.col("value") / 100.0).alias("confidence"),
        G.box(x, y, x + 60 + (like * 17) % 160, y + 60 + (like * 29) % 140).alias("bbox"),
        track.alias("track_id"),
        source.alias("source"),
        ((track >= 0) & (n % 11 != 0)).alias("confirmed"),
    )


def _cases(column: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def sql_tracking_coarse(column: str) -> str:
    return _cases(column, T.inverted(T.TRACKING_GROUPS), f"trim({column})")


def sql_review_coarse(column: str) -> str:
    return f"CASE {sql_normalize(column)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.inverted(T.REVIEW_HIERARCHY).items()) + " ELSE 'unknown' END"


def sql_fine(column: str) -> str:
    return _cases(column, T.FINE_SYNONYMS, f"coalesce(nullif(trim({column}), ''), 'unknown')")


def sql_normalize(column: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({column}), '\\s+', ' ', 'g')), ''), 'unknown')"


def sql_in(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_rank(column: str, ranks: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"


def sql_area(a: str) -> str:
    return f"(greatest(0.0, {a}x2 - {a}x1) * greatest(0.0, {a}y2 - {a}y1))"


def sql_intersection(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


def sql_iou(a: str, b: str) -> str:
    i = sql_intersection(a, b)
    u = f"({sql_area(a)} + {sql_area(b)} - {i})"
    return f"(CASE WHEN {i} > 0 AND {u} > 0 THEN {i} / {u} ELSE 0.0 END)"


def sql_containment(a: str, b: str) -> str:
    i = sql_intersection(a, b)
    return f"greatest({i} / greatest(1.0, {sql_area(a)}), {i} / greatest(1.0, {sql_area(b)}))"


def sql_overlap(a: str, b: str) -> str:
    i, m = sql_intersection(a, b), f"least({sql_area(a)}, {sql_area(b)})"
    return f"(CASE WHEN {i} > 0 AND {m} > 0 THEN {i} / {m} ELSE 0.0 END)"


def sql_distance(a: str, b: str) -> str:
    dx = f"(({a}x1 + {a}x2) / 2.0 - ({b}x1 + {b}x2) / 2.0)"
    dy = f"(({a}y1 + {a}y2) / 2.0 - ({b}y1 + {b}y2) / 2.0)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def sql_diagonal(a: str) -> str:
    w, h = f"greatest(1.0, {a}x2 - {a}x1)", f"greatest(1.0, {a}y2 - {a}y1)"
    return f"sqrt({w} * {w} + {h} * {h})"


_LABEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(names)) + " END" for k, names in _LABELS.items()) + " END"
_SOURCE_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_SOURCES)) + " ELSE 'yolo_world' END"

#: The detections view for a WITH clause; boxes as four columns.
DET = f"""det AS (
    SELECT event_id AS det_id, event_id % 4 AS video_id, CAST(floor(event_id / 40) AS BIGINT) AS frame_idx,
           {_LABEL_SQL} AS raw_label, least(0.99, 0.05 + value / 100.0) AS confidence,
           CAST((m * 37) % 300 + d AS DOUBLE) AS x1, CAST((m * 53) % 200 + d AS DOUBLE) AS y1,
           CAST((m * 37) % 300 + d + 60 + (m * 17) % 160 AS DOUBLE) AS x2,
           CAST((m * 53) % 200 + d + 60 + (m * 29) % 140 AS DOUBLE) AS y2,
           user_id % 13 - 1 AS track_id, {_SOURCE_SQL} AS source,
           (user_id % 13 - 1 >= 0 AND event_id % 11 <> 0) AS confirmed
    FROM (SELECT *, event_id - CASE WHEN (event_id // 4) % 5 = 4 THEN 4 ELSE 0 END AS m, CASE WHEN (event_id // 4) % 5 = 4 THEN 4 ELSE 0 END AS d FROM events))"""

#: The same with coarse and fine labels.
LABELLED = f"""{DET},
lab AS (SELECT *, {sql_tracking_coarse("raw_label")} AS coarse, {sql_fine("raw_label")} AS fine FROM det)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with coarse (tracking) and fine labels."""
    from frameloom.functions import labels as L

    return detections(spark, sf_dir).withColumns({"coarse": L.tracking_coarse(F.col("raw_label")), "fine": L.fine(F.col("raw_label"))})


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object proposals made of the embeddings table: cluster, label, status, confidence, area, vector."""
    v = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    names = ["pot", "pan", "lid", "plate", "bowl", "cup", "knife", "spoon", "sponge", "gadget"]
    human = F.when(n % 4 == 0, F.element_at(F.array(*map(F.lit, names)), ((F.col("label") + n % 3) % 10 + 1).cast("int"))).otherwise("")
    status = F.element_at(F.array(*map(F.lit, ["unreviewed", "reviewed", "uncertain", "deleted", "corrected"])), (n % 5 + 1).cast("int"))
    return v.select(
        n.alias("proposal_id"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("label") + 1).cast("int")).alias("predicted_label"),
        human.alias("human_label"),
        (n % 17 - 1).alias("cluster_id"),
        status.alias("status"),
        ((n * 31) % 100 / 100.0).alias("confidence"),
        ((n * 97) % 9000 + 25.0).alias("area"),
        ((n * 13) % 100 / 100.0).alias("probability"),
        ((n * 7) % 100 / 100.0).alias("outlier"),
        F.concat(F.lit("f"), (n % 60).cast("string")).alias("frame"),
        F.col("embedding"),
    )


_NAMES_SQL = "['pot','pan','lid','plate','bowl','cup','knife','spoon','sponge','gadget']"
PROP = f"""prop AS (
    SELECT vec_id AS proposal_id, {_NAMES_SQL}[label + 1] AS predicted_label,
           CASE WHEN vec_id % 4 = 0 THEN {_NAMES_SQL}[(label + vec_id % 3) % 10 + 1] ELSE '' END AS human_label,
           vec_id % 17 - 1 AS cluster_id, ['unreviewed','reviewed','uncertain','deleted','corrected'][vec_id % 5 + 1] AS status,
           (vec_id * 31) % 100 / 100.0 AS confidence, (vec_id * 97) % 9000 + 25.0 AS area, (vec_id * 13) % 100 / 100.0 AS probability,
           (vec_id * 7) % 100 / 100.0 AS outlier, 'f' || (vec_id % 60) AS frame, embedding FROM embeddings)"""
