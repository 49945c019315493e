"""Set algebra on masks given as runs, as one sweep over their borders in DataFrame operations.

Every run gives two borders: at its start the depth of its side grows by one,
at its end it falls. Running sums of the depths, row of pixels by row of
pixels, tell where any mask of side a and any of side b lies, so one sweep is
the union of any number of masks on each side and any combination of the two.
Borders are summed by place before the sweep, and a window holds one row of
pixels of one key, however many masks meet there. Keys are frames or single
masks, so what one key has is bounded by a frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import runlists


def combined(parts: DataFrame, keys: list[str], width: int, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, runs) of the pixels for which ``keep(in a, in b)`` holds.

    ``parts`` has the keys, ``runs`` (see masks; none crosses the end of a row)
    and ``side``, 'a' or 'b'. Runs of one side may overlap and come in any
    order. Keys without such a pixel give no row. Null runs are empty.
    """
    # masks are dealt by key as they are, before they grow into borders; all that follows needs no other exchange
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select(*keys, "side", "runs").repartition(tasks, *keys)
    rows = dealt.select(*keys, "side", F.explode("runs").alias("r")).where("r.n > 0")
    depth = lambda side, by: F.when(F.col("side") == side, by).otherwise(0)
    border = lambda place, by: F.struct(place.alias("at"), depth("a", by).alias("da"), depth("b", by).alias("db"))
    line = F.floor(F.col("r.s") / width).alias("line")
    borders = rows.select(*keys, line, F.explode(F.array(border(F.col("r.s"), 1), border(F.col("r.s") + F.col("r.n"), -1))).alias("e"))
    places = borders.groupBy(*keys, "line", F.col("e.at").alias("at")).agg(F.sum("e.da").alias("da"), F.sum("e.db").alias("db"))
    here = Window.partitionBy(*keys, "line").orderBy("at")
    inside = keep(F.sum("da").over(here) > 0, F.sum("db").over(here) > 0)
    swept = places.withColumn("inside", inside)
    turns = swept.withColumn("was", F.lag("inside", 1, False).over(here)).where("inside <> was")
    ends = turns.withColumn("end", F.lead("at").over(here)).where("inside")
    return ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("end") - F.col("at")).alias("n")))).alias("runs"))


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "runs", F.lit("a").alias("side")).unionByName(b.select(*keys, "runs", F.lit("b").alias("side")))


def union(masks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """All masks of a key as one."""
    return combined(masks.select(*keys, "runs", F.lit("a").alias("side")), keys, width, lambda a, b: a)


def without(masks: DataFrame, taken: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The pixels of a key's masks that none of its ``taken`` masks has."""
    return combined(_sides(masks, taken, keys), keys, width, lambda a, b: a & ~b)


def common(masks: DataFrame, others: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The pixels that masks of both sides have."""
    return combined(_sides(masks, others, keys), keys, width, lambda a, b: a & b)


def of_box(bbox: Column, width: int, height: int, grid: int = 1, by: Column | int = 0) -> Column:
    """Runs of a box on a grid of ``grid`` pixels, grown by a disc of radius ``by`` (0 or a Column of 0 or more) as masks are, inside the frame.

    A disc grows a box by its half width at each row's distance from the box,
    so no pixel is looked at. Boxes without a cell have no runs.
    """
    zero = F.lit(0).cast("long")
    cell = lambda v: F.floor(v / grid).cast("long")
    x1, y1 = F.greatest(zero, cell(bbox["x1"])), F.greatest(zero, cell(bbox["y1"]))
    x2, y2 = F.least(F.lit(width).cast("long"), cell(bbox["x2"])), F.least(F.lit(height).cast("long"), cell(bbox["y2"]))
    by = F.lit(by).cast("long") if isinstance(by, int) else by.cast("long")

    def run(y: Column) -> Column:
        away = F.greatest(zero, y1 - y, y - (y2 - 1))
        half = F.rint(F.sqrt((by * by - away * away).cast("double"))).cast("long")
        start, end = F.greatest(zero, x1 - half), F.least(F.lit(width).cast("long"), x2 + half)
        return F.struct((y * width + start).alias("s"), (end - start).alias("n"))

    rows = F.sequence(F.greatest(zero, y1 - by), F.least(F.lit(height - 1).cast("long"), y2 - 1 + by))
    return F.when((x2 > x1) & (y2 > y1), F.transform(rows, run)).otherwise(F.array().cast("array<struct<s: bigint, n: bigint>>"))


def dilated(runs: Column, radius: int, width: int, height: int) -> Column:
    """Runs grown by a disc; they may overlap, as combined() allows. Runs must not cross the end of a row."""
    kernel = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in runlists.reach(radius)])
    zero = F.lit(0).cast("long")

    def grown(r: Column) -> Column:
        y, x = F.floor(r["s"] / width).cast("long"), r["s"] % width
        moved = lambda k: F.struct(
            ((y + k["dy"]) * width + F.greatest(zero, x - k["half"])).alias("s"), (F.least(F.lit(width).cast("long"), x + r["n"] + k["half"]) - F.greatest(zero, x - k["half"])).alias("n")
        )
        return F.transform(F.filter(kernel, lambda k: (y + k["dy"] >= 0) & (y + k["dy"] < height)), moved)

    return F.flatten(F.transform(runs, grown))
