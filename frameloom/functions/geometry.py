"""Boxes as struct<x1, y1, x2, y2: double> in pixels, and scores over them.

The variants differ in what they do with degenerate boxes and are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Below any area; keeps the division of no common area by no area at 0.
_LEAST = 1e-300


def _zero() -> Column:
    return F.lit(0.0)


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def from_array(values: Column) -> Column:
    """A box of a four-element array; null for any other size."""
    return F.when(F.size(values) == 4, box(*[F.get(values, i) for i in range(4)]))


def to_array(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def xywh(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return F.greatest(_zero(), width(b)) * F.greatest(_zero(), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(_zero(), w) * F.greatest(_zero(), h)


def iou(a: Column, b: Column) -> Column:
    """0 for boxes that are apart or empty.

    The intersection stands in it twice only: longer expressions in join
    conditions grow beyond what the JVM compiles.
    """
    common = intersection(a, b)
    return common / F.greatest(F.lit(_LEAST), area(a) + area(b) - common)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """True wherever iou() is at least ``least`` (above 0), and hardly elsewhere.

    For join conditions: the intersection stands in it once, so its code stays
    small enough to be compiled. The exact test follows on what is left.
    """
    return intersection(a, b) * (1 + least) >= (least - 1e-9) * (area(a) + area(b))


def may_contain(a: Column, b: Column, least: float) -> Column:
    """The same for containment()."""
    return intersection(a, b) >= (least - 1e-9) * F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def iou_floored(a: Column, b: Column) -> Column:
    """The union counts as one square pixel at least."""
    common = intersection(a, b)
    return common / F.greatest(F.lit(1.0), area(a) + area(b) - common)


def iou_smoothed(a: Column, b: Column) -> Column:
    common = intersection(a, b)
    return common / (area(a) + area(b) - common + 1e-6)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the smaller box."""
    return intersection(a, b) / F.greatest(F.lit(_LEAST), F.least(area(a), area(b)))


def containment(a: Column, b: Column) -> Column:
    """The larger of the two shares; areas count as one square pixel at least."""
    return intersection(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def union_agg(b: Column) -> Column:
    """Aggregate: the box around all boxes."""
    return box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"]))


def padded_union(a: Column, b: Column, image_w: float, image_h: float, ratio: float = 0.08) -> Column:
    u = union(a, b)
    px, py = width(u) * ratio, height(u) * ratio
    top_x, top_y = F.lit(float(image_w - 1)), F.lit(float(image_h - 1))
    return box(F.greatest(_zero(), u["x1"] - px), F.greatest(_zero(), u["y1"] - py), F.least(top_x, u["x2"] + px), F.least(top_y, u["y2"] + py))


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2.0


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2.0


def distance(a: Column, b: Column) -> Column:
    """Of the centres."""
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def diagonal(b: Column) -> Column:
    w, h = F.greatest(F.lit(1.0), width(b)), F.greatest(F.lit(1.0), height(b))
    return F.sqrt(w * w + h * h)


def center_distance_ratio(a: Column, b: Column) -> Column:
    """Centre distance against the diagonal of the larger width and height."""
    w, h = F.greatest(width(a), width(b), F.lit(1.0)), F.greatest(height(a), height(b), F.lit(1.0))
    return distance(a, b) / F.sqrt(w * w + h * h)


def aspect(b: Column) -> Column:
    """The longer side against the shorter, sides of one pixel at least."""
    w, h = F.greatest(F.lit(1.0), width(b)), F.greatest(F.lit(1.0), height(b))
    return F.greatest(w / h, h / w)


def shifted(b: Column, dx: Column, dy: Column, w: int, h: int) -> Column:
    """Moved and kept inside the frame, one pixel wide at least."""
    x1 = F.least(F.greatest(_zero(), b["x1"] + dx), F.lit(float(w - 1)))
    y1 = F.least(F.greatest(_zero(), b["y1"] + dy), F.lit(float(h - 1)))
    return box(x1, y1, F.least(F.greatest(x1 + 1.0, b["x2"] + dx), F.lit(float(w))), F.least(F.greatest(y1 + 1.0, b["y2"] + dy), F.lit(float(h))))


def scaled(b: Column, scale: Column, w: int, h: int) -> Column:
    """Scaled about the centre and kept inside; unchanged by scales next to 1."""
    cx, cy, half_w, half_h = center_x(b), center_y(b), width(b) * scale / 2.0, height(b) * scale / 2.0
    x1, y1 = F.greatest(_zero(), cx - half_w), F.greatest(_zero(), cy - half_h)
    grown = box(x1, y1, F.least(F.lit(float(w)), cx + half_w), F.least(F.lit(float(h)), cy + half_h))
    return F.when(F.abs(scale - 1.0) < 1e-3, b).otherwise(grown)


def restored(b: Column, scale_x: Column, scale_y: Column) -> Column:
    """From the resized image back to the frame."""
    return box(b["x1"] / scale_x, b["y1"] / scale_y, b["x2"] / scale_x, b["y2"] / scale_y)


def near_edge(b: Column, w: int, h: int, pixels: float = 24.0, ratio: float = 0.06) -> Column:
    """Edges within the margin joined by ``+``; null without one."""
    mx, my = max(pixels, w * ratio), max(pixels, h * ratio)
    names = F.concat_ws("+", F.when(b["x1"] <= mx, "left"), F.when(b["x2"] >= w - mx, "right"), F.when(b["y1"] <= my, "top"), F.when(b["y2"] >= h - my, "bottom"))
    return F.when(names != "", names)


def touches_border(b: Column, w: int, h: int, border: float = 4.0) -> Column:
    return (b["x1"] <= border) | (b["y1"] <= border) | (b["x2"] >= w - border) | (b["y2"] >= h - border)


def ring(b: Column) -> Column:
    """Corners as a flat ring: x1 y1 x2 y1 x2 y2 x1 y2."""
    return F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])


def clamped_unit(points: Column, w: Column, h: Column) -> Column:
    """Flat x y pairs in units of the frame, inside [0, 1]."""
    one = F.lit(1.0)
    return F.transform(points, lambda v, i: F.greatest(_zero(), F.least(one, F.when(i % 2 == 0, v / w).otherwise(v / h))))


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return (b["x1"] <= x) & (x <= b["x2"]) & (b["y1"] <= y) & (y <= b["y2"])


def center_similarity(a: Column, b: Column) -> Column:
    """exp(-distance / larger side of a)."""
    return F.exp(-distance(a, b) / F.greatest(width(a), height(a), F.lit(1.0)))


def size_similarity(a: Column, b: Column) -> Column:
    """.45 area + .35 aspect ratio + .20 extent, each the smaller against the larger."""
    one = F.lit(1.0)

    def ratio(p: Column, q: Column) -> Column:
        return F.least(p, q) / F.greatest(p, q)

    wa, ha, wb, hb = (F.greatest(one, f(x)) for x in (a, b) for f in (width, height))
    return 0.45 * ratio(wa * ha, wb * hb) + 0.35 * ratio(wa / ha, wb / hb) + 0.20 * ratio(F.greatest(wa, ha), F.greatest(wb, hb))
