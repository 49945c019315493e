"""Step functions and statistics that scores are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recovery_budget(quality: Column) -> Column:
    """5 to 1 from .92, .85, .75, .65, .55 on; else 0."""
    return F.when(quality >= 0.92, 5).when(quality >= 0.85, 4).when(quality >= 0.75, 3).when(quality >= 0.65, 2).when(quality >= 0.55, 1).otherwise(0)


def secondary_budget(score: Column, margin: Column) -> Column:
    return F.when((score >= 0.78) & (margin >= 0.22), 2).when((score >= 0.58) & (margin >= 0.12), 1).otherwise(0)


def tier(score: Column) -> Column:
    return F.when(score < 0.25, "low").when(score < 0.45, "medium").otherwise("high")


def entropy(counts: Column) -> Column:
    """-sum p ln(p + 1e-9) over an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(total > 0, -F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x / total * F.ln(x / total + 1e-9))).otherwise(0.0)


def stability(values: Column, scale: float = 0.1) -> Column:
    """exp(-population deviation / scale) of an array; .5 below two values."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)
    return F.when(n < 2, 0.5).otherwise(F.exp(-spread / scale))


def clipped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def depth_similarity(a: Column, b: Column, scale: float = 0.12) -> Column:
    return F.exp(-F.abs(a - b) / scale)


def mask_quality_score(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of named terms."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(terms[name], F.lit(0.0)) * weight
    return total


def record_status(score: Column, flagged: Column) -> Column:
    """accepted from .80 and uncertain from .65 without flags; needs_vlm from .45; else rejected."""
    return F.when(score < 0.45, "rejected").when(flagged | (score < 0.65), "needs_vlm").when(score >= 0.80, "accepted").otherwise("uncertain")
