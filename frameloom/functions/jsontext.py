"""JSON inside free text, as reviewing models return it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def braces(text: Column) -> Column:
    """What lies between the outermost braces, fences dropped; null without an opening brace."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    open_only = F.regexp_extract(text, r"(?s)\{.*", 0)
    return F.when(found != "", found).when(open_only != "", repaired(open_only))


def repaired(text: Column) -> Column:
    """An unfinished object with its quote and braces closed."""
    trimmed = F.regexp_replace(text, r"(?s)[\s,:`]+$", "")
    quotes = F.length(trimmed) - F.length(F.translate(trimmed, '"', ""))
    closed = F.when(quotes % 2 == 1, F.concat(trimmed, F.lit('"'))).otherwise(trimmed)
    missing = (F.length(closed) - F.length(F.translate(closed, "{", ""))) - (F.length(closed) - F.length(F.translate(closed, "}", "")))
    return F.concat(closed, F.repeat(F.lit("}"), F.greatest(F.lit(0), missing)))


def response(text: Column, schema: str) -> Column:
    """The object in a response; null if there is none."""
    return F.from_json(braces(text), schema)
