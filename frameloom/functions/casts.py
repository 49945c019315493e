"""Tolerant casts and values that count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(value: Column, default: int = -1) -> Column:
    """A number in a string, cut toward zero; else the default."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(default).cast("bigint"))


def to_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(default))


def to_bool(value: Column, default: bool = False) -> Column:
    """1/true/yes/y and 0/false/no/n in any case; else the default."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "true", "yes", "y"), True).when(text.isin("0", "false", "no", "n"), False).otherwise(F.lit(default))


def present(value: Column) -> Column:
    """Null for the empty string (after trimming), so that coalesce skips it."""
    return F.when(F.trim(value) != "", value)


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor blank; the empty string without one."""
    return F.coalesce(*[present(v) for v in values], F.lit(""))


def json_or(value: Column, schema: str, default: Column) -> Column:
    """A JSON string as a value; the default if it is missing or malformed."""
    return F.coalesce(F.from_json(value, schema), default)
