"""Fixed-size Bloom bitmaps in DataFrame operations only.

A bitmap is a table of at most ``probes * bits / 32768`` rows of 4096 bytes, and
has at most MOST_BITS bits, so its broadcast has a bound. Where it fills up,
more rows are let through; rows that belong are never turned away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 8 * 4096  # bits of one value of bitmap_construct_agg


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bits_for(rows: int) -> int:
    """Eight bits a row, as a power of two between 2^20 and 2^28 (32 MB a probe to broadcast)."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(8 * rows - 1, 1).bit_length()))


def probe(value: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits))


def positions(rows: DataFrame, value: Column, bits: int, probes: int) -> DataFrame:
    """(k, position) of every row and probe."""
    return rows.select(F.posexplode(F.array(*[probe(value, k, bits) for k in range(probes)])).alias("k", "position"))


def from_positions(hit: DataFrame) -> DataFrame:
    """(k, block, bitmap) with the given positions set."""
    return hit.groupBy("k", F.shiftright("position", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("position") % BLOCK_BITS).alias("bitmap"))


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    """False for a null bitmap."""
    within = position % BLOCK_BITS
    byte = F.conv(F.hex(bitmap.substr((F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that is not taken, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def tested(rows: DataFrame, value: Column, bitmap: DataFrame, bits: int, probes: int, name: str = "maybe") -> DataFrame:
    """``rows`` with a column ``name``: false where the bitmap proves that the value is not in it."""
    names = rows.columns
    maybe = F.lit(True)
    for k in range(probes):
        b, m = free_name(names, f"_block{k}"), free_name(names, f"_bitmap{k}")
        part = F.broadcast(bitmap.where(F.col("k") == k).select(F.col("block").alias(b), F.col("bitmap").alias(m)))
        rows = rows.join(part, F.shiftright(probe(value, k, bits), 15) == F.col(b), "left")
        maybe = maybe & _bit_is_set(F.col(m), probe(value, k, bits))
    return rows.select(*[F.col(f"`{c}`") for c in names], maybe.alias(name))
