"""Operator 6: exact dedup with two passes over a Bloom filter, in DataFrame operations only.

Pass one turns every text's hash into ``probes`` positions of a bitmap and
marks the positions hit twice or more; the positions are counted before they
are shuffled, as one number and its count. The bitmap has ``bits`` bits (16 a
row by default, 2^29 at most), so the broadcast table of its blocks never
exceeds ``probes * bits / 8`` bytes. One probe is the default: a second one
would send as many positions again to clear one row in twenty more. Pass two tests each row: a row one
of whose positions was hit once has no equal and passes straight through;
only the others (repeats and the filter's false positives) shuffle, as id and
digest, never as text. A fuller filter lets more rows shuffle but never changes
the result.

Groups of at least one ``1/heavy`` of the shuffled rows number at most
``heavy`` by counting, so they are broadcast; the rest are joined by digest.

Texts are equal when their UTF-8 bytes are (compared by SHA-256); null counts
as empty. Of equal texts the row with the largest id stays. Repeated rows with
one id count singly and stay together. A row without an id stays only where no
equal one has an id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import bitmaps
from frameloom.llm.shared import heavy_join, only, written


def _marked(digests: DataFrame, bits: int, probes: int) -> DataFrame:
    """The bitmap of the positions that two rows or more hit."""
    places = [F.lit(k * bits) + bitmaps.probe(F.col("text_sha256"), k, bits) for k in range(probes)]
    place = places[0] if probes == 1 else F.explode(F.array(*places))
    hit = digests.select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    return bitmaps.from_positions(hit.select(F.floor(F.col("place") / bits).cast("int").alias("k"), F.pmod("place", F.lit(bits)).alias("position")))


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _found(suspects: DataFrame) -> DataFrame:
    return suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, probes: int = 1, heavy: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(only(docs, doc_id=id_col, text=text_col).select("doc_id", _digest("text").alias("text_sha256")), "digests")
    bits = bits or 2 * bitmaps.bits_for(digests.count())
    marks = written(_marked(digests, bits, probes), "bitmap")
    tested = bitmaps.tested(digests, F.col("text_sha256"), marks, bits, probes)
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "text_sha256")
    suspects = tested.where("maybe").drop("maybe")
    found = written(_found(suspects), "groups")
    shared = heavy_join(suspects, found, "text_sha256", "group_size", heavy).select("doc_id", "keep_id", "group_size", "text_sha256")
    out = alone.unionByName(shared)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, probes: int = 1) -> DataFrame:
    """The documents, all columns, without the rows that an equal text with a larger id replaces.

    Rows that the filter clears pass without a shuffle; only the others meet
    what stays, by digest and id, so that no large group lands in one task.
    """
    digests = written(only(docs, doc_id=id_col, text=text_col).select("doc_id", _digest("text").alias("text_sha256")), "digests")
    bits = bits or 2 * bitmaps.bits_for(digests.count())
    marks = written(_marked(digests, bits, probes), "bitmap")
    staying = _found(bitmaps.tested(digests, F.col("text_sha256"), marks, bits, probes).where("maybe")).select(F.col("text_sha256").alias("_d"), F.col("keep_id").alias("_keep"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest, maybe = bitmaps.free_name(docs.columns, "_digest"), bitmaps.free_name(docs.columns, "_maybe")
    rows = bitmaps.tested(docs.withColumn(digest, _digest(text_col)), F.col(digest), marks, bits, probes, maybe)
    alone, unsure = rows.where(~F.col(maybe)), rows.where(F.col(maybe))
    stay = unsure.join(staying, (unsure[digest] == staying["_d"]) & unsure[id_col].eqNullSafe(staying["_keep"]), "left_semi")
    return alone.select(columns).unionByName(stay.select(columns))
