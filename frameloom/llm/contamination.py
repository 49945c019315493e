"""Operator 12: benchmark decontamination, in DataFrame operations only.

The windows of the benchmark's items (``size`` consecutive words; the whole
item where it has fewer) are a set of 64-bit hashes with their words. Every
window of every document is hashed and looked up in the set; a hit counts only
if the words themselves are equal. Documents are scanned once, and only hits
and one row per document leave that scan.

The set is broadcast while it has no more than ``most`` windows. A larger one
is stood for by a bitmap of bounded size (see bitmaps); windows that the bitmap
lets through meet the set in a shuffle, where a window that many documents
share is split like any skewed key.

Hits travel as places. Of a document's places the covered words are counted by
a running maximum of their ends; its items come from the distinct windows that
it holds. Results of a text belong to (id, digest of the text), so repeated
rows of an id each get theirs.

Words: A-Z made small, then runs of digits, letters a-z and everything beyond
ASCII. Cases: null and empty texts have no words; an item without words has no
window; items with equal windows all count; rows of one item_id count once, a
null item_id is the empty string. An empty benchmark leaves every document
clean, an empty table gives an empty result. Extra columns pass through
remove() whatever their names. Documents without an id, ties and texts of any
length are treated like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm import bitmaps
from frameloom.llm.shared import only, written

#: What separates words, before and after A-Z are made small.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hash of the entry that stands for a document itself.
_SELF = 0


def words(text: Column) -> Column:
    """The words of a text; only A-Z are made small (texts beyond ASCII take the slower way)."""
    known = F.coalesce(text, F.lit(""))
    small = F.when(F.length(known) == F.octet_length(known), F.lower(known)).otherwise(F.translate(known, _CAPITALS, _CAPITALS.lower()))
    return F.array_remove(F.split(small, _GAPS), "")


def _codes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _hash(codes: Column, start: Column, n: int) -> Column:
    """Hash of ``n`` codes from the 0-based ``start`` on, fewer where the array ends; compiled, unlike a lambda over slices."""
    return F.xxhash64(*[F.get(codes, start + k) for k in range(n)])


def item_windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, n, gram, item_id): the distinct windows of each item, ``gram`` their words."""
    items = only(benchmark, item_id=id_col, text=text_col).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0")
    n = F.least(F.size("words"), F.lit(size))
    placed = items.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    grams = placed.select("item_id", "n", F.slice("words", F.col("at"), F.col("n")).alias("gram"))
    coded = grams.withColumn("codes", _codes(F.col("gram")))
    return coded.select(_hash(F.col("codes"), F.lit(0), size).alias("hash"), "n", "gram", "item_id").distinct()


def _scanned(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """One row for each document (place 0) and each place and length: doc_id, digest, n_words, words, hash, place, n.

    Places near the end have windows that are too short; their words equal no window of the set.
    """
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"), words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words")).withColumn("codes", F.concat(F.array(F.lit(_SELF).cast("long")), _codes(F.col("words"))))
    entries = rows.select("doc_id", "digest", "n_words", "words", "codes", F.posexplode("codes").alias("place", "code"))
    hashes = [_hash(F.col("codes"), F.col("place"), n) for n in lengths]
    if len(lengths) == 1:
        entries = entries.withColumn("hash", hashes[0]).withColumn("n", F.lit(lengths[0]))
    else:
        entries = entries.select("*", F.posexplode(F.array(*hashes)).alias("k", "hash")).where("place > 0 OR k = 0")
        entries = entries.withColumn("n", F.element_at(F.array(*map(F.lit, lengths)), F.col("k") + 1))
    own = F.col("place") == 0
    return entries.select("doc_id", "digest", "n_words", "words", "place", *[F.when(own, v).otherwise(F.col(c)).alias(c) for c, v in (("hash", _SELF), ("n", 0))])


def hits(docs: DataFrame, grams: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of (doc_id, digest, n_words, place, n, gram_id): every place of a window, and one row with place 0 per row of ``docs``.

    ``grams`` are distinct (gram_id, hash, n, gram).
    """
    found = grams.groupBy("n").count().orderBy("n").collect()  # at most `size` rows
    lengths, total = [r["n"] for r in found] or [1], sum(r["count"] for r in found)
    entries = _scanned(docs, lengths)
    itself = (F.col("place") == 0) & (F.col("g_hash") == _SELF) & (F.col("g_n") == 0)
    same = (F.col("place") > 0) & (F.col("n") == F.col("g_n"))
    spark = docs.sparkSession
    known = grams.select(F.col("gram_id"), F.col("hash").alias("g_hash"), F.col("n").alias("g_n"), "gram")
    header = spark.createDataFrame([(b"", _SELF, 0, [])], "gram_id binary, g_hash long, g_n int, gram array<string>")
    columns = ["doc_id", "digest", "n_words", "place", "n", "gram_id"]
    if total <= most:
        met = entries.join(F.broadcast(known.unionByName(header)), F.col("hash") == F.col("g_hash"))
        return written(met.where(itself | (same & (F.slice("words", F.greatest("place", F.lit(1)), F.col("n")) == F.col("gram")))).select(columns), "hits")
    bits = bitmaps.bits_for(total)
    marks = written(bitmaps.from_positions(bitmaps.positions(known.unionByName(header), F.col("g_hash"), bits, 1)), "bitmap")
    maybe = bitmaps.tested(entries, F.col("hash"), marks, bits, 1).where("maybe")
    own = maybe.where("place = 0").withColumn("gram_id", F.lit(b"")).select(columns)
    windows = maybe.where("place > 0").withColumn("window", F.slice("words", F.col("place"), F.col("n"))).drop("words", "maybe")
    met = windows.join(known, (F.col("hash") == F.col("g_hash")) & same & (F.col("window") == F.col("gram"))).select(columns)
    return written(own.unionByName(met), "hits")


def _covered(found: DataFrame) -> DataFrame:
    """(doc_id, digest, n_hit): the words that some hit covers, each counted once."""
    places = found.groupBy("doc_id", "digest", "place").agg(F.max("n").alias("n"))
    before = Window.partitionBy("doc_id", "digest").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("n")
    fresh = end - F.greatest(F.col("place"), F.least(F.coalesce(F.max(end).over(before), F.col("place")), end))
    return places.withColumn("fresh", fresh).groupBy("doc_id", "digest").agg(F.sum("fresh").alias("n_hit"))


def _items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_items, items): the items of each document, as strings in ascending order."""
    held = found.select("doc_id", "digest", "gram_id").distinct()
    pairs = held.join(windows, "gram_id").select("doc_id", "digest", "item_id").distinct()
    return pairs.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def _prepared(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows with an id, and (gram_id, item_id). A window's id is the digest of its words."""
    windows = written(item_windows(benchmark, size).withColumn("gram_id", F.unhex(F.sha2(F.concat_ws(" ", "gram").cast("binary"), 256))), "windows")
    return windows.select("gram_id", "hash", "n", "gram").distinct(), windows.select("gram_id", "item_id").distinct()


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    grams, windows = _prepared(benchmark, size)
    found = hits(only(docs, doc_id=id_col, text=text_col), grams, most)
    places = found.where("place > 0")
    per_text = _covered(places).withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "d")
    items = _items(places, windows).withColumnRenamed("doc_id", "id2").withColumnRenamed("digest", "d2")
    both = per_text.join(items, F.col("id").eqNullSafe(F.col("id2")) & (F.col("d") == F.col("d2")))
    own = found.where("place = 0")
    rows = own.join(both, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    named = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, size: int = 10, spans: bool = False, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that hold a window, or, with ``spans``, with the words that windows cover cut out.

    A cut takes each covered word and what separates it from the next one.
    """
    grams, _ = _prepared(benchmark, size)
    found = hits(only(docs, doc_id=id_col, text=text_col), grams, most).where("place > 0")
    names = docs.columns
    digest, id_, d, cut = (bitmaps.free_name(names, n) for n in ("_digest", "_id", "_d", "_cut"))
    rows = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)))
    meets = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(d))
    keep = [F.col(f"`{c}`") for c in names]
    if not spans:
        dirty = found.select(F.col("doc_id").alias(id_), F.col("digest").alias(d)).distinct()
        return rows.join(dirty, meets, "left_anti").select(keep)
    # of each document the word ranges between the hits, from the running ends of its hits
    places = found.groupBy("doc_id", "digest", "place").agg(F.max("n").alias("n"))
    before = Window.partitionBy("doc_id", "digest").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    free = places.withColumn("from", F.coalesce(F.max(F.col("place") + F.col("n")).over(before), F.lit(1)))
    ranges = free.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") > F.col("from"), F.struct("from", (F.col("place") - F.col("from")).alias("many"))))).alias("between"), F.max(F.col("place") + F.col("n")).alias("after")
    )
    ranges = ranges.select(F.col("doc_id").alias(id_), F.col("digest").alias(d), F.struct("between", "after").alias(cut))
    text = F.col(f"`{text_col}`")
    gaps, runs = F.split(text, _RUNS), F.regexp_extract_all(text, F.lit(f"({_RUNS})"))
    units = F.zip_with(runs, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda w, g: F.concat(w, F.coalesce(g, F.lit(""))))
    kept = F.concat(F.flatten(F.transform(F.col(cut)["between"], lambda r: F.slice(units, r["from"], r["many"]))), F.slice(units, F.col(cut)["after"], F.greatest(F.size(units) - F.col(cut)["after"] + 1, F.lit(0))))
    cleaned = F.when(F.col(cut).isNull(), text).otherwise(F.concat(gaps[0], F.array_join(kept, "")))
    joined = rows.join(ranges, meets, "left")
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
