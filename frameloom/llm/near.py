"""Operator 5: near-duplicates by a join of inverted lists of signature coordinates.

1. A document's set holds the distinct shingles of its words; MinHash takes
   ``coordinates`` values of it. Documents of one set form a class, which the
   least id stands for.
2. Each class is posted under every (coordinate, value) pair. Pairs that only
   one class has are dropped; a class left with fewer than ``matches`` of them
   has no partner. Of two classes that agree in ``matches`` coordinates or
   more, each has a common pair among its rarest ones: all but
   ``matches - 1`` of them. Only this prefix is kept as inverted lists.
3. Lists are merged in two ways. Short ones (SHORT classes at most) give their
   pairs, whose collisions are counted over all coordinates; pairs with
   ``matches`` or more are confirmed on full sets, one by one. Long ones are
   skipped in that merge: classes that meet in a long list belong to one crowd.
   Crowds are dealt into blocks of bounded size, and each pair of blocks is one
   task: there all prefix lists are merged into candidate pairs, collisions are
   counted, pairs with fewer than ``matches`` go, and the rest are confirmed on
   full sets. Pairs whose ends are connected already are skipped, so a task
   returns a spanning forest and never all pairs of a crowd. Short lists leave
   out pairs inside one crowd.
4. Components of the confirmed links give the result.

With 128 coordinates and 83 matches, a pair at a similarity of exactly 0.8 is
missed with a probability of 2e-5, at 0.82 of 1e-6, at 0.85 of 4e-9. Documents
that share a passage of less than 0.65 of what both have are rarely candidates,
so they seldom make a crowd.

Cases: documents without words (null, empty, blank) have an empty set and are
linked with nothing; fewer words than a shingle has are one shingle. Equal
texts link. Repeated rows with one id share their result. Extra columns are
ignored; an empty table gives an empty result. Ids are whole numbers; a row
without one is linked only with rows of equal sets, and keep_one() keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import bitmaps, blobs, shingles
from frameloom.llm import textcols as tc
from frameloom.llm.components import components
from frameloom.llm.shared import heavy_join, written

ID_PROBES = 2
SHORT = 16  # members of a list whose pairs are all counted


def _signed(batches, size: int, coordinates: int):
    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 3 << 20):
            hashes, counts = shingles.shingle_sets(batch.column("text"), size)
            rows = shingles.signatures(hashes, counts, coordinates).view(np.int32)
            raw, ends = memoryview(hashes).cast("B"), np.cumsum(counts) * 8
            keys = [hashlib.blake2b(raw[e - 8 * n : e], digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            has = counts > 0
            offsets = np.r_[0, np.cumsum(has)] * coordinates
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "sig"])


def _sets(batches, size: int):
    """Texts replaced by their packed sets."""
    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 3 << 20):
            hashes, counts = shingles.shingle_sets(batch.column("text"), size)
            ends = np.cumsum(counts)
            packed = [blobs.pack_sorted(hashes[e - n : e]) for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])


class _Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def link(self, a: int, b: int) -> bool:
        p = self.parent
        while p[a] != a:
            a = p[a]
        while p[b] != b:
            b = p[b]
        if a == b:
            return False
        p[max(a, b)] = min(a, b)
        return True


def _met(prefixes: list[np.ndarray], side: np.ndarray, within: bool) -> np.ndarray:
    """Pairs (x < y in code n * x + y) that share a prefix list; of different sides unless ``within``."""
    n = len(prefixes)
    token = np.concatenate(prefixes)
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    seen = np.zeros((n, n), dtype=bool)
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(token)].tolist(), strict=True):
        if e - s > 1:
            who = owner[s:e]
            if within:
                seen[np.ix_(who, who)] = True
            else:
                seen[np.ix_(who[side[who] == 0], who[side[who] == 1])] = True
    return np.flatnonzero(np.triu(seen, 1) if within else seen)


def _overlaps(x: np.ndarray, y: np.ndarray, members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Common members of each pair of sets; ``members`` are column numbers below ``width``."""
    out = np.empty(len(x), dtype=np.int64)
    n = len(starts)
    dense = np.zeros((n, width), dtype=bool) if n * width <= 1 << 27 else None
    owner = np.repeat(np.arange(n), sizes)
    if dense is not None:
        dense[owner, members] = True
    else:
        keys = owner * width + members  # ascending
    first, budget = 0, 1 << 22
    shorter = np.where(sizes[x] <= sizes[y], x, y)
    longer = x + y - shorter
    total = np.cumsum(sizes[shorter])
    while first < len(x):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + budget, side="right")))
        a, b = shorter[first:last], longer[first:last]
        took = members[tc.ranges(starts[a], sizes[a])]
        there = np.repeat(b, sizes[a])
        if dense is not None:
            hit = dense[there, took]
        else:
            want = there * width + took
            hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        out[first:last] = tc.segment_sums(hit.astype(np.int64), np.cumsum(sizes[a]) - sizes[a], sizes[a])
        first = last
    return out


def _confirmed(table: pa.Table, matches: int, percent: int) -> pa.Table:
    """Links of a spanning forest of one pair of blocks."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    left, right = table["i"][0].as_py(), table["j"][0].as_py()
    n = table.num_rows
    if n < 2:
        return none
    table = table.combine_chunks()
    ids = table["doc_id"].to_numpy()
    side = (table["own"].to_numpy() != left).astype(np.int8)
    sig = np.stack([np.asarray(r.values if hasattr(r, "values") else r) for r in table["sig"]])
    prefixes = [np.asarray(r.values) for r in table["prefix"]]
    pairs = _met(prefixes, side, left == right)
    x, y = pairs // n, pairs % n
    count = np.empty(len(x), dtype=np.int16)
    for first in range(0, len(x), 1 << 17):
        s = slice(first, first + (1 << 17))
        count[s] = (sig[x[s]] == sig[y[s]]).sum(axis=1)
    keep = count >= matches
    x, y, count = x[keep], y[keep], count[keep]
    if not len(x):
        return none
    order = np.argsort(-count, kind="stable")
    x, y = x[order], y[order]
    sets = [blobs.unpack_sorted(b) for b in table["shingles"].to_pylist()]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    known, member, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1  # shingles of one document only are in no overlap
    shared = often[member] > 1
    owner = np.repeat(np.arange(n), size)[shared]
    members = column[member[shared]]
    kept = np.bincount(owner, minlength=n)
    starts = np.cumsum(kept) - kept
    # what two sets can share is bounded by their shared shingles and by their sizes
    most = np.minimum(kept[x], kept[y])
    able = 100 * most >= percent * (size[x] + size[y] - most)
    x, y = x[able], y[able]
    forest, found = _Forest(n), []
    step = 1 << 12
    while len(x):
        now_x, now_y, x, y = x[:step], y[:step], x[step:], y[step:]
        common = _overlaps(now_x, now_y, members, starts, kept, int((often > 1).sum()))
        linked = 100 * common >= percent * (size[now_x] + size[now_y] - common)
        for a, b in zip(now_x[linked].tolist(), now_y[linked].tolist(), strict=True):
            if forest.link(a, b):
                found.append((a, b))
        roots = forest.roots()
        open_ = roots[x] != roots[y]
        x, y = x[open_], y[open_]
        step = min(step * 2, 1 << 18)
    a, b = (np.array([f[k] for f in found], dtype=np.int64) for k in (0, 1))
    return pa.table({"a": ids[a], "b": ids[b]}) if found else none


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, coordinates: int = 128) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig), written."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(lambda b: _signed(b, size, coordinates), "doc_id bigint, n_shingles bigint, set_key binary, sig array<int>"), "signed")


def prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """(doc_id, prefix): the rarest shared coordinate-value pairs of each class that can have a partner."""
    pairs = classes.select("doc_id", F.posexplode("sig").alias("k", "v")).select("doc_id", F.shiftleft(F.col("k").cast("bigint"), 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair"))
    often = pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    mine = pairs.join(often.hint("merge"), "pair").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("all"))
    return mine.where(F.size("all") >= matches).select("doc_id", F.expr(f"slice(transform(all, x -> x.pair), 1, size(all) - {matches} + 1)").alias("prefix"))


def _pairs_confirmed(batches, percent: int):
    """Pairs (a, b) whose full sets are similar enough."""
    for batch in batches:
        hit = np.zeros(batch.num_rows, dtype=bool)
        for k, (x, y) in enumerate(zip(batch.column("left_set"), batch.column("right_set"), strict=True)):
            x, y = blobs.unpack_sorted(x.as_py()), blobs.unpack_sorted(y.as_py())
            common = len(np.intersect1d(x, y, assume_unique=True))
            hit[k] = 100 * common >= percent * (len(x) + len(y) - common)
        yield batch.select(["a", "b"]).filter(pa.array(hit))


def short_pairs(posted: DataFrame, lists: DataFrame, crowds: DataFrame, classes: DataFrame, matches: int, short: int) -> DataFrame:
    """(a, b): pairs of short lists, not inside one crowd, that agree in ``matches`` coordinates or more."""
    few = lists.where((F.col("n") > 1) & (F.col("n") <= short)).select("pair")
    docs = posted.join(few.hint("merge"), "pair").groupBy("pair").agg(F.array_sort(F.collect_list("doc_id")).alias("d"))
    each = F.expr("flatten(transform(sequence(0, size(d) - 2), i -> transform(slice(d, i + 2, size(d)), y -> struct(d[i] AS a, y AS b))))")
    pairs = docs.select(F.explode(each).alias("p")).select("p.*").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(crowds.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")).hint("merge"), end, "left")
    pairs = pairs.where("_a is null or _b is null or _a <> _b").select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("doc_id").alias(end), F.col("sig").alias(f"_{end}")).hint("merge"), end)
    same = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.where(same >= matches).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, matches: int, percent: int, block_docs: int = 256, block_shingles: int = 400_000, short: int = SHORT) -> DataFrame:
    """Confirmed links between classes, as (a, b): all of short lists, and a spanning forest of each pair of blocks of a crowd."""
    lead = written(prefixes(classes, matches), "prefixes")
    posted = lead.select("doc_id", F.explode("prefix").alias("pair"))
    lists = written(posted.groupBy("pair").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "lists")
    met = posted.join(lists.where(F.col("n") > short).hint("merge"), "pair").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    crowds = components(met)
    pairs = written(short_pairs(posted, lists, crowds, classes, matches, short), "pairs")
    cand = crowds.join(lead.hint("merge"), crowds["node"] == lead["doc_id"]).select("component", "doc_id", "prefix").join(classes.hint("merge"), "doc_id")
    cand = written(cand.select("doc_id", "component", "prefix", "sig", "n_shingles"), "candidates")
    blocks = cand.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block_docs, F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"), F.count("*").alias("members"))
    placed = heavy_join(cand, written(blocks, "blocks"), "component", "members").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    named = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(cand.select("doc_id")).distinct(), "named")
    bits = bitmaps.bits_for(named.count())
    wanted = bitmaps.from_positions(bitmaps.positions(named, F.col("doc_id"), bits, ID_PROBES).distinct())
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = bitmaps.tested(texts, F.col("doc_id"), written(wanted, "wanted"), bits, ID_PROBES).where("maybe").drop("maybe")
    sets = texts.mapInArrow(lambda b: _sets(b, size), "doc_id bigint, shingles binary").dropDuplicates(["doc_id"])
    sets = written(sets.join(named.hint("merge"), "doc_id", "left_semi"), "sets")
    for end, name in (("a", "left_set"), ("b", "right_set")):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(name)).hint("merge"), end)
    direct = pairs.select("a", "b", "left_set", "right_set").mapInArrow(lambda b: _pairs_confirmed(b, percent), "a bigint, b bigint")
    keyed = placed.join(sets.hint("merge"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "prefix", "sig", "shingles")
    return direct.unionByName(keyed.groupBy("component", "i", "j").applyInArrow(lambda t: _confirmed(t, matches, percent), "a bigint, b bigint"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, coordinates: int = 128, matches: int = 83) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    table = signed(docs, id_col, text_col, size, coordinates)
    classes = written(table.where("n_shingles > 0").groupBy("set_key").agg(F.min_by(F.struct("sig", "n_shingles"), "doc_id").alias("first"), F.min("doc_id").alias("doc_id"), F.count("*").alias("members")).select("set_key", "doc_id", "members", "first.sig", "first.n_shingles"), "classes")
    found = components(links(docs, classes, id_col, text_col, size, matches, percent))
    named = classes.select("set_key", "doc_id", "members").join(found.hint("merge"), classes["doc_id"] == found["node"], "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"), "members")
    full = heavy_join(table.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), written(named, "named"), "set_key", "members").select("doc_id", "n_shingles", "component_id")
    empty = table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, of which one of each group stays (the least id)."""
    gone = written(groups(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    bits = bitmaps.bits_for(gone.count())
    bitmap = written(bitmaps.from_positions(bitmaps.positions(gone, F.col("_gone"), bits, ID_PROBES).distinct()), "gone-bits")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    maybe = bitmaps.free_name(docs.columns, "_maybe")
    rows = bitmaps.tested(docs, F.col(f"`{id_col}`").cast("bigint"), bitmap, bits, ID_PROBES, maybe)
    stay, unsure = rows.where(~F.col(maybe)).select(columns), rows.where(F.col(maybe)).select(columns)
    rest = unsure.join(gone, unsure[id_col].cast("bigint") == gone["_gone"], "left_anti").select(columns)
    return stay.unionByName(rest)
