"""Operator 8: packing of tokenized documents into sequences by local search.

Documents longer than a sequence are cut into full pieces and a rest; full
pieces are sequences of their own. The others are dealt by hash into groups of
bounded size. A group is packed best fit, longest first; then a local search
moves documents, exchanges one for one or two for one, between bins that are
not full, always so that the sum of squared fills grows, working on the least
filled bin first, until no bin has a move that helps. Bins that are still
underfull (below ``underfull``, 98 %) are gathered from all groups and packed
again, until one group holds them or a round saves no bin (the packing before
stays); every round but the last saves one, so rounds end.

Cases: null and empty texts are the end id alone; ties in length go by id and
piece; repeated rows are packed as documents of their own; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textcols as tc
from frameloom.llm import tokenids
from frameloom.llm.shared import only, written


def _cut(batches, path: str, capacity: int, end: int):
    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 8 << 20):
            ids, sizes = tokenids.encode(batch.column("text"), path, end)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            first = (np.cumsum(sizes) - sizes)[row] + start
            view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    free: list[int] = []  # distinct free sizes, ascending
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(free, lengths[item])
        if at == len(free):
            bins.append([])
            b, left = len(bins) - 1, capacity
        else:
            left = free[at]
            b = open_at[left].pop()
            if not open_at[left]:
                del open_at[left], free[at]
        bins[b].append(item)
        left -= lengths[item]
        if left:
            if left not in open_at:
                open_at[left] = []
                insort(free, left)
            open_at[left].append(b)
    return bins


def improved(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between bins that are not full, until no donor improves; never more bins than before.

    A donor without an improvement is tried again against the bins that changed
    since. Documents and pairs of a donor count by their length, once each.
    """
    size = np.array(lengths, dtype=np.int64)
    fill = np.array([size[b].sum() for b in bins], dtype=np.int64)
    active = np.flatnonzero(fill < capacity)
    if len(active) < 2:
        return bins
    item = np.array([i for b in active for i in bins[b]], dtype=np.int64)
    home = np.repeat(active, [len(bins[b]) for b in active])
    length = size[item]
    moves = 0
    changed = np.zeros(len(bins), dtype=np.int64)  # the last move of each bin
    tried = np.full(len(bins), -1, dtype=np.int64)  # the last move before a donor was given up
    while True:
        left = active[(fill[active] > 0) & (fill[active] < capacity) & (tried[active] < moves)]
        if len(left) == 0:
            break
        donor = int(left[np.argmin(fill[left])])
        mine = np.flatnonzero(home == donor)
        fresh = np.flatnonzero((home != donor) & (changed[home] > tried[donor]) & (fill[home] < capacity))
        best = (0, None)
        emptier = active[(fill[active] > 0) & (active != donor) & (changed[active] > tried[donor])]
        kinds, first = np.unique(length[mine], return_index=True)
        for total, m in zip(kinds.tolist(), mine[first].tolist(), strict=True):  # a move
            fits = emptier[capacity - fill[emptier] >= total]
            if len(fits):
                to = int(fits[np.argmax(fill[fits])])
                gain = 2 * total * int(fill[to] - fill[donor] + total)
                if gain > best[0]:
                    best = (gain, ((m,), None, to))
        if len(fresh):  # an exchange for one
            # of equal lengths and fills, one stands for all
            pairs = np.unique(np.stack([length[fresh], fill[home[fresh]]]), axis=1, return_index=True)
            back = fresh[pairs[1]]
            theirs, filled = length[back], fill[home[back]]
            ways = {int(k): (int(m),) for k, m in zip(kinds, mine[first], strict=True)}
            for x, k in enumerate(kinds.tolist()):
                same = mine[length[mine] == k]
                if len(same) > 1:
                    ways.setdefault(2 * k, (int(same[0]), int(same[1])))
                for y in range(x + 1, len(kinds)):
                    ways.setdefault(k + int(kinds[y]), (int(mine[first[x]]), int(mine[first[y]])))
            totals = np.array(sorted(ways), dtype=np.int64)
            for at in range(0, len(totals), 256):
                less = totals[at : at + 256, None] - theirs[None, :]
                gain = np.where((less > 0) & (less <= capacity - filled), 2 * less * (filled - fill[donor] + less), 0)
                x, y = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[x, y] > best[0]:
                    best = (int(gain[x, y]), (ways[int(totals[at + x])], int(back[y]), int(home[back[y]])))
        if best[1] is None:
            tried[donor] = moves
            continue
        who, back, to = best[1]
        moved = int(length[list(who)].sum()) - (int(length[back]) if back is not None else 0)
        home[list(who)] = to
        if back is not None:
            home[back] = donor
        fill[to] += moved
        fill[donor] -= moved
        moves += 1
        changed[[to, donor]] = moves
        tried[[to, donor]] = -1
    out = [list(b) for b in bins]
    for b in active:
        out[b] = item[home == b].tolist()
    return [b for b in out if b]


def _packed(table: pa.Table, capacity: int, round_no: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]).combine_chunks()
    lengths = table["length"].to_pylist()
    bins = improved(best_fit(lengths, capacity), lengths, capacity)
    rows = np.array([i for b in bins for i in b], dtype=np.int64)
    bin_no = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    size = np.array(lengths, dtype=np.int64)[rows]
    ends = np.cumsum(size)
    first = np.r_[True, bin_no[1:] != bin_no[:-1]]
    offset = ends - size - np.repeat((ends - size)[first], [len(b) for b in bins])
    fill = np.bincount(bin_no, weights=size).astype(np.int64)
    group = table["group"][0].as_py()
    out = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"]).take(pa.array(rows))
    return out.append_column("sequence_id", pa.array((np.int64(round_no) << 48) | (np.int64(group) << 24) | bin_no)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bin_no]))


def _packer(capacity: int, round_no: int):
    return lambda table: _packed(table, capacity, round_no)


_PACKED = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint, sequence_id bigint, offset bigint, fill bigint"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 1, group_size: int = 4096, underfull: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = only(docs, doc_id=id_col, text=text_col).mapInArrow(lambda b: _cut(b, tokenizer_path, capacity, end), schema)
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # deals repeated rows of one id apart
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, round_no = pieces.where(F.col("length") < capacity), 1
    before, waiting = float("inf"), rest.count()
    while waiting:
        n = max(1, -(-waiting // group_size))
        dealt = rest.select("doc_id", "piece", "start", "length", "ids_crc32", "row", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(n)).alias("group"))
        now = written(dealt.groupBy("group").applyInArrow(_packer(capacity, round_no), _PACKED.format(kind)), "packed")
        bins = now.where(F.col("offset") == 0).count()
        if bins >= before:  # no bin saved: the packing before stays
            done = done.unionByName(rest.select(names))
            break
        last = n == 1
        settled = now if last else now.where(F.col("fill") >= underfull * capacity)
        done = done.unionByName(settled.select(names))
        if last:
            break
        rest, round_no = now.where(F.col("fill") < underfull * capacity), round_no + 1
        before, waiting = rest.where(F.col("offset") == 0).count(), rest.count()
    return done.select(names)
