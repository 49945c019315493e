"""Operator 9: token ids in files of directly addressable codes.

An id is split into chunks of ``bits`` bits. Level k stores the k-th chunk of
every id that has one, in order, a bitmap that says which of them continue on
level k + 1, and a rank directory: the number of set bits before each 512th.
The i-th id is read by following its chunk down: the place on the next level is
the rank of its bit, one directory entry and at most 512 bits away; no block is
decoded for that.

A file holds whole documents in ascending order of id: header, document ids,
where each starts, and the levels. Files are rows of a Parquet table (written
by Spark's committer, so a lost executor leaves no half files), dealt by ranges
of the id, one for RANGE_BYTES of text; a file knows where it starts in its
range. lookup() reads single ids by document and position.

Cases: null and empty texts are the end id alone; documents with one id lie one
behind the other, ordered by their text's hash, those without an id before all
others (ranges cut by that hash and the row too, so that rows of one id spread);
extra columns are ignored; an empty table gives an empty result. Ids of
documents are whole numbers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textcols as tc
from frameloom.llm import tokenids
from frameloom.operators.windows import running_total
from frameloom.llm.shared import id_array, id_column, tasks_for, written

MAGIC = b"DACF"
VERSION = 1
STRIDE = 512  # bits between two entries of a rank directory
RANGE_BYTES = 16 << 20  # bytes of text for each range of ids
_HEAD = struct.Struct("<4sHBBQQ")  # magic, version, bits, levels, documents, ids


def encode_levels(values: np.ndarray, bits: int = 8) -> list[bytes]:
    """Each level as: number of chunks, chunks, continuation bitmap, rank directory."""
    values, levels = np.asarray(values, dtype=np.uint32), []
    while True:
        chunk = (values & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits <= 8 else np.uint16)
        more = (values >> np.uint32(bits)) > 0
        packed = np.packbits(more, bitorder="little")
        padded = np.r_[packed, np.zeros(-len(packed) % (STRIDE // 8), np.uint8)]
        ones = np.bitwise_count(padded.reshape(-1, STRIDE // 8)).sum(axis=1, dtype=np.uint32)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + padded.tobytes() + directory.tobytes())
        values = values[more] >> np.uint32(bits)
        if not len(values):
            return levels


class Levels:
    """Levels read from bytes; chunks and bitmaps are views."""

    def __init__(self, raw: memoryview, bits: int, levels: int):
        self.bits, self.chunks, self.bitmaps, self.ranks = bits, [], [], []
        kind, at = np.dtype(np.uint8 if bits <= 8 else "<u2"), 0
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            strides = -(-n // STRIDE)
            for kept, dtype, count in ((self.chunks, kind, n), (self.bitmaps, np.dtype(np.uint8), strides * STRIDE // 8), (self.ranks, np.dtype("<u4"), strides)):
                kept.append(np.frombuffer(raw, dtype, count, at))
                at += count * dtype.itemsize

    def get(self, i: int) -> int:
        """The i-th id, without decoding any other."""
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks, strict=True)):
            value |= int(chunks[i]) << (level * self.bits)
            byte, bit = divmod(i, 8)
            if not bitmap[byte] >> bit & 1:
                break
            first = i // STRIDE * (STRIDE // 8)
            i = int(ranks[i // STRIDE]) + int(np.bitwise_count(bitmap[first:byte]).sum(dtype=np.int64)) + (int(bitmap[byte]) & ((1 << bit) - 1)).bit_count()
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at many places, each as get() finds it."""
        places = np.asarray(places, dtype=np.int64)
        out, open_ = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        for level, (chunks, bitmap, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks, strict=True)):
            out[open_] |= chunks[places].astype(np.uint32) << np.uint32(level * self.bits)
            more = (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
            open_, places = open_[more], places[more]
            if not len(open_):
                break
            stride, inside = places // STRIDE, places % STRIDE
            windows = bitmap.reshape(-1, STRIDE // 8)[stride]
            byte = np.arange(STRIDE // 8)
            mask = np.where(byte < (inside >> 3)[:, None], 0xFF, np.where(byte == (inside >> 3)[:, None], (1 << (inside & 7)[:, None]) - 1, 0)).astype(np.uint8)
            places = ranks[stride].astype(np.int64) + np.bitwise_count(windows & mask).sum(axis=1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every id."""
        above = None
        for level in range(len(self.chunks) - 1, -1, -1):
            values = self.chunks[level].astype(np.uint32)
            if above is not None:
                more = np.unpackbits(self.bitmaps[level], count=len(values), bitorder="little").view(bool)
                values[more] |= above << np.uint32(self.bits)
            above = values
        return above


def write_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    """One file of whole documents."""
    levels = encode_levels(ids, bits)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    return _HEAD.pack(MAGIC, VERSION, bits, len(levels), len(doc_ids), len(ids)) + np.asarray(doc_ids, "<i8").tobytes() + starts.tobytes() + b"".join(levels)


class File:
    """A file read from bytes."""

    def __init__(self, raw: bytes):
        magic, version, bits, levels, docs, self.n_ids = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of directly addressable codes")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        self.levels = Levels(memoryview(raw)[at + 8 * docs + 8 * (docs + 1) :], bits, levels)


def _files(batches, path: str, end: int, bits: int, most_ids: int):
    """Rows (part, seq, part_start, tokens, payload); the input is one range, in order."""
    part, seq, done = TaskContext.get().partitionId(), 0, 0
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def flush():
        nonlocal seq, done
        n = sum(len(x) for x in ids)
        row = (part, seq, done, n, write_file(np.concatenate(docs), np.concatenate(sizes), np.concatenate(ids), bits))
        seq, done = seq + 1, done + n
        for kept in (docs, sizes, ids):
            kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.int64()), pa.array([row[3]], pa.int64()), pa.array([row[4]], pa.binary())], names=["part", "seq", "part_start", "tokens", "payload"])

    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 16 << 20):
            if not batch.num_rows:
                continue
            got, n = tokenids.encode(batch.column("text"), path, end)
            docs.append(id_array(batch.column("doc_id")))
            sizes.append(n)
            ids.append(got)
            if sum(len(x) for x in ids) >= most_ids:
                yield flush()
    if ids:
        yield flush()


def write(docs: DataFrame, tokenizer_path: str, end: int = 0, bits: int = 8, most_ids: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Write the files; the table of files (part, seq, part_start, tokens, payload), read again.

    Files in order of (part, seq) hold the documents in ascending order of id.
    ``ranges`` is by default one for RANGE_BYTES of text, the session's number
    of shuffle partitions at least.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(tasks_for(docs.sparkSession), -(-size // RANGE_BYTES))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"), "text")
    ordered = keyed.repartitionByRange(ranges, "doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text").select("doc_id", "text")
    return written(ordered.mapInArrow(lambda b: _files(b, tokenizer_path, end, bits, most_ids), "part int, seq int, part_start bigint, tokens bigint, payload binary"), "dac")


def read(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, first_token, last_token.

    The last two are read by random access, the sum over all ids from the
    decoded levels. Where a range starts among all ids is a running total over
    the ranges, in two levels, which its documents' rows meet in a join.
    """
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("tokens")).alias("n"))  # one row for each range
    base = running_total(totals, "part", F.col("n"), "base", 1 << 12).select("part", "base")

    def run(batches):
        for batch in batches:
            for part, start, payload in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("payload"), strict=True):
                file = File(payload.as_py())
                view = memoryview(np.ascontiguousarray(file.levels.all(), dtype="<u4")).cast("B")
                at = file.starts.tolist()
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                ends = [file.levels.at(p).astype(np.int64) for p in (file.starts[:-1], file.starts[1:] - 1)]
                inside = [pa.array(start + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crc, pa.int64()), *map(pa.array, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(crc), part, np.int32)), id_column(file.doc_ids), *inside], names=["part", "doc_id", "inside", "n_tokens", "ids_crc32", "first_token", "last_token"])

    rows = files.select("part", "part_start", "payload").mapInArrow(run, "part int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, first_token bigint, last_token bigint")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "first_token", "last_token")


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, position, token) of wanted (doc_id, position) rows, by random access; nothing for positions outside.

    The documents of the files say which file has a wanted row; only those rows
    travel, to the files, where no more than their codes is read. With repeated
    ids every document of the id answers.
    """

    def listed(batches):
        for batch in batches:
            for part, seq, payload in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload"), strict=True):
                file = File(payload.as_py())
                n = len(file.doc_ids)
                yield pa.RecordBatch.from_arrays([id_column(file.doc_ids), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(file.starts[:-1]), pa.array(np.diff(file.starts))], names=["doc_id", "part", "seq", "first", "n"])

    def found(batches):
        for batch in batches:
            for payload, rows in zip(batch.column("payload"), batch.column("rows").to_pylist(), strict=True):
                file = File(payload.as_py())
                tokens = file.levels.at(np.array([r["first"] + r["position"] for r in rows], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["position"] for r in rows], pa.int64()), pa.array(tokens.astype(np.int64))], names=["doc_id", "position", "token"])

    index = files.select("part", "seq", "payload").mapInArrow(listed, "doc_id bigint, part int, seq int, first bigint, n bigint")
    asked = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("position").cast("bigint").alias("position")).join(index, "doc_id").where("position >= 0 and position < n")
    chunk = F.pmod(F.xxhash64("doc_id", "position"), F.lit(64)).alias("chunk")  # a file's rows come in so many lists
    lists = asked.groupBy("part", "seq", chunk).agg(F.collect_list(F.struct("doc_id", "first", "position")).alias("rows"))
    return files.select("part", "seq", "payload").join(lists, ["part", "seq"]).select("payload", "rows").mapInArrow(found, "doc_id bigint, position bigint, token bigint")
