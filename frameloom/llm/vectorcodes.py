"""Operator 13: vectors as short codes, entries found by a VA-file.

Components become integers, a vector is cut into equal consecutive parts, and
every part is coded by the nearest entry of its position's codebook (integer
squared distance, ties to the lower entry). Codebooks start from the vectors
with the least ids and are moved to the floor of the mean of their parts in a
fixed number of rounds.

The nearest entry is found as in a VA-file. Each coordinate of a codebook is
quantised to a few bits: its cells lie between the quantiles of the entries, and
an entry is kept as the cells of its coordinates. A part that looks for its
entry gets a table of the least and the greatest squared distance to each cell
of each coordinate; their sums bound the distance to every entry from below and
above. Only entries whose lower bound is at most the least upper bound are
measured. All of it is integer arithmetic, so the bounds and the choice are
exact.

A round is one pass over the written integer vectors. Each task sums the parts
of its rows by position and entry; Spark adds these sums, and what reaches the
driver are the codebooks, whose size depends on the parameters alone.

Cases: null vectors, those with a null or non-finite component, those whose
length is no positive multiple of ``parts`` or differs from that of the least
kept id, and those with a component beyond ``limit()`` (about 32,768 before
scaling, for 64 components), whose squares a 64-bit sum can't hold, are left
out. Rows without an id come last among those that start a codebook, ties by
the vector itself; fewer vectors than entries make smaller codebooks. Null
labels are one label. Repeated rows count each. Without any vector the result
is empty. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.shared import heavy_join, only, written


def limit(length: int) -> int:
    """The greatest component whose squared distances, summed over a vector, fit 64 bits."""
    return int((2**63 / length) ** 0.5 / 2) - 1


@dataclass
class Cells:
    """The VA-file of one codebook: ``cells[e, j]`` is the cell of entry e in coordinate j, which spans low[j, cell] to high[j, cell]."""

    entries: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, bits: int = 2) -> Cells:
        """Cells hold equal shares of a coordinate's distinct values; equal values share a cell."""
        count, width = entries.shape
        cells = np.zeros((count, width), dtype=np.int64)
        low, high = (np.zeros((width, 1 << bits), dtype=np.int64) for _ in range(2))
        for j in range(width):
            values, place = np.unique(entries[:, j], return_inverse=True)
            cell = np.arange(len(values)) * (1 << bits) // max(len(values), 1 << bits)
            cells[:, j] = cell[place]
            for c in np.unique(cell):
                low[j, c], high[j, c] = values[cell == c][0], values[cell == c][-1]
        return Cells(entries, cells, low, high)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each part, and how many distances were measured."""
        rows, width = parts.shape
        below, above = self.low[None] - parts[:, :, None], parts[:, :, None] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        # the cell's far end: the greater of the distances to its two ends
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower, upper = (np.zeros((rows, len(self.entries)), dtype=np.int64) for _ in range(2))
        for j in range(width):
            lower += least[:, j, self.cells[:, j]]
            upper += most[:, j, self.cells[:, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        far = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(far, first)
        hit = np.flatnonzero(far == np.repeat(best, np.diff(np.r_[first, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # the lowest entry of those at the least distance
        return entry[hit], best, len(row)


@dataclass
class Codebooks:
    """Entries by part: parts x entries x coordinates, integers."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Vectors (components before scaling) of rows of entry numbers."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1) / self.scale


def whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, v) of the kept rows, ``v`` the integer components."""
    rows = only(vectors, vec_id=id_col, vector=vector_col, label=label_col).where("vector IS NOT NULL AND size(vector) > 0").where(F.size("vector") % parts == 0)
    top = F.floor(F.sqrt(F.lit(2.0**63) / F.size("vector")) / 2) - 1
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.floor(x.cast("double") * scale).cast("double")) <= top.cast("double")))
    real = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= 2.0**31))  # before floor(), whose result must fit
    kept = rows.where(real).where(fits)
    return kept.select("vec_id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def train(vectors: DataFrame, length: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of a written table from whole(), all of whose vectors have ``length`` components."""
    width = length // parts
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        tables = [Cells.of(books[p]) for p in range(parts)]

        def sums(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
            for batch in batches:
                m = _matrix(batch, length).reshape(-1, parts, width)
                for p, table in enumerate(tables):
                    if len(m):
                        entry, _, _ = table.nearest(m[:, p])
                        count[p] += np.bincount(entry, minlength=entries)
                        np.add.at(total[p], entry, m[:, p])
            part, entry = np.nonzero(count)
            place = np.tile(np.arange(width), len(part))
            part, entry = np.repeat(part, width), np.repeat(entry, width)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, entry, place, count[part, entry], total[part, entry, place])], ["part", "entry", "place", "n", "total"])

        moved = vectors.select("v").mapInArrow(sums, "part long, entry long, place long, n long, total long")
        # as wide decimals: the sum over all rows may need more than 64 bits
        for r in moved.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of a table from whole()."""
    parts, _, width = books.entries.shape
    tables = [Cells.of(b) for b in books.entries]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch, parts * width).reshape(-1, parts, width)
            if not len(m):
                continue
            found = [t.nearest(m[:, p]) for p, t in enumerate(tables)]
            digits = np.stack([e for e, _, _ in found], axis=1).astype(np.uint8)
            codes = pa.array([row.tobytes().hex() for row in digits], pa.string())
            error = np.sum([far for _, far, _ in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part, so there can be 256 entries at most")
    ints = written(whole(vectors, id_col, vector_col, label_col, scale, parts), "vectors")
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("length")).first()
    if first is None:
        return ints.select("vec_id", *[F.lit("").cast(kind).alias(name) if kind == "string" else F.lit(0).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    same = ints.where(F.size("v") == first["length"])
    books = train(same, first["length"], parts, entries, rounds, scale)
    rows = written(encode(same, books).withColumn("named", F.coalesce(F.col("label").cast("string"), F.lit(""))), "codes")
    labels = written(rows.groupBy("named").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "labels")
    met = heavy_join(rows, labels, "named", "size")
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
