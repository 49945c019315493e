"""Column-at-a-time text handling on Arrow arrays.

Texts are split into units in C++ and every distinct unit of a batch is worked
on once; documents are then rows of unit codes. All functions take a plain
Arrow string array; nulls count as empty.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_LOWER_AND_BLANK = np.arange(256, dtype=np.uint8)
_LOWER_AND_BLANK[65:91] += 32
_LOWER_AND_BLANK[list(BLANKS)] = 0x20
_BLANK_ONLY = np.arange(256, dtype=np.uint8)
_BLANK_ONLY[list(BLANKS)] = 0x20


@dataclass
class Units:
    """Documents as codes of distinct units.

    ``codes[starts[d] : starts[d] + counts[d]]`` are document d's units.
    """

    words: pa.StringArray
    codes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum over each document of a number for each distinct unit."""
        return segment_sums(values[self.codes], self.starts, self.counts)


def segment_sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values[start : start + count]; zero for empty segments.

    Segments must lie one behind the other in ascending order of start.
    """
    out = np.zeros((len(starts), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … start + count - 1 of each pair, one behind the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def plain(column) -> pa.StringArray:
    """A contiguous string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def through(texts: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    """Every byte replaced by ``table[byte]``; the table must keep UTF-8 valid."""
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    mapped = table[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(mapped))


def words(texts, lower: bool = True) -> Units:
    """Words are maximal runs of bytes that are no blanks; A-Z made small on request."""
    spaced = through(plain(texts), _LOWER_AND_BLANK if lower else _BLANK_ONLY)
    parts = pc.split_pattern(spaced, " ")
    flat = parts.flatten()
    ends = np.asarray(parts.offsets)[: len(parts) + 1].astype(np.int64)
    ends -= ends[0] if len(ends) else 0
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    counts = np.diff(ends)
    if empty >= 0:
        keep = codes != empty
        counts = segment_sums(keep.astype(np.int64), ends[:-1], counts)
        codes = codes[keep]
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    return Units(coded.dictionary, codes, starts, counts)


def coded_lists(texts: pa.StringArray, separator: str) -> Units:
    """The parts between separators, empty ones included; one part for an empty text."""
    parts = pc.split_pattern(texts, separator)
    flat = parts.flatten()
    ends = np.asarray(parts.offsets)[: len(parts) + 1].astype(np.int64)
    ends -= ends[0] if len(ends) else 0
    coded = flat.dictionary_encode()
    return Units(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends[:-1], np.diff(ends))


def with_special(fast: Units, special: np.ndarray, lists: list[list[str]]) -> Units:
    """``fast`` with the parts of the documents at ``special`` replaced by ``lists``."""
    if not len(special):
        return fast
    extra = pa.array([w for parts in lists for w in parts], pa.string())
    sizes = np.array([len(parts) for parts in lists], dtype=np.int64)
    keep = np.ones(len(fast.starts), dtype=bool)
    keep[special] = False
    kept = ranges(fast.starts[keep], fast.counts[keep])
    both = pa.concat_arrays([fast.words, extra]).dictionary_encode()
    index = both.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    old, new = index[: len(fast.words)], index[len(fast.words) :]
    counts = fast.counts.copy()
    counts[special] = sizes
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    codes = np.empty(int(counts.sum()), dtype=np.int32)
    codes[ranges(starts[keep], counts[keep])] = old[fast.codes[kept]]
    codes[ranges(starts[special], sizes)] = new
    return Units(both.dictionary, codes, starts, counts)


def codepoints(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, and where each string starts (one more at the end)."""
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = strings.buffers()
    if data is None or not len(strings):
        return np.zeros(0, np.uint32), np.zeros(len(strings) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]
    joined = bytes(memoryview(data)[at[0] : at[-1]]).decode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def byte_rows(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings, and where each string starts (one more at the end)."""
    _, offsets, data = strings.buffers()
    if data is None or not len(strings):
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 24 << 20):
    """Slices of a batch with at most ``most`` bytes of text each (one row at least)."""
    at = batch.schema.get_field_index(column)
    sizes = pc.binary_length(plain(batch.column(at))).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_TRIM = _trimmer()
