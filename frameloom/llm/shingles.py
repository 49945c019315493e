"""Word shingles of documents and their MinHash signatures, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from frameloom.llm import textcols as tc


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's word shingles, ascending, flat, and each text's number.

    Words are runs of bytes that are no blanks, A-Z made small. A text with
    words but fewer than ``size`` has its whole sequence as its one shingle.
    """
    import xxhash

    f = xxhash.xxh3_64_intdigest
    docs = tc.words(texts)
    by_word = np.array([f(w) for w in docs.words.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    stream = by_word[docs.codes] if len(docs.codes) else np.zeros(0, np.uint64)
    n = np.where(docs.counts >= size, docs.counts - size + 1, (docs.counts > 0).astype(np.int64))
    at = tc.ranges(docs.starts, n)
    width = np.repeat(np.minimum(docs.counts, size), n)
    value = np.repeat(np.minimum(docs.counts, size).astype(np.uint64), n)
    for k in range(size):
        inside = k < width
        nxt = stream[np.minimum(at + k, max(len(stream) - 1, 0))] if len(stream) else stream
        value = np.where(inside, _mixed(value * np.uint64(0x9E3779B97F4A7C15) + nxt), value)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    return value[keep], np.bincount(doc[keep], minlength=len(n)).astype(np.int64)


def multipliers(count: int, seed: int = 1) -> np.ndarray:
    """Odd multipliers of the hash functions: a fixed sequence."""
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """For each non-empty set, the least 32-bit hash under each function."""
    full = counts[counts > 0]
    starts = np.cumsum(full) - full
    out = np.empty((len(full), coordinates), dtype=np.uint32)
    if len(full):
        for k, a in enumerate(multipliers(coordinates)):
            out[:, k] = np.minimum.reduceat(((hashes * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out
