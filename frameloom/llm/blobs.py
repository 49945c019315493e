"""Compact binary columns for arrays of numbers that travel through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    planes = values.view(np.uint8).reshape(len(values), 8).T
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    raw = planes[:used].tobytes()
    return len(values).to_bytes(8, "little") + bytes([used]) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.zeros((8, n), dtype=np.uint8)
    if used and n:
        raw = _CODEC.decompress(blob[9:], decompressed_size=used * n, asbytes=True)
        planes[:used] = np.frombuffer(raw, dtype=np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers, as their differences."""
    values = np.asarray(values, dtype=np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def join(*parts: bytes) -> bytes:
    """Several blobs as one."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out
