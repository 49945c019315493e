"""Mask pictures: PNG files as masks.

Files come as a DataFrame with ``content`` (as Spark's binaryFile source gives
it); a task decodes its own. Pixels above 0 are set; a picture of another size
is brought to the wanted one by nearest neighbour. Non-interlaced pictures of 8
bits, grey or colour, with or without alpha are read; others, broken and null
ones give a null mask.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Signature and channel counts of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encoded(grey: np.ndarray) -> bytes:
    """A grey picture as PNG."""
    h, w = grey.shape
    lines = np.zeros((h, w + 1), dtype=np.uint8)
    lines[:, 1:] = grey

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decoded(content: bytes | None) -> np.ndarray | None:
    """Grey values of a picture; None for what can't be read."""
    try:
        return _decoded(bytes(content)) if content else None
    except (struct.error, zlib.error, ValueError, IndexError):
        return None


def _decoded(content: bytes) -> np.ndarray | None:
    if not content.startswith(SIGNATURE):
        return None
    at, header, body = len(SIGNATURE), None, []
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[6]:
        return None
    w, h, k = header[0], header[1], CHANNELS[header[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h, w * k), dtype=np.uint8)
    above = np.zeros(w * k, dtype=np.int64)
    for y in range(h):
        line, how = lines[y, 1:].astype(np.int64), lines[y, 0]
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = np.cumsum(line.reshape(w, k), axis=0).reshape(-1) & 255
        elif how in (3, 4):
            _undo(line, above, k, how)
        out[y] = line
        above = line
    values = out.reshape(h, w, k)
    if k < 3:
        return values[:, :, 0]
    return np.rint(values[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _undo(line: np.ndarray, above: np.ndarray, k: int, how: int) -> None:
    """Filters that depend on the value before and the one above, value by value."""
    for x in range(len(line)):
        a, b, c = (line[x - k] if x >= k else 0), above[x], (above[x - k] if x >= k else 0)
        if how == 3:
            line[x] = (line[x] + (a + b) // 2) & 255
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            line[x] = (line[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255


def resized(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour: the pixel at the floor of the scaled place."""
    h, w = mask.shape
    rows = np.minimum((np.arange(height) * (h / height)).astype(np.int64), h - 1)
    columns = np.minimum((np.arange(width) * (w / width)).astype(np.int64), w - 1)
    return mask[np.ix_(rows, columns)]


def masks(files: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """The files' rows with ``runs``, ``height`` and ``width`` in place of ``content``."""
    from frameloom.operators.masks import encode

    columns = [c for c in files.columns if c != "content"]
    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for content in batch["content"]:
                mask = decoded(content)
                if mask is not None and height is not None and mask.shape != (height, width):
                    mask = resized(mask, height, width)
                found.append((None, None, None) if mask is None else ([{"s": s, "n": n} for y, line in enumerate(mask) for s, n in ((y * mask.shape[1] + a, b) for a, b in encode(line))], *mask.shape))
            yield batch[columns].assign(runs=[r for r, _, _ in found], height=[h for _, h, _ in found], width=[w for _, _, w in found])

    return files.select(*columns, "content").mapInPandas(run, f"{kinds}, runs array<struct<s: bigint, n: bigint>>, height int, width int")
