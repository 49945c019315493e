"""Operator 10: media columns in the ISO base media file format.

``store`` puts a payload into a file of nested boxes: one track of raw 8-bit
samples whose frames have equal sizes, some of them key frames, with the sample
tables that say where they lie. ``describe`` walks the boxes of any such file,
decodes the sample tables (time to sample, sample to chunk, sample size, chunk
offset, sync sample), and gives codec, duration and the byte ranges of the key
frames; it never touches the payload.

Cases: a null or empty text is one frame of spaces; very long texts switch to
64-bit chunk offsets and box sizes where 32 bits don't do. Equal texts have
equal files; repeated rows, extra columns and empty tables do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.llm import textcols as tc
from frameloom.llm.shared import only

FRAME = 192  # bytes of one frame
TIMESCALE = 48_000  # samples a second; a frame lasts FRAME samples
FRAMES_IN_CHUNK = 16
KEY_EVERY = 8
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    """With spaces up to a positive multiple of ``unit``."""
    return raw + b" " * (unit - len(raw) if len(raw) < unit else -len(raw) % unit)


MOST = 0xFFFFFFFF  # the largest size, duration and offset of 32 bits


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size > MOST:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """A file with ``payload`` (a positive multiple of FRAME bytes) as raw 8-bit samples."""
    frames = len(payload) // FRAME
    duration = frames * FRAME
    wide = duration > MOST
    times = struct.pack(">QQIQ" if wide else ">IIII", 0, 0, TIMESCALE, duration)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    full_chunks, rest = divmod(frames, FRAMES_IN_CHUNK)
    runs = [(1, FRAMES_IN_CHUNK)] * (full_chunks > 0) + [(full_chunks + 1, rest)] * (rest > 0)
    chunks = full_chunks + (rest > 0)
    keys = np.arange(1, frames + 1, KEY_EVERY).astype(">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")
    large = 2 * len(payload) + 4096 > MOST  # no offset can be so large otherwise

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAMES_IN_CHUNK * FRAME)
        table = box(
            b"stbl",
            _full(b"stsd", 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", 0, struct.pack(">I", len(runs)), *[struct.pack(">III", c, n, 1) for c, n in runs]),
            _full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            _full(b"co64" if large else b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            _full(b"mdhd", 0, times, struct.pack(">HH", 0x55C4, 0), version=int(wide)),
            _full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
            box(b"minf", _full(b"smhd", 0, bytes(4)), box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1))), table),
        )
        track = _full(b"tkhd", 7, struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">hhHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=int(wide))
        header = _full(b"mvhd", 0, times, struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=int(wide))
        return box(b"moov", header, box(b"trak", track, media))

    data = box(b"mdat", payload)
    first = len(head) + len(movie(0)) + len(data) - len(payload)
    return head + movie(first) + data


def walk(raw: bytes | memoryview, start: int = 0, end: int | None = None, above: tuple[bytes, ...] = ()):
    """(path, first byte of the body, its end) of every box, outer ones first."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", raw, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*above, kind), body, start + size
        if kind in _NESTED:
            yield from walk(raw, body, start + size, (*above, kind))
        start += size


@dataclass
class Track:
    """What the sample tables of a track say."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # first byte of each sample
    sizes: np.ndarray
    keys: np.ndarray  # numbers of the key frames, from 0

    @property
    def key_ranges(self) -> np.ndarray:
        """First byte and end of each key frame."""
        return np.stack([self.offsets[self.keys], self.offsets[self.keys] + self.sizes[self.keys]], axis=1)

    @property
    def feature(self) -> str:
        ranges = self.key_ranges
        return f"codec={self.codec.strip()};seconds={self.duration / self.timescale:.6f};samples={len(self.sizes)};keys={len(ranges)};key_bytes={int((ranges[:, 1] - ranges[:, 0]).sum())};key_ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"


def describe(raw: bytes | memoryview) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    tracks: list[dict] = []
    for path, a, b in walk(raw):
        if path[-1] == b"trak":
            tracks.append({})
        elif b"trak" in path and path[-1] not in _NESTED:
            tracks[-1].setdefault(path[-1], (a, b))
    return [_track(raw, t) for t in tracks]


def _table(raw, at: int, dtype: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", raw, at + 4)
    found = np.frombuffer(raw, dtype, n * columns, at + 8).astype(np.int64)
    return found.reshape(n, columns) if columns > 1 else found


def _track(raw, boxes: dict) -> Track:
    at = boxes[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", raw, at + 20) if raw[at] else struct.unpack_from(">II", raw, at + 12)
    codec = bytes(raw[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
    same, n = struct.unpack_from(">II", raw, boxes[b"stsz"][0] + 4)
    sizes = np.full(n, same, np.int64) if same else np.frombuffer(raw, ">u4", n, boxes[b"stsz"][0] + 12).astype(np.int64)
    chunks = _table(raw, boxes[b"co64"][0], ">u8") if b"co64" in boxes else _table(raw, boxes[b"stco"][0], ">u4")
    runs = _table(raw, boxes[b"stsc"][0], ">u4", 3)
    lasting = np.diff(np.r_[runs[:, 0], len(chunks) + 1]) if len(runs) else np.zeros(0, np.int64)
    in_chunk = np.repeat(runs[:, 1], lasting)
    firsts = np.cumsum(in_chunk) - in_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks, in_chunk)[:n] + before - np.repeat(before[np.minimum(firsts, max(n - 1, 0))] if n else firsts, in_chunk)[:n]
    times = _table(raw, boxes[b"stts"][0], ">u4", 2)
    if len(times) and int((times[:, 0] * times[:, 1]).sum()) != duration:
        raise ValueError("sample times do not add up to the track's duration")
    keys = _table(raw, boxes[b"stss"][0], ">u4") - 1 if b"stss" in boxes else np.arange(n)
    return Track(codec, timescale, duration, offsets, sizes, keys)


def payload_of(raw: bytes | memoryview, track: Track) -> bytes:
    """The samples of a track, in order; runs that lie one behind the other are read at once."""
    if not len(track.sizes):
        return b""
    cut = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(track.sizes)] - 1
    view = memoryview(raw)
    return b"".join(view[a:b] for a, b in zip(track.offsets[first].tolist(), (track.offsets[last] + track.sizes[last]).tolist(), strict=True))


def _rows(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 16 << 20):
            out = []
            for text in tc.plain(batch.column("text")).cast(pa.binary()).to_pylist():
                media = store(padded(text))
                track = describe(media)[0]
                payload = payload_of(media, track)
                out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), track.feature))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read it back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(_rows, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media (the file), codec, seconds, key_ranges (array of first byte and end)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in tc.pieces_of(whole, "text", 4 << 20):
                media = [store(padded(t)) for t in tc.plain(batch.column("text")).cast(pa.binary()).to_pylist()]
                tracks = [describe(m)[0] for m in media]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary()), pa.array([t.codec.strip() for t in tracks], pa.string()), pa.array([t.duration / t.timescale for t in tracks], pa.float64()), pa.array([t.key_ranges.tolist() for t in tracks], pa.list_(pa.list_(pa.int64())))], names=["doc_id", "media", "codec", "seconds", "key_ranges"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, media binary, codec string, seconds double, key_ranges array<array<bigint>>")
