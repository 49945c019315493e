"""Media containers: byte-exact storage, and boxes read by hand."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import isomedia as M
from tests.llm.conftest import ODD


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_payload_comes_back(raw):
    payload = M.padded(raw)
    assert len(payload) % M.FRAME == 0 and payload.startswith(raw) and not payload[len(raw) :].strip(b" ")
    media = M.store(payload)
    (track,) = M.describe(media)
    assert M.payload_of(media, track) == payload
    assert track.codec == "raw " and track.duration == len(payload) and track.timescale == M.TIMESCALE
    frames = [payload[i : i + M.FRAME] for i in range(0, len(payload), M.FRAME)]
    assert [media[a:b] for a, b in track.key_ranges.tolist()] == frames[:: M.KEY_EVERY]


def test_boxes_nest_and_fill_the_file():
    media = M.store(M.padded(b"x" * 10_000))
    found = list(M.walk(media))
    top = [(p, a, b) for p, a, b in found if len(p) == 1]
    assert [p[0] for p, _, _ in top] == [b"ftyp", b"moov", b"mdat"] and top[-1][2] == len(media)
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stco") in [p for p, _, _ in found]


@pytest.mark.parametrize("most", [100, 2000, 40_000])
def test_wide_forms_come_back(most, monkeypatch):
    """The 64-bit forms of sizes, durations and offsets, as for files of more than 4 GB."""
    monkeypatch.setattr(M, "MOST", most)
    payload = M.padded(bytes(range(256)) * 60)
    media = M.store(payload)
    paths = {p[-1] for p, _, _ in M.walk(media)}
    (track,) = M.describe(media)
    assert (b"co64" in paths) == (2 * len(payload) + 4096 > most) != (b"stco" in paths)
    assert M.payload_of(media, track) == payload and track.duration == len(payload) and track.timescale == M.TIMESCALE
    assert [media[a:b] for a, b in track.key_ranges.tolist()] == [payload[i : i + M.FRAME] for i in range(0, len(payload), M.FRAME)][:: M.KEY_EVERY]
    (data,) = [(a, b) for p, a, b in M.walk(media) if p == (b"mdat",)]
    assert media[data[0] : data[1]] == payload and data[1] == len(media)


def test_tables_that_store_does_not_write():
    """Sample sizes one by one, 64-bit offsets, several runs, no sync table, large boxes, a last box of size 0."""
    sizes, chunks = [3, 4, 5, 6], [1000, 2000, 3000]
    stbl = M.box(
        b"stbl",
        M._full(b"stsd", 0, struct.pack(">I", 1), M.box(b"avc1", bytes(16))),
        M._full(b"stts", 0, struct.pack(">IIIII", 2, 3, 10, 1, 20)),
        M._full(b"stsc", 0, struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)),
        M._full(b"stsz", 0, struct.pack(">IIIIII", 0, 4, *sizes)),
        M._full(b"co64", 0, struct.pack(">IQQQ", 3, *chunks)),
    )
    mdia = M.box(b"mdia", M._full(b"mdhd", 0, struct.pack(">QQIQ", 0, 0, 10, 50), bytes(4), version=1), M.box(b"minf", stbl))
    moov = M.box(b"moov", M.box(b"trak", mdia))
    wide = struct.pack(">I4sQ", 1, b"moov", len(moov) + 8) + moov[8:]
    for raw in (moov, wide, moov + struct.pack(">I4s", 0, b"mdat") + b"rest"):
        (t,) = M.describe(raw)
        assert (t.codec, t.timescale, t.duration) == ("avc1", 10, 50)
        assert t.offsets.tolist() == [1000, 1003, 2000, 3000] and t.sizes.tolist() == sizes and t.keys.tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        list(M.walk(moov[:-1]))


def test_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in M.digests(odd).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = M.padded(raw)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(M.store(payload)).hexdigest() and r["media_bytes"] == len(M.store(payload))
    assert {**rows[4].asDict(), "doc_id": 5} == rows[5].asDict()
    assert M.digests(odd).count() == odd.count() and M.digests(nothing).count() == 0
    files = {r["doc_id"]: r for r in M.files(odd).collect()}
    assert files[10]["codec"] == "raw" and np.isclose(files[10]["seconds"], len(M.padded(ODD[10][1].encode())) / M.TIMESCALE)
