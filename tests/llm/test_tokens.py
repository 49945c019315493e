"""SentencePiece, token counts, packing, token files: against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from frameloom.llm import dac, packing, sentencepieces, tokenids, viterbi
from tests.llm.conftest import ODD

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [t or "" for _, t in ODD]
ALPHABET = st.text(alphabet=st.sampled_from("abcdetino ,.▁\n\t日éÉß😀'1-_ 　"), max_size=80)


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def scrambled(n=400, seed=0):
    r = random.Random(seed)
    parts = ["a", "ab", "the ", " ", "  ", "ing", "▁", "\n", "é", "日", "Σ", "İ", "'s", "12", "?!", " ", "<|endoftext|>", "aaaa", "\x1f"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library():
    texts = TEXTS + scrambled()
    assert [list(x) for x in sentencepieces.encode(pa.array(texts), PIECES)] == library().encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_pieces_equal_the_library_on_any_text(texts):
    ids = [list(x) for x in sentencepieces.encode(pa.array(texts), PIECES)]
    assert ids == library().encode(texts)
    assert [sentencepieces.decode(i, PIECES) for i in ids] == [library().decode(i) for i in ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=30))
def test_decoding_any_ids(ids):
    assert sentencepieces.decode(ids, PIECES) == library().decode(ids)


def test_long_words_equal_the_library():
    """Words of more than LONG characters: random letters, pieces, periodic runs whose pairs tie, characters outside."""
    r, lib = random.Random(2), library()
    pieces = [t.replace("▁", "") for t in sentencepieces.load(PIECES).texts[300:] if t.replace("▁", "")]
    texts = [w * (1500 // len(w) + 1) for w in ("a", "ab", "thx", "inging", "==", "日", "é0", "\u3000x")]
    texts += ["".join(r.choice(alphabet) for _ in range(3000)) for alphabet in ("01", "etaoinshr", "ABCxyz0189+/", "日本éß a" * 1)]
    for _ in range(60):
        parts = r.sample(pieces, r.randint(1, 5))
        texts.append("".join(r.choice(parts) for _ in range(700)))
    texts += ["short " + t + " " + t[:600] + " end" for t in texts[:6]]
    for got, t in zip(sentencepieces.encode(pa.array(texts), PIECES), texts, strict=True):
        assert got.tolist() == lib.encode(t)


@pytest.mark.parametrize("unit", ["QxZ7+kw/", "inging", "a"])
def test_a_megabyte_without_blanks(unit):
    r = random.Random(0)
    text = "".join(r.choice(unit) for _ in range(1 << 20)) if len(unit) > 6 else unit * ((1 << 20) // len(unit))
    assert sentencepieces.encode(pa.array([text]), PIECES)[0].tolist() == library().encode(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=60)), min_size=1, max_size=4))
def test_digests_equal_the_library_on_any_text(texts):
    """What the query returns of each text, with its own way of decoding."""
    lib = library()
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    rows = pa.Table.from_batches(sentencepieces._digests([batch], PIECES)).to_pylist()
    for row, t in zip(rows, texts, strict=True):
        ids = lib.encode(t)
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_round_trip_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in sentencepieces.round_trip(odd, PIECES).collect()}
    lib = library()
    for i, t in ODD:
        ids = lib.encode(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepieces.round_trip(odd, PIECES).count() == odd.count()
    assert sentencepieces.round_trip(nothing, PIECES).count() == 0
    assert {r["doc_id"]: list(r["ids"]) for r in sentencepieces.tokenize(odd, PIECES).collect()}[4] == lib.encode(ODD[4][1])


def test_token_counts_equal_the_unigram_model(odd, nothing):
    v = viterbi.load(PIECES)
    vocabulary = [("<unk>", 0.0), *zip(v.pieces, map(float, v.scores), strict=True), *[(f"<0x{i:02X}>", 0.0) for i in range(256)]]
    model = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback=True))
    marked = lambda t: "▁" + t.replace(" ", "▁") if t else ""
    texts = [t for t in TEXTS if "<" not in t] + [t for t in scrambled() if "<" not in t]
    docs = sentencepieces.units(pa.array(texts))
    counts, _ = viterbi.count_words(docs.words, v)
    assert docs.per_doc(counts).tolist() == [len(model.encode(marked(t)).ids) for t in texts]
    rows = {r["doc_id"]: r["n_tokens"] for r in viterbi.count_tokens(odd, PIECES).collect()}
    assert rows[0] == rows[1] == 0 and rows[4] == len(model.encode(marked(ODD[4][1])).ids)
    assert viterbi.count_tokens(nothing, PIECES).count() == 0


def test_best_scores_are_those_of_the_pieces():
    v = viterbi.load(PIECES)
    score = dict(zip(v.pieces, map(float, v.scores), strict=True))
    model = Tokenizer(models.Unigram([("<unk>", -1e9), *score.items()], 0))
    r = random.Random(4)
    texts = ["the cat sat on the mat", "international understanding", "x"] + ["".join(r.choice("etaoin shrdlu") for _ in range(40)).strip() for _ in range(60)]
    texts = [" ".join(t.split()) for t in texts]
    docs = sentencepieces.units(pa.array(texts))
    _, scores = viterbi.count_words(docs.words, v)
    for got, t in zip(docs.per_doc(scores).tolist(), texts, strict=True):
        pieces = model.encode("▁" + t.replace(" ", "▁")).tokens
        assert all(p in score for p in pieces)
        assert got == pytest.approx(sum(score[p] for p in pieces), rel=1e-12)


def test_token_counts_keep_the_earlier_start_on_ties():
    v = viterbi.Vocabulary(["▁", "a", "b", "ab", "▁a"], [0.0, -1.0, -1.0, -2.0, -1.0], False)
    counts, scores = viterbi.count_words(pa.array(["ab", "zz", "azb"]), v)
    model = Tokenizer(models.Unigram([("<unk>", -100.0), ("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -1.0)], 0))
    assert scores[0] == -2.0
    assert counts[0] == len(model.encode("▁ab").ids)
    assert counts[1] == 2 and counts[2] == 3  # a run of characters without a piece counts one


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_tokenizer(path):
    texts = TEXTS + scrambled(seed=1)
    want = [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    ids, sizes = tokenids.encode(pa.array(texts), path)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want


@pytest.mark.parametrize("kept", [0, 30, 200, 10**6])
@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_kept_words_change_nothing(path, kept, monkeypatch):
    monkeypatch.setattr(tokenids, "KEPT_WORDS", kept)
    tokenids.load(path).forget()
    t = tokenizer(path)
    for seed in range(6):
        texts = scrambled(60, seed) + TEXTS[:10]
        ids, sizes = tokenids.encode(pa.array(texts), path)
        assert ids.tolist() == [i for e in t.encode_batch(texts, add_special_tokens=False) for i in e.ids]
        assert len(tokenids.load(path).kept[0]) <= kept


@settings(max_examples=80, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4))
def test_ids_equal_the_tokenizer_on_any_text(texts):
    for path in (WORDS, BYTES):
        ids, sizes = tokenids.encode(pa.array(texts), path, 7)
        at = 0
        for e, n in zip(tokenizer(path).encode_batch(texts, add_special_tokens=False), sizes, strict=True):
            assert ids[at : at + n].tolist() == [*e.ids, 7]
            at += n


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check_packing(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces})
        ids = ids_of[doc]
        assert [p[0] for p in pieces] == list(range(-(-len(ids) // capacity)))
        for piece, start, length, value in pieces:
            assert start == piece * capacity and length == len(ids[start : start + capacity]) and value == crc(ids[start : start + capacity])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing(odd, nothing):
    ids_of = {i: [*tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids, 1] for i, t in ODD}
    for capacity, group in ((64, 4096), (64, 5)):
        rows = packing.pack(odd, WORDS, capacity=capacity, group_size=group).collect()
        bins = check_packing(rows, ids_of, capacity)
        total = sum(r["length"] for r in rows)
        assert bins <= -(-total // capacity) + 2
    assert packing.pack(nothing, WORDS).count() == 0


def test_local_search_empties_bins():
    r = random.Random(3)
    for _ in range(20):
        lengths = [r.randint(20, 60) for _ in range(60)]
        bins = [[i] for i in range(60)]  # as bad as can be
        better = packing.improved(bins, lengths, 100)
        assert sorted(i for b in better for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 100 for b in better)
        assert len(better) < 45
        assert len(packing.improved(packing.best_fit(lengths, 100), lengths, 100)) <= len(packing.best_fit(lengths, 100))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([4, 8, 16]))
def test_directly_addressable_codes(values, bits):
    raw = dac.write_file(np.array([5]), np.array([len(values)]), np.array(values, dtype=np.uint32), bits)
    file = dac.File(raw)
    assert file.levels.all().tolist() == values
    for i in range(0, len(values), 97):
        assert file.levels.get(i) == values[i]
    assert file.levels.at(np.arange(len(values))).tolist() == values


def test_token_files(odd, nothing):
    t = tokenizer(BYTES)
    documents = odd.dropDuplicates(["doc_id"])
    files = dac.write(documents, BYTES, most_ids=50, ranges=5)
    rows = sorted(dac.read(files).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (i, text) in zip(rows, ODD, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert files.count() > 3
    assert sorted(r["n_tokens"] for r in dac.read(dac.write(odd, BYTES)).collect())[0] == 1  # repeated rows are documents
    assert dac.read(dac.write(nothing, BYTES)).count() == 0


def test_token_files_answer_single_positions(spark, odd, nothing):
    t = tokenizer(BYTES)
    files = dac.write(odd.dropDuplicates(["doc_id"]), BYTES, most_ids=50, ranges=3)
    ids = {i: [*t.encode(text or "", add_special_tokens=False).ids, 0] for i, text in ODD}
    wanted = [(i, p) for i, x in ids.items() for p in {0, len(x) // 2, len(x) - 1, len(x), -1}] + [(999, 0)]
    got = {(r["doc_id"], r["position"]): r["token"] for r in dac.lookup(files, spark.createDataFrame(wanted, "doc_id bigint, position bigint")).collect()}
    assert got == {(i, p): ids[i][p] for i, p in wanted if i in ids and 0 <= p < len(ids[i])}
    ends = {r["doc_id"]: (r["first_token"], r["last_token"]) for r in dac.read(files).collect()}
    assert ends == {i: (x[0], x[-1]) for i, x in ids.items()}
    assert dac.lookup(dac.write(nothing, BYTES), spark.createDataFrame([(1, 0)], "doc_id bigint, position bigint")).count() == 0


def test_rows_of_one_id_spread_over_ranges(spark):
    docs = spark.createDataFrame([(7, f"text {i % 40} of many words") for i in range(200)], "doc_id bigint, text string").repartition(4)
    files = dac.write(docs, BYTES, ranges=6)
    assert files.select("part").distinct().count() > 3
    rows = sorted(dac.read(files).collect(), key=lambda r: r["start"])
    assert len(rows) == 200 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
