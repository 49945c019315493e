"""Language, quality and language-model operators: brute force and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import language, ngrams, quality
from frameloom.llm.shared import fold
from tests.llm.conftest import ODD
from tests.llm.test_dedup import words


def plain_words(text):
    import re

    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def slow_costs(samples, order):
    """Code length of a word for each language, straight from the definition."""
    counts = {lang: defaultdict(Counter) for lang in samples}
    for lang, texts in samples.items():
        for t in texts:
            for w in plain_words(t):
                s = b" " + w
                for i in range(1, len(s)):
                    for k in range(order + 1):
                        if i - k >= 0:
                            counts[lang][s[i - k : i]][s[i]] += 1

    def cost(lang, word):
        s, bits = b" " + word, 0.0
        for i in range(1, len(s)):
            for k in range(min(order, i), -1, -1):
                seen = counts[lang].get(s[i - k : i])
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    bits -= math.log2(seen[s[i]] / (n + q))
                    break
                bits -= math.log2(q / (n + q))
            else:
                bits += math.log2(257)
        return bits

    return cost


def test_code_lengths_are_exact(spark):
    samples = {"aa": ["the cat sat", "cats and dogs, the end"], "bb": ["der hund und die katze", "über das haus"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in samples.items() for t in ts)]
    trees = language.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"), per_language=10**6, order=3)
    probe = [b"the", b"hund", b"zz", "ü".encode(), b"catsu", b"x"]
    got = language.word_costs(pa.array([w.decode() for w in probe]), trees.groups[0])
    slow = slow_costs(samples, 3)
    for row, w in zip(got, probe, strict=True):
        for value, lang in zip(row, trees.languages, strict=True):
            assert value == pytest.approx(slow(lang, w), abs=1e-9)


def test_language_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    trees = language.train(docs, only_where=fold("doc_id", 5) != 0)
    rows = language.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert rows and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_language_is_learned(spark):
    """300 languages and a dirty rest: all are learned, in groups, however little of each is read."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i, k: "".join(alphabet[(i * 7 + k * 11 + j * (i % 25 + 1) + i // 26) % 26] for j in range(6))
    rows = [(i, "the cat sat on a mat " * (2000 if i == 0 else 1), "en") for i in range(40)] + [(1000 + 3 * i + j, " ".join(word(i, k) for k in range(12)), f"l{i:03d}") for i in range(300) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names = ["en", *[f"l{i:03d}" for i in range(300)]]
    for model in (language.train(docs), language.train(docs, most_bytes=200), language.train(docs, most_cells=400), language.train(docs, together=64)):
        assert model.languages == names
        got = language.identify(docs, model).collect()
        want = {r[0]: r[2] for r in rows}
        assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) == len(rows)
    assert [len(g.languages) for g in language.train(docs).groups] == [8] * 37 + [5]
    one, many = (sorted(map(tuple, language.identify(docs, language.train(docs, together=k)).collect())) for k in (1000, 3))
    assert [r[:2] for r in one] == [r[:2] for r in many] and all(a[2] == pytest.approx(b[2]) for a, b in zip(one, many, strict=True))


def test_language_cases(odd, nothing):
    trees = language.train(odd)
    rows = {r["doc_id"]: r for r in language.identify(odd, trees).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[0]["score"] == 0
    assert rows[4]["lang_pred"] == "en" and rows[4]["score"] == 1
    empty = language.train(nothing)
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(nothing, trees).count() == 0
    kept = language.keep_known(odd, trees)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in ODD if t and any(c.isalpha() for c in t)}


def slow_lm(rows, held, deleted, mixture):
    toks = {i: [*words(t), "END"] for i, t in rows}
    grams = lambda seqs: Counter(g for s in seqs for g in zip(["START", *s[:-1]], s, strict=True))
    train = [toks[i] for i in toks if not held(i)]
    main = [toks[i] for i in toks if not held(i) and not deleted(i)]
    uni, big = Counter(w for s in train for w in s), grams(train)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, s in toks.items():
        base = sum(math.log10((uni[w] + 1) / (n + 1 * (v + 1))) for w in s)
        score, before = 0.0, "START"
        for w in s:
            c = len(train) if before == "START" else uni[before]
            a = mixture[0 if c == 0 else min(47, math.frexp(c)[1])]
            score += math.log10(a[0] * (big[before, w] / c if c else 0.0) + a[1] * uni[w] / max(n, 1) + a[2] / (v + 1))
            before = w
        out[i] = (len(s), sum(uni[w] > 0 for w in s), n, base, score)
    return out, main


@pytest.mark.parametrize("ranges", [(3, 1), (2, 3), (5, 4)])
def test_language_model_equals_brute_force(spark, small, monkeypatch, ranges):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {}
    original = ngrams.weights
    monkeypatch.setattr(ngrams, "weights", lambda *a: found.setdefault("a", original(*a)))
    local = spark.createDataFrame([*rows, (10**6, None), (10**6 + 1, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ngrams.score(local, fold("doc_id", 7) == 2, fold("doc_id", 7) == 3, ranges=ranges).collect()}
    h = lambda i: zlib.crc32(str(i).encode()) % 7
    want, _ = slow_lm([*rows, (10**6, None), (10**6 + 1, "")], lambda i: h(i) == 2, lambda i: h(i) == 3, found["a"])
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, h(i) == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert np.allclose(found["a"].sum(axis=1), 1)


def test_language_model_cases(odd, nothing):
    rows = ngrams.score(odd, F.lit(False), F.col("doc_id") % 4 == 1).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)
    alone = ngrams.score(odd, F.lit(True), F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in alone} == {(0, 0, 0.0)}
    assert all(abs(r["score"]) < 1e-9 for r in alone)
    assert ngrams.score(nothing, F.lit(False), F.lit(False)).count() == 0


def test_hash_ranges_follow_the_bytes():
    assert ngrams.ranges_for(0) == (1, 1)
    for size in (10**6, 10**9, 3 * 10**10, 10**13, 10**14):
        coarse, fine = ngrams.ranges_for(size)
        assert size / (coarse * fine) <= ngrams.RANGE_BYTES and max(coarse, fine) <= 2 * ngrams.MOST_RANGES


def test_mixture_weights_prefer_what_explains():
    cells = np.array([(3 * (ngrams.DEPTH + 1) + 2) * (ngrams.DEPTH + 1) + 60, (3 * (ngrams.DEPTH + 1) + ngrams.DEPTH) * (ngrams.DEPTH + 1) + ngrams.DEPTH])
    a = ngrams.weights(cells, np.array([90, 10]), 1e-4)[3]
    assert a[0] == pytest.approx(0.9, abs=0.01) and a[2] == pytest.approx(0.1, abs=0.01)


def graded(n=60, features=25, seed=0):
    """Random sparse documents, and grades that follow a score."""
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 8, n)
    starts = np.r_[0, np.cumsum(sizes)]
    feature = np.concatenate([r.choice(features, s, replace=False) for s in sizes])
    value = r.uniform(0.5, 2.0, len(feature))
    truth = r.normal(0, 1.5, features)
    score = np.array([(truth[feature[a:b]] * value[a:b]).sum() for a, b in zip(starts, starts[1:])]) + r.normal(0, 0.5, n)
    return starts, feature, value, np.digitize(score, [-1.0, 1.0])


def slow_value(scores, thresholds, grade, mass):
    total = 0.0
    for s, g, m in zip(scores, grade, mass, strict=True):
        below = lambda k, s=s: 0.0 if k < 0 else 1.0 if k >= len(thresholds) else 1 / (1 + math.exp(s - thresholds[k]))
        total -= m * math.log(below(g) - below(g - 1))
    return total


def test_quality_likelihood_and_slopes():
    r = np.random.default_rng(1)
    scores, thresholds, grade, mass = r.normal(0, 2, 40), np.array([-0.7, 0.9, 2.0]), r.integers(0, 4, 40), r.uniform(0.1, 1, 40)
    value, ds, dt = quality.slopes(scores, thresholds, grade, mass)
    assert value == pytest.approx(slow_value(scores, thresholds, grade, mass), rel=1e-9)
    h = 1e-6
    for i in range(40):
        up, down = (slow_value(scores + h * sign * (np.arange(40) == i), thresholds, grade, mass) for sign in (1, -1))
        assert ds[i] == pytest.approx((up - down) / (2 * h), abs=1e-6)
    for k in range(3):
        up, down = (slow_value(scores, thresholds + h * sign * (np.arange(3) == k), grade, mass) for sign in (1, -1))
        assert dt[k] == pytest.approx((up - down) / (2 * h), abs=1e-6)


def test_quality_fit_ends_at_the_least_value():
    """At the end no weight can improve the penalised value: slopes of live weights equal the penalty, others lie below it."""
    starts, feature, value, grade = graded()
    features, penalty, n = 25, 0.004, 60
    model = quality.fit(starts, feature, value, grade, features, 3, penalty=penalty, rounds=20000, tolerance=0.0)
    rarity = np.log(n / np.maximum(np.bincount(feature, minlength=features), 1)) / np.log(n) + 0.02
    x = np.zeros((n, features))
    for d in range(n):
        x[d, feature[starts[d] : starts[d + 1]]] = value[starts[d] : starts[d + 1]]
    _, ds, dt = quality.slopes(x @ model.weights, model.thresholds, grade, np.full(n, 1 / n))
    slope, live = (x.T @ ds) * rarity, model.weights != 0
    assert np.abs(dt).max() < 1e-4 and live.any() and not live.all()
    assert np.allclose(slope[live], -penalty * np.sign(model.weights[live]), atol=1e-4)
    assert (np.abs(slope[~live]) <= penalty + 1e-4).all()
    early = quality.fit(starts, feature, value, grade, features, 3, penalty=penalty)
    total = lambda m: quality.slopes(x @ m.weights, m.thresholds, grade, np.full(n, 1 / n))[0] + penalty * np.abs(m.weights / rarity).sum()
    assert total(early) <= total(model) * 1.001


def slow_features(text, buckets):
    import xxhash

    h = lambda b: xxhash.xxh3_64_intdigest(b) % buckets
    found, marks, again = Counter(), Counter(), 0
    tokens = [w.decode() for w in words(text)]
    for before, w in zip([None, *tokens], tokens):
        core = w.strip(quality._PUNCTUATION)
        if core:
            found[h(b"w" + core.encode())] += 1
            for n in quality.PREFIXES:
                if len(core) > n:
                    found[(n, h(b"p" + core[:n].encode()))] += 1
        tail = w[len(w.rstrip(quality._PUNCTUATION)) :]
        if core != w and tail:
            marks[h(b"e" + tail.encode())] += 1
        again += before == w
    out = Counter()
    for key, n in found.items():
        slot = key[1] if isinstance(key, tuple) else key
        out[slot] += 1
        if n > 1:
            out[quality._often(slot, buckets)] += 1
    for slot, n in [*marks.items(), *([(h(b"r"), again)] if again else [])]:
        out[slot] += math.sqrt(n / len(tokens)) * 4
    return out


def test_quality_scores_equal_brute_force(spark, small):
    """The query's columns from weights, words and thresholds, one text at a time."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(docs, quality.grades_of(spark.read.parquet(f"{small}/labels.parquet")), least_docs=2)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert weight and got.keys() == texts.keys()
    for i, text in texts.items():
        s = sum(weight.get(slot, 0.0) * x for slot, x in slow_features(text, model.buckets).items())
        tails = [1 - 1 / (1 + math.exp(min(500, s - t))) for t in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-4) and got[i]["tail_probability"] == pytest.approx(tails[1], abs=1e-4)
        assert got[i]["selected"] == (got[i]["tail_probability"] >= 0.5)


def test_quality_on_held_out_ratings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = quality.grades_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 6000"))
    model = quality.train(docs, labels.where(fold("doc_id", 4) != 0))
    rows = quality.score(docs, model).join(labels.where(fold("doc_id", 4) == 0), "doc_id").collect()
    keep = defaultdict(list)
    for r in rows:
        keep[r["grade"]].append(r["selected"])
        assert 0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2
    share = {g: sum(v) / len(v) for g, v in keep.items()}
    assert share[2] > 0.98 and share[0] < 0.1 and share[1] < 0.1


def test_quality_cases(odd, nothing, spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(15)] + [(3, 0), (4, None)], "doc_id bigint, grade int")
    model = quality.train(odd, ratings, least_docs=1)
    assert (np.diff(model.thresholds) >= 0).all()
    assert quality.score(odd, model).count() == odd.count() and quality.score(nothing, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.train(odd, ratings.limit(0))
    assert none is None
    assert {(r["expected_grade"], r["selected"]) for r in quality.score(odd, none).collect()} == {(None, True)}
    assert quality.keep_good(odd, none).count() == odd.count()
    assert quality.train(nothing, ratings) is None


def test_rows_without_ids(without_ids, spark):
    from frameloom.llm import dac, exact, isomedia, near, packing, sentencepieces, viterbi
    from tests.llm.test_tokens import BYTES, PIECES, WORDS

    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x or 0))
    all_ids = [None, None, None, 1, 2]
    for df in (
        sentencepieces.round_trip(without_ids, PIECES),
        language.identify(without_ids, language.train(without_ids.withColumn("lang", F.lit("en")))),
        viterbi.count_tokens(without_ids, PIECES),
        ngrams.score(without_ids, F.col("doc_id") == 2, F.lit(False)),
        near.groups(without_ids),
        exact.groups(without_ids),
        quality.score(without_ids, None),
        packing.pack(without_ids, WORDS),
        dac.read(dac.write(without_ids, BYTES)),
        isomedia.digests(without_ids),
    ):
        assert ids(df) == all_ids
    assert ids(exact.keep_one(without_ids)) == [None, None, 1, 2]
    assert ids(near.keep_one(without_ids)) == all_ids
    dropped = {(r["doc_id"], r["kept"]) for r in exact.groups(without_ids).collect()}
    assert (1, True) in dropped and (2, True) in dropped and (None, True) in dropped and (None, False) in dropped


def test_quality_sample_is_bounded_by_bytes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ratings = quality.grades_of(spark.read.parquet(f"{small}/labels.parquet"))
    whole, less = quality.train(docs, ratings), quality.train(docs, ratings, most_bytes=60_000, least_docs=2)
    assert len(whole.thresholds) == len(less.thresholds) == 2 and not np.array_equal(whole.thresholds, less.thresholds)
    assert quality.score(docs, less).where("expected_grade between 0 and 2").count() == docs.count()
