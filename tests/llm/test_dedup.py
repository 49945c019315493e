"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from frameloom.llm import components, exact, near, shared, shingles
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall((text or "").encode())]


def sets(rows, size):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, size=4, percent=80):
    s, parent = sets(rows, size), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(s[i] & s[j])
            if common and 100 * common >= percent * (len(s[i]) + len(s[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def family(n=60, seed=0):
    """A hot group: copies of one text with one to five words changed, and unrelated rows that share a passage."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    for i in range(n, n + 30):
        rows.append((i, " ".join([*base[:70], *[f"u{r.randrange(10**6)}" for _ in range(40)]])))
    return rows


def test_near_on_odd_documents(odd, nothing):
    rows = [(i, t) for i, t in ODD]
    assert result(near.groups(odd.dropDuplicates(["doc_id"]), size=4)) == brute(rows)
    assert near.groups(odd, size=4).count() == odd.count()
    assert near.groups(nothing).count() == 0


@pytest.mark.parametrize("blocks", [256, 7])
def test_near_on_a_hot_group(spark, blocks, monkeypatch):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    original = near.links
    monkeypatch.setattr(near, "links", lambda *a: original(*a, block_docs=blocks))
    assert result(near.groups(docs, size=4)) == brute(rows)


def test_near_keeps_one_of_each_with_clashing_columns(odd, nothing):
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and near.keep_one(nothing).count() == 0 and near.keep_one(nothing).columns == odd.columns
    want = {i for i, v in brute([*ODD], 5).items() if v[2]}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert all(r["text_sha256"] == "keep" and r["k"] == "x" for r in kept.collect())


def test_near_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(near.groups(docs, size=4)) == brute(rows)
    kept = {r["doc_id"] for r in near.keep_one(docs).collect()}
    assert kept == {i for i, v in brute(rows, 5).items() if v[2]}
    assert near.keep_one(docs).columns == docs.columns


def test_chains_of_passages_make_no_candidate_groups(spark, monkeypatch):
    """Each text shares two of three passages with the next (similarity .5): no crowd, few counted pairs, no link."""
    r, seen = random.Random(1), {}
    passages = [" ".join(f"w{r.randrange(10**7)}" for _ in range(60)) for _ in range(402)]
    docs = spark.createDataFrame([(i, " ".join(passages[i : i + 3])) for i in range(400)], "doc_id bigint, text string")
    original = near.short_pairs

    def spy(*a):
        out = original(*a)
        seen.update(pairs=out.count(), crowds=a[2].count())
        return out

    monkeypatch.setattr(near, "short_pairs", spy)
    assert near.groups(docs).where("not kept").count() == 0
    assert seen["crowds"] == 0 and seen["pairs"] < 400


@pytest.mark.parametrize("short", [0, 3, 1000])
def test_near_with_any_split_of_lists(spark, short, monkeypatch):
    """All lists long, a mixture, all lists short: a hot group and pairs that reach out of it."""
    rows = family(30, 5)
    rows += [(100 + i, t + f" x{i} y{i}") for i, t in rows[:6]] + [(200 + i, f"{i} " * 5 + f"tail{i % 3}") for i in range(9)]
    original = near.links
    monkeypatch.setattr(near, "links", lambda *a: original(*a, short=short))
    assert result(near.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size=4)) == brute(rows)


def test_shingles_of_a_batch():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    hashes, counts = shingles.shingle_sets(pa.array(texts), 4)
    assert counts.tolist() == [len(s) for s in sets(list(enumerate(texts)), 4).values()]
    ends = np.cumsum(counts)
    assert (hashes[ends[4] - counts[4] : ends[4]] == hashes[ends[13] - counts[13] : ends[13]]).all()  # case of A-Z only


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(4000, 4200)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def digest(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("probes", [1, 3])
@pytest.mark.parametrize("bits", [1 << 24, 1 << 15, 64])
def test_exact(odd, nothing, bits, probes):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    size = Counter(digest(t) for _, t in rows)
    last = {}
    for i, t in rows:
        last[digest(t)] = max(i, last.get(digest(t), i))
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.groups(odd, bits=bits, probes=probes).collect())
    assert got == sorted((i, last[digest(t)], size[digest(t)], i == last[digest(t)], digest(t)) for i, t in rows)
    assert exact.groups(nothing).count() == 0


def test_exact_keeps_columns_and_one_of_each(odd, nothing):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert all(r["text_sha256"] == "keep" and r["maybe"] == 1 for r in rows)
    assert exact.keep_one(nothing).count() == 0


def test_exact_runs_no_python(odd):
    plan = exact.groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_heavy_join_is_an_inner_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "id bigint, key string")
    groups = shared.written(rows.groupBy("key").count().withColumnRenamed("count", "n"), "t")
    got = shared.heavy_join(rows, groups, "key", "n", heavy=4)
    assert got.count() == 200 and got.where("key = 'hot'").select("n").distinct().count() == 1


def test_written_tables_can_be_cleared(spark):
    table = shared.written(spark.range(5), "t")
    assert table.count() == 5
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    from pathlib import Path

    assert Path(folder).exists() and shared.clear(spark) > 0 and not Path(folder).exists()
    assert shared.clear(spark) == 0


def test_tables_since_a_mark_go_but_for_one(spark):
    old, since = shared.written(spark.range(2), "old"), shared.mark()
    first, last = shared.written(spark.range(3), "first"), shared.written(spark.range(4), "last")
    assert shared.clear(spark, since, last) == 1 and shared.mark() == since + 1
    assert old.count() == 2 and last.count() == 4 and first.inputFiles()
    with pytest.raises(Exception, match="(?i)not.exist|FileNotFound|FAILED_READ"):
        first.collect()
    assert shared.clear(spark, since) == 1
