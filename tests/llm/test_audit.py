"""Filter audit, decontamination and vector codes against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from frameloom.llm import audit, contamination, vectorcodes
from tests.llm.conftest import ODD


def audited(rows, labels):
    """rows: (doc_id, text, source)."""
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        docs.append((s or "", {f for f, bad in fails.items() if bad}, any(i is not None and j == i and q == 1 for j, q, _ in labels), any(i is not None and j == i and x == 1 for j, _, x in labels)))
    out, total = {}, {}
    for part in {s for s, *_ in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                there = [d for d in own if not d[1] & set(order[: step - 1])]
                gone = [d for d in there if f in d[1]]
                fail = [d for d in own if f in d[1]]
                out[part, "".join(order), step] = [len(there) - len(gone), len(gone), len(fail) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def random_documents(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [r.choice(["a", "B", "cc", "#d", "é"]) if r.random() < 0.5 else f"w{r.randrange(60)}" for _ in range(r.choice([0, 20, 60, 90]))]
        rows.append((i, " ".join(w), r.choice(["x", "y", None, ""])))
    rows += [(n + i, rows[r.randrange(8)][1], "x") for i in range(60)]  # a few texts with many copies
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_filtering_in_every_order(spark, seed):
    rows = [*random_documents(seed), (3, "again", "x"), (None, "again", "x"), (None, None, "z"), (500, None, "z"), (501, "", None)]
    labels = [(i % 170 if i % 9 else None, i % 3 % 2, (i % 5 == 0) * 1 if i % 7 else None) for i in range(200)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, part int")
    got = audit.audit(audit.flagged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_odd_and_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    got = audit.audit(audit.flagged(odd, labels)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in got} == {k: v[:2] for k, v in audited(rows, []).items()}
    assert audit.audit(audit.flagged(nothing, labels)).count() == 0


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(rows, items, size=10):
    grams = {}
    for item, text in items:
        w = normal(text)
        n = min(len(w), size)
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, places, held = normal(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    places |= set(range(k, k + n))
                    held |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(places), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(places)))
    return sorted(out, key=str)


def passages(seed):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(12)] + ["É", "naïve", "日本"]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.choice([4, 9, 10, 14, 30])))) for k in range(12)]
    items += [(3, "w0 w1 w2"), (None, "w5 w5 É w6"), (90, ""), (91, None), (92, items[0][1])]
    rows = []
    for i in range(60):
        w = [r.choice(pool) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            w += (r.choice(items)[1] or "").split()[: r.choice([3, 8, 30])] if r.random() < 0.7 else []
        rows.append((i % 50 if i % 13 else None, r.choice([" ", "-", "\n", ", "]).join(x.upper() if x.isascii() and r.random() < 0.5 else x for x in w)))
    return [*rows, (7, None), (8, ""), (9, "?!")], [(k, t) for k, t in items if t is not None or k == 91]


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination_equals_brute_force(spark, most):
    rows, items = passages(3)
    items = [(k, t) for k, t in items]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, contamination.report(docs, bench, most=most).collect()), key=str)
    assert got == contaminated(rows, items)


def test_contamination_of_odd_and_empty_tables(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "word " * 12)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, contamination.report(odd, bench).collect()), key=str) == contaminated(rows, [tuple(r) for r in bench.collect()])
    assert contamination.report(nothing, bench).count() == 0
    clean = contamination.report(odd, bench.limit(0))
    assert clean.count() == odd.count() and clean.where("contaminated").count() == 0
    kept = contamination.remove(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in ODD} - {4, 5, 10, 13}


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, "Zwölf.")], "item_id long, text string")
    texts = [(1, "Start, ONE two-three four! end. One two"), (2, "one two three"), (3, None), (4, "nothing at all"), (5, "a zwölf b ... zwölf"), (6, "  x one two three y one two three")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n int")
    got = {r["doc_id"]: r["text"] for r in contamination.remove(docs, bench, spans=True).collect()}
    assert got == {1: "Start, end. One two", 2: "", 3: None, 4: "nothing at all", 5: "a b ... ", 6: "  x y "}
    assert contamination.remove(docs, bench, spans=True).columns == docs.columns


def coded(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain Python integers. rows: (vec_id, vector, label) of vectors that stay."""
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(f for f, _ in x) for x in found]
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in x), e, sum(e2 for e2, (_, _, l2) in zip(error, rows, strict=True) if l2 == lab), text) for (i, _, lab), x, e in zip(rows, found, error, strict=True)), key=str)


@pytest.mark.parametrize("n", [5, 90])
def test_codes_equal_plain_integers(spark, n):
    r = random.Random(n)
    rows = [(i * 3 % n, [r.gauss(0, 0.3) if k % 5 else r.choice([-1.0, 0.0, 0.25]) for k in range(16)], r.choice([1, 2, None])) for i in range(n)]
    rows += [rows[2], rows[2], (None, rows[3][1], None)]
    bad = [(1, None, 1), (0, [], 1), (2, [0.5] * 15 + [None], 1), (2, [0.5] * 15 + [float("nan")], 2), (3, [float("inf")] + [0.0] * 15, 1), (4, [1.0] * 12, 1), (4, [1.0] * 24, 1), (5, [1e30] * 16, 1)]
    kinds = "vec_id long, embedding array<double>, label int, code string, v int"
    got = vectorcodes.compress(spark.createDataFrame([(*x, "x", 1) for x in rows + bad], kinds))
    assert sorted(map(tuple, got.collect()), key=str) == coded(rows)
    assert vectorcodes.compress(spark.createDataFrame([(*x, "x", 1) for x in bad[:3]], kinds)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([], kinds)).columns == got.columns


def test_bounds_hold_the_distances_and_spare_most_of_them():
    r = np.random.default_rng(5)
    books, parts = r.integers(-4000, 4000, (16, 8)), r.integers(-4000, 4000, (500, 8))
    books[3] = books[9]
    parts[:16] = books
    entry, far, measured = vectorcodes.Cells.of(books).nearest(parts)
    every = ((parts[:, None] - books[None]) ** 2).sum(axis=2)
    assert (far == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()
    assert measured < 0.7 * every.size


def test_decoded_vectors_are_near_the_originals(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    ints = vectorcodes.whole(vectors, "vec_id", "embedding", "label", 4096, 8)
    rows = [r["v"] for r in ints.collect()]
    books = vectorcodes.train(ints, len(rows[0]))
    codes = {r["vec_id"]: r for r in vectorcodes.encode(ints, books).collect()}
    numbers = np.array([list(bytes.fromhex(codes[r["vec_id"]]["code"])) for r in ints.select("vec_id").collect()])
    off = ((books.decoded(numbers) * 4096 - np.array(rows)) ** 2).sum(axis=1)
    assert off.astype(int).tolist() == [codes[r["vec_id"]]["error"] for r in ints.select("vec_id").collect()]
