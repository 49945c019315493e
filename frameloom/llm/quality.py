"""Operator 7: quality classification by ordinal cumulative-link regression.

A graded rating (0 worst) of a text follows P(grade <= k) = logistic(t_k - s)
with one score s = w . x shared by all grades and ordered thresholds t_k. The
features x are hashed: one for each distinct word (A-Z made small, punctuation
at its ends taken off) and each beginning of a word, one more where it occurs
twice or more, and for each run of punctuation that ends a word, and
for words that repeat their predecessor, the share of the words that do. The
weights are fitted with a sparsity penalty on a bounded sample of rated
documents, chosen by a hash of the id; the bound is a parameter. Results are
the expected grade and the tail probability P(grade >= k) for selection.

Cases: null and empty texts have no features and are scored like an average
text of none; documents without a rating are scored like others; of several
ratings of a document the least counts; null ratings are ignored. If nothing is
rated, every document gets null scores and selection keeps it. Repeated rows
and extra columns do no harm, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textcols as tc
from frameloom.llm.shared import only, written


@dataclass
class Model:
    """Weights of the hashed features and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    slots: np.ndarray | None = None  # the features that have a weight
    buckets: int = 0

    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which features have a weight, those useful for them, and each weight (kept after the first call)."""
        if "_dense" not in self.__dict__:
            weights = np.zeros(self.buckets, dtype=np.float32)
            weights[self.slots] = self.weights
            self._dense = (weights != 0, _useful(weights != 0), weights)
        return self._dense

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}


#: Lengths of the word beginnings that are features too.
PREFIXES = (4, 5, 6, 7)
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _slots(words: pa.StringArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of each word (core and beginnings; -1 without) and of its ending punctuation (-1 without)."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    parts = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    end = np.full(len(words), -1, np.int64)
    known: dict[str, int] = {}
    ends: dict[str, int] = {}
    for i, w in enumerate(words.to_pylist()):
        stem = w.strip(_PUNCTUATION)
        if stem:
            parts[i, 0] = f(b"w" + stem.encode()) % buckets
            for k, n in enumerate(PREFIXES):
                if len(stem) <= n:
                    break
                head = stem[:n]
                slot = known.get(head)
                if slot is None:
                    slot = known[head] = f(b"p" + head.encode()) % buckets
                parts[i, 1 + k] = slot
        if len(stem) < len(w):
            tail = w[len(w.rstrip(_PUNCTUATION)) :]
            if tail:
                if tail not in ends:
                    ends[tail] = f(b"e" + tail.encode()) % buckets
                end[i] = ends[tail]
    return parts, end


def _often(slot: np.ndarray, buckets: int) -> np.ndarray:
    """The feature that says that a feature occurs twice or more."""
    return (slot * 48271 + 11) % buckets


def _useful(wanted: np.ndarray) -> np.ndarray:
    """Features of a word that are wanted, or whose second occurrence is."""
    out = wanted.copy()
    for first in range(0, len(wanted), 1 << 18):
        slots = np.arange(first, min(first + (1 << 18), len(wanted)))
        out[slots] |= wanted[_often(slots, len(wanted))]
    return out


def _features(texts, buckets: int, wanted: np.ndarray | None = None, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) rows; only features in ``wanted`` (Boolean, with its ``useful``) if it is given."""
    import xxhash

    docs = tc.words(texts)
    parts, end = _slots(docs.words, buckets)
    repeat = xxhash.xxh3_64_intdigest(b"r") % buckets
    if useful is not None:
        parts = np.where((parts >= 0) & useful[parts], parts, -1)
    owner = np.repeat(np.arange(len(docs.counts)), docs.counts)
    doc, feature, value = [], [], []
    for column in parts.T:
        slot = column[docs.codes] if len(docs.codes) else np.zeros(0, np.int64)
        there = slot >= 0
        key, n = np.unique(owner[there] * buckets + slot[there], return_counts=True)
        twice = n > 1
        doc += [key // buckets, key[twice] // buckets]
        feature += [key % buckets, _often(key[twice] % buckets, buckets)]
        value += [np.ones(len(key)), np.ones(int(twice.sum()))]
    share = 1.0 / np.maximum(docs.counts, 1)
    slot = end[docs.codes] if len(docs.codes) else np.zeros(0, np.int64)
    again = np.zeros(len(slot), dtype=bool)
    again[1:] = (docs.codes[1:] == docs.codes[:-1]) & (owner[1:] == owner[:-1])
    for where, what in ((slot >= 0, slot), (again, np.full(len(slot), repeat))):
        key, n = np.unique(owner[where] * buckets + what[where], return_counts=True)
        doc.append(key // buckets)
        feature.append(key % buckets)
        value.append(np.sqrt(n * share[key // buckets]) * 4)
    doc, feature, value = np.concatenate(doc), np.concatenate(feature), np.concatenate(value)
    if wanted is not None:
        used = wanted[feature]
        doc, feature, value = doc[used], feature[used], value[used]
    return doc, feature, value


def slopes(s: np.ndarray, thresholds: np.ndarray, grade: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log-likelihood of graded documents with scores ``s``, and its slopes by score and by threshold."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    hi, lo = _logistic(edges[grade + 1] - s), _logistic(edges[grade] - s)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = mass * hi * (1 - hi) / p, mass * lo * (1 - lo) / p
    grades = len(thresholds) + 1
    dt = np.bincount(grade, weights=-dhi, minlength=grades)[:-1] + np.bincount(grade, weights=dlo, minlength=grades)[1:]
    return float(-(mass * np.log(p)).sum()), dhi - dlo, dt


CHECKED = 10  # rounds between looks at the progress
TAKEN = 250  # features that join at once


class _Rows:
    """Documents as sparse rows: (document, feature, value) entries, by document."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int, features: int):
        self.doc, self.feature, self.value, self.docs, self.features = doc, feature, value, docs, features
        self.blocks = [slice(i, i + (1 << 20)) for i in range(0, max(len(doc), 1), 1 << 20)]

    def by_doc(self, weights: np.ndarray) -> np.ndarray:
        return sum(np.bincount(self.doc[s], weights=self.value[s] * weights[self.feature[s]], minlength=self.docs) for s in self.blocks)

    def by_feature(self, weights: np.ndarray) -> np.ndarray:
        return sum(np.bincount(self.feature[s], weights=self.value[s] * weights[self.doc[s]], minlength=self.features) for s in self.blocks)

    def only(self, features: np.ndarray) -> _Rows:
        """The same documents with a few features, numbered anew."""
        place = np.full(self.features, -1, dtype=np.int32)
        place[features] = np.arange(len(features))
        parts = []
        for s in self.blocks:
            here = place[self.feature[s]]
            there = here >= 0
            parts.append((self.doc[s][there], here[there], self.value[s][there]))
        doc, feature, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return _Rows(doc, feature, value, self.docs, len(features))


def _descent(x: _Rows, scale: np.ndarray, w: np.ndarray, t: np.ndarray, grade: np.ndarray, mass: np.ndarray, penalty: float, rounds: int, tolerance: float):
    """Proximal gradient descent with momentum; each weight has its own rate, the reciprocal of a bound of the curvature."""
    rate = 1.0 / (x.by_feature(mass * x.by_doc(scale)) * scale / 2 + 1e-9)
    w_prev, t_prev = w.copy(), t.copy()
    values, momentum = [np.inf], 0
    for _ in range(rounds):
        k = momentum / (momentum + 3)
        wy, ty = w + k * (w - w_prev), np.sort(t + k * (t - t_prev))
        value, ds, dt = slopes(x.by_doc(wy * scale), ty, grade, mass)
        step = wy - rate * x.by_feature(ds) * scale
        w_prev, t_prev = w, t
        w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        t = np.sort(ty - 2 * dt)
        values.append(value + penalty * np.abs(wy).sum())
        momentum = 0 if values[-1] > values[-2] else momentum + 1
        if len(values) > 2 * CHECKED and min(values[:-CHECKED]) - min(values[-CHECKED:]) <= tolerance * min(values):
            break
    return w, t


def fit(starts: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, buckets: int, grades: int, shares: np.ndarray | None = None, penalty: float = 1e-4, rounds: int = 500, tolerance: float = 1e-4) -> Model:
    """The least penalised negative log-likelihood, by descent on a working set.

    A pass over all features lets the TAKEN steepest that the penalty doesn't
    hold at zero join the live ones; a descent of at most ``rounds`` then works
    on those alone, until CHECKED rounds lower the value by less than
    ``tolerance`` of it. Passes end when none joins that is steeper than the
    penalty by more than a hundredth of it, or only some that had joined before
    and left again; so there are finitely many.

    Document d has the features ``starts[d]`` to ``starts[d + 1]``. ``shares``
    says how much each grade weighs in sum (default: as in the data). Features
    count less the more documents have them.
    """
    n = len(grade)
    freq = np.bincount(grade, minlength=grades)
    shares = freq / max(n, 1) if shares is None else np.where(freq > 0, shares, 0) / shares[freq > 0].sum()
    mass = (shares / np.maximum(freq, 1))[grade]
    rarity = np.log(n / np.maximum(np.bincount(feature, minlength=buckets), 1)) / np.log(max(n, 2)) + 0.02
    x = _Rows(np.repeat(np.arange(n, dtype=np.int32), np.diff(starts)), feature, value, n, buckets)
    w, t = np.zeros(buckets), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    s, joined = np.zeros(n), None
    while True:
        steep = np.abs(x.by_feature(slopes(s, t, grade, mass)[1]) * rarity)
        steep[w != 0] = 0
        new = np.argsort(-steep, kind="stable")[:TAKEN]
        new = new[steep[new] > 1.01 * penalty]
        live = np.sort(np.r_[np.flatnonzero(w), new])
        if joined is None:
            joined = np.zeros(buckets, dtype=bool)
        elif joined[new].all():
            break
        joined[new] = True
        some = x.only(live)
        w[live], t = _descent(some, rarity[live], w[live], t, grade, mass, penalty, rounds, tolerance)
        s = some.by_doc(w[live] * rarity[live])
    return Model(w * rarity, t)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, ratings: DataFrame, sample: int = 2000, grades: int = 3, buckets: int = 1 << 22, least_docs: int = 4, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model | None:
    """Fit on about ``sample`` rated documents of each grade; ``ratings`` has the id and a grade from 0.

    If their texts have more than ``most_bytes``, fewer of all grades are read.
    Only features of ``least_docs`` documents of the sample or more get weights.
    """
    spark = docs.sparkSession
    rated = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.least(F.min("grade"), F.lit(grades - 1)).alias("grade"))
    sizes_by = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not sizes_by:
        return None
    share = F.lit(0)
    for grade, n in sorted(sizes_by.items()):
        share = F.when(F.col("grade") == grade, F.lit(min(1 << 20, sample * (1 << 20) // n + 1))).otherwise(share)
    some = rated.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share)
    rows = written(only(docs, doc_id=id_col, text=text_col).join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text"), "rated")  # the sample's size is bounded
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1 << 20)) < (1 << 20) * most_bytes // size + 1)
    rows = rows.select("grade", "text")

    def counted(batches):
        for whole in batches:
            for batch in tc.pieces_of(whole, "text", 4 << 20):
                _, feature, _ = _features(batch.column("text"), buckets)
                slot, n = np.unique(feature, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    often = rows.select("text").mapInArrow(counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("slot").toArrow()
    wanted = np.zeros(buckets, dtype=bool)
    wanted[often["slot"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(wanted))  # of fixed size

    def run(batches):
        kept = np.unpackbits(shared.value).view(bool)
        useful = _useful(kept)
        for whole in batches:
            for batch in tc.pieces_of(whole, "text", 4 << 20):
                doc, feature, value = _features(batch.column("text"), buckets, kept, useful)
                order = np.argsort(doc, kind="stable")
                offsets = pa.array(np.searchsorted(doc[order], np.arange(batch.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.ListArray.from_arrays(offsets, pa.array(feature[order].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value[order].astype(np.float32)))], names=["grade", "feature", "value"])

    table = rows.mapInArrow(run, "grade int, feature array<int>, value array<float>").toArrow()
    if not table.num_rows:
        return None
    lists, values = (pa.concat_arrays(table[c].chunks) for c in ("feature", "value"))
    starts = np.asarray(lists.offsets).astype(np.int64)
    used = np.flatnonzero(wanted)  # few of the slots have a feature
    place = np.zeros(buckets, dtype=np.int32)
    place[used] = np.arange(len(used))
    grade, slots, values = table["grade"].to_numpy(), place[np.asarray(lists.flatten())], np.asarray(values.flatten())
    del table, lists
    tc.give_back()
    model = fit(starts - starts[0], slots, values, grade, len(used), grades, np.array([sizes_by.get(g, 0) for g in range(grades)], dtype=np.float64))
    live = model.weights != 0
    del grade, slots, values, place
    tc.give_back()  # the driver has little room
    return Model(model.weights[live], model.thresholds, used[live].astype(np.int64), buckets)


def score_texts(texts, model: Model) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, … of each text."""
    wanted, useful, weights = model.dense()
    doc, feature, value = _features(texts, model.buckets, wanted, useful)
    s = np.bincount(doc, weights=value * weights[feature], minlength=len(texts))
    return 1.0 - _logistic(model.thresholds[None, :] - s[:, None])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", level: int = 2, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability (of ``level`` or more), selected."""
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for whole in batches:
            for batch in tc.pieces_of(whole, "text", 8 << 20):
                tails = score_texts(tc.plain(batch.column("text")), shared.value)
                top = tails[:, level - 1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(top), pa.array(top >= least)], names=["doc_id", "expected_grade", "tail_probability", "selected"])

    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", level: int = 2, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose probability of ``level`` or more is ``least`` at the least."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, names=[f"c{i}" for i in range(whole.num_columns)])
            for batch in tc.pieces_of(whole, f"c{at}", 8 << 20):
                good = score_texts(tc.plain(batch.column(at)), shared.value)[:, level - 1] >= least
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
