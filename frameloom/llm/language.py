"""Operator 2: language identification by prediction by partial matching.

Each language has a byte context tree of variable order, its counts frozen
after training. A byte after a context of order k costs -log2(count / (n + q))
bits where the context has seen it (n: its total, q: its distinct bytes), else
the escape -log2(q / (n + q)) and then what the shorter context asks; a context
never seen costs nothing; below order 0 every byte and the word's end cost
log2(257). A text is coded word by word (contexts start anew at a blank, a
blank byte leads each word), so the exact code length of a word is found once a
batch. The language with the shortest code is predicted; score is its share of
the codes' probabilities, in (0, 1].

Cases: null texts and texts without a letter are ``und`` with score 0; so is
everything if nothing can be learned from. Ties go to the first language in
alphabetical order. Extra columns, repeated rows and an empty table do no harm.
Training reads whole texts of about ``per_language`` documents of each language
at most, and about ``most_bytes`` in all (an equal part of each, chosen by a hash
of the id; the document with the least hash of each language always). Every
language is learned, however many there are: their trees are kept in groups of
``together`` languages, and where the tables of all groups would have more than
``most_cells`` entries, the sample of every language is thinned, down to one
document of each. These bounds are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm import textcols as tc
from frameloom.llm.shared import only

UNDETERMINED = "und"
_BLANK = 0x20


@dataclass
class Trees:
    """Frozen costs of a group of languages; row i of ``costs[k]`` belongs to ``grams[k][i]``.

    A gram of order k is k context bytes and the byte coded, packed into an
    integer. ``costs`` holds full costs (escapes included) in bits for each
    language, ``escapes`` those of leaving a context.
    """

    languages: list[str]
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


@dataclass
class Model:
    """The trees of all languages, group by group in alphabetical order."""

    groups: list[Trees]

    @property
    def languages(self) -> list[str]:
        return [name for g in self.groups for name in g.languages]


def _packed(words: pa.StringArray, order: int):
    """For each byte of each word: the packed context and byte, by order; and each word's first byte's place."""
    data, at = tc.byte_rows(words)
    n = np.diff(at)
    n1 = n + 1  # a blank leads
    starts = np.cumsum(n1) - n1
    stream = np.full(int(n1.sum()), _BLANK, dtype=np.int64)
    inner = tc.ranges(starts + 1, n)
    stream[inner] = data
    place = np.arange(len(stream)) - np.repeat(starts, n1)
    return stream, place, starts, n1


def _gram(stream: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before and the byte at ``where``, packed."""
    out = np.zeros(len(where), dtype=np.int64)
    for back in range(k, -1, -1):
        out = (out << 8) | stream[where - back]
    return out


def _count_batches(batches, order: int):
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        which = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            units = tc.words(batch.column("text").filter(pa.array(which == code)), lower=False)
            if not len(units.words):
                continue
            weight = np.bincount(units.codes, minlength=len(units.words))
            stream, place, _, n1 = _packed(units.words, order)
            weight = np.repeat(weight, n1)
            for k in range(order + 1):
                where = np.flatnonzero(place >= max(k, 1))  # the leading blank is context only
                grams, inverse = np.unique(_gram(stream, where, k), return_inverse=True)
                counts = np.bincount(inverse, weights=weight[where]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), k, np.int32)), pa.array(grams), pa.array(counts)], names=["lang", "k", "gram", "n"])


def train(
    docs: DataFrame, per_language: int = 1500, order: int = 4, only_where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = 64 << 20, most_cells: int = 48_000_000, together: int = 8
) -> Model:
    """Learn the context trees of every language in ``lang_col``."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    if only_where is not None:
        rows = rows.where(only_where)
    whole = 1 << 20
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(whole))
    rows = rows.where("text is not null and lang is not null").withColumn("_draw", draw)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("_draw").alias("least")).collect()  # a row for each language
    if not sizes:
        return Model([])
    languages, thinned = sorted(r["lang"] for r in sizes), 1.0
    groups = [languages[i : i + together] for i in range(0, len(languages), together)]
    while True:
        part = lambda r: min(whole, per_language * whole // r["n"] + 1, most_bytes // len(sizes) * whole // max(r["bytes"], 1) + 1) * thinned  # noqa: B023, E731
        shares = [(r["lang"], max(int(part(r)), r["least"] + 1)) for r in sizes]
        some = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, _share bigint")), "lang").where(F.col("_draw") < F.col("_share"))
        counted = some.select("lang", "text").mapInArrow(lambda b: _count_batches(b, order), "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
        cells = sum(len(g) * len(np.unique(own["gram"].to_numpy() * (order + 1) + own["k"].to_numpy())) for g in groups if (own := _of(counted, g)).num_rows)
        if cells <= most_cells or thinned < 1 / whole:
            break
        thinned *= min(0.5, most_cells / cells)
    model = Model([_frozen(_of(counted, g), g, order) for g in groups])
    del counted
    tc.give_back()  # the driver has little room
    return model


def _of(counted: pa.Table, languages: list[str]) -> pa.Table:
    return counted.filter(pc.is_in(counted["lang"], pa.array(languages)))


def _frozen(counted: pa.Table, languages: list[str], order: int) -> Trees:
    lang = pc.index_in(counted["lang"], pa.array(languages)).to_numpy()
    level, gram, n = counted["k"].to_numpy(), counted["gram"].to_numpy(), counted["n"].to_numpy()
    trees = Trees(languages, [], [], [], [])
    for k in range(order + 1):
        at = level == k
        keys, row = np.unique(gram[at], return_inverse=True)
        table = np.zeros((len(keys), len(languages)))
        table[row, lang[at]] = n[at]
        contexts, owner = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, owner, table)
        np.add.at(kinds, owner, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            seen = -np.log2(table / (total + kinds)[owner])
        below = np.full((len(keys), len(languages)), np.log2(257.0)) if not k else _cost(trees, keys & ((1 << (8 * k)) - 1), k - 1)
        trees.grams.append(keys)
        trees.costs.append(np.where(table > 0, seen, escape[owner] + below).astype(np.float64))
        trees.contexts.append(contexts)
        trees.escapes.append(escape)
    return trees


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _cost(trees: Trees, grams: np.ndarray, k: int) -> np.ndarray:
    """Bits of each gram of order k for each language."""
    out = np.zeros((len(grams), len(trees.languages)))
    open_ = np.arange(len(grams))
    while len(open_):
        keys = grams[open_] & ((1 << (8 * (k + 1))) - 1)
        at, hit = _find(trees.grams[k], keys)
        out[open_[hit]] += trees.costs[k][at[hit]]
        open_, keys = open_[~hit], keys[~hit]
        at, hit = _find(trees.contexts[k], keys >> 8)
        out[open_[hit]] += trees.escapes[k][at[hit]]
        if k == 0:
            out[open_] += np.log2(257.0)
            break
        k -= 1
    return out


def word_costs(words: pa.StringArray, trees: Trees, block: int = 1 << 15) -> np.ndarray:
    """Bits of each word for each language of a group."""
    parts = [_word_costs(words.slice(first, block), trees) for first in range(0, len(words), block)]
    return np.concatenate(parts) if parts else np.zeros((0, len(trees.languages)))


def _word_costs(words: pa.StringArray, trees: Trees) -> np.ndarray:
    order = len(trees.grams) - 1
    stream, place, starts, n1 = _packed(words, order)
    bits = np.zeros((len(stream), len(trees.languages)))
    for k in range(1, order + 1):
        where = np.flatnonzero(place >= k if k == order else place == k)
        if len(where):
            grams, inverse = np.unique(_gram(stream, where, k), return_inverse=True)
            bits[where] = _cost(trees, grams, k)[inverse]
    return np.add.reduceat(bits, starts, axis=0) if len(starts) else bits[:0]


def score_texts(texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: undetermined) and its share, for each text."""
    texts = tc.plain(texts)
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return np.full(len(texts), -1), np.zeros(len(texts))
    docs = tc.words(texts, lower=False)
    columns = []
    for trees in model.groups:
        by_word = word_costs(docs.words, trees)
        columns += [docs.per_doc(np.ascontiguousarray(by_word[:, j])) if len(by_word) else np.zeros(len(texts)) for j in range(len(trees.languages))]
    bits = np.stack(columns, axis=1)
    best = bits.argmin(axis=1)
    share = 1.0 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
    return np.where(letters, best, -1), np.where(letters, share, 0.0)


def identify(docs: DataFrame, trees: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def run(batches):
        names = pa.array([*model.value.languages, UNDETERMINED])
        for whole in batches:
            for batch in tc.pieces_of(whole, "text", 8 << 20):
                best, share = score_texts(batch.column("text"), model.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(best % len(names))), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, trees: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language is found with a score of ``least`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, names=[f"c{i}" for i in range(whole.num_columns)])
            for batch in tc.pieces_of(whole, f"c{at}", 8 << 20):
                best, share = score_texts(batch.column(at), model.value)
                kept = batch.filter(pa.array((best >= 0) & (share >= least)))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.mapInArrow(run, docs.schema)
