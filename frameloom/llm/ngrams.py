"""Operator 4: language-model scoring by deleted interpolation.

The probability of a word after another is a mixture of maximum-likelihood
estimates of order 2, 1 and 0,

    p(w | h) = a2 * c(h w) / c(h) + a1 * c(w) / N + a0 / (V + 1),

whose weights depend on how often the context h was seen (a bucket for each
power of two). The weights of each bucket are learned by expectation
maximisation: part of the training documents is held out (``deleted``), the
estimates come from the others, and the held-out tokens, gathered over the whole
corpus as counts on a fixed grid of (order-2, order-1) estimates, say which
mixture explains them. The final counts come from all training documents.

Data flow. A task reads a block of documents (a bounded number of bytes), and
keeps each document as codes of the block's words. It sends, for each distinct
word and pair of the block, one 64-bit hash and its counts, dealt by hash
ranges. A range adds the counts of all blocks and answers each block with the
totals of what it asked. So a frequent word costs one entry a block wherever it
stands, and texts never shuffle.

The number of ranges follows the bytes of text (one for RANGE_BYTES), so a range
is as large on any corpus. Above MOST_RANGES a block would send too many small
pieces; then blocks are gathered into as many teams as a coarse range has fine
ones. A team adds the lists of its blocks in each coarse range, cuts the sum
into the fine ranges and asks there for all of them; the answers go back the
same way. A task holds a block, a team's coarse range or a fine range, each of
which has about RANGE_BYTES of lists.

Cases: a null or empty text is the end token alone. Words differ by their bytes
after A-Z are made small. With no training documents every count is 0, both
scores are those of p = 1. Documents without an id are learned from. Extra columns and repeated rows do no harm (each row
is a document of its own); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm import blobs
from frameloom.llm import textcols as tc
from frameloom.llm.shared import id_array, id_column, removed, written

RANGE_BYTES = 8 << 20  # bytes of text for each hash range
MOST_RANGES = 4096  # that a block sends pieces to
SLICE = 1 << 18  # tokens whose estimates are in memory together
TASK_BYTES = 24 << 20  # bytes of text whose lists one task works on, range by range
MOST_TASKS = 100_000

LEVELS = 48  # buckets of context frequency: none, then one for each power of two
GRID = 4  # steps of the grid of estimates for each factor of two
DEPTH = 40 * GRID  # the smallest estimate on the grid is 2 ** -40; the last step is for zero
LEAST_UNIFORM = 1e-6  # no bucket's weight of the uniform part is less
TRAIN, DELETED, OTHER = 0, 1, 2


def _hashes(words: pa.StringArray) -> np.ndarray:
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.array([f(w) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def _special(name: bytes) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(b" " + name))  # no word has a blank


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; its upper 52 bits count (a share of n / 2**52 of n pairs coincide), which spares a shuffle the rest."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + ((right << np.uint64(23)) | (right >> np.uint64(41)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(0xFFFFFFFFFFFFF000)


def _cuts(sorted_hashes: np.ndarray, first: int, n: int, width: int) -> list[int]:
    """Where each of n ranges of ``width`` hashes, from number ``first`` on, begins (and the last ends)."""
    edges = np.array([min((first + i) * width, 2**64 - 1) for i in range(n)], dtype=np.uint64)
    return np.searchsorted(sorted_hashes, edges).tolist() + [len(sorted_hashes)]


def _stream(words: tc.Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in ascending order, each token's place there (ends included), tokens of each document."""
    raw = np.r_[_hashes(words.words), _special(b"end")]
    known, code = np.unique(raw, return_inverse=True)
    counts = words.counts + 1
    codes = np.full(int(counts.sum()), code[-1], dtype=np.int64)
    codes[tc.ranges(np.cumsum(counts) - counts, words.counts)] = code[words.codes]
    return known, codes, counts


def _pairs(known: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hash of each token and its predecessor (the start's hash before the first)."""
    hashes = known[codes]
    left = np.empty_like(hashes)
    left[1:] = hashes[:-1]
    left[np.cumsum(counts) - counts] = _special(b"start")
    return _pair(left, hashes)


def _counts(inverse: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.bincount(inverse[part == p], minlength=n) for p in (TRAIN, DELETED))


def _pieces(asked: list[tuple[np.ndarray, ...]], first: int, n: int, width: int):
    """(range, body) of what is asked: for words and pairs, hashes and both counts."""
    cuts = [_cuts(a[0], first, n, width) for a in asked]
    for r in range(n):
        body = []
        for (hashes, main, deleted), cut in zip(asked, cuts, strict=True):
            s = slice(cut[r], cut[r + 1])
            body += [blobs.pack_sorted(hashes[s]), blobs.pack(main[s]), blobs.pack(deleted[s])]
        yield first + r, blobs.join(*body)


def _blocks(batches, ranges: int, width: int):
    """Rows (block, range, body): range -1 holds the documents, the others what the block asks."""
    for whole in batches:
        for batch in tc.pieces_of(whole, "text", 10 << 20):
            if not batch.num_rows:
                continue
            known, codes, counts = _stream(tc.words(batch.column("text")))
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            ids = np.ascontiguousarray(id_array(batch.column("doc_id")))
            by_token = np.repeat(parts, counts)
            asked = [(known, *_counts(codes, by_token, len(known)))]
            grams, inverse = np.unique(_pairs(known, codes, counts), return_inverse=True)
            asked.append((grams, *_counts(inverse, by_token, len(grams))))
            name = uuid.uuid4().hex
            rows = [(-1, blobs.join(blobs.pack(ids.view(np.uint64)), blobs.pack(parts), blobs.pack(counts), blobs.pack_sorted(known), blobs.pack(codes)))]
            rows += _pieces(asked, 0, ranges, width)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "part_no", "body"])


def _opened(body: bytes) -> list[np.ndarray]:
    return [blobs.unpack_sorted(p) if i % 3 == 0 else blobs.unpack(p).astype(np.int64) for i, p in enumerate(blobs.split(body))]


def _added(asked: list[list[np.ndarray]], level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct hashes of a level, each entry's place among them, both totals, and where each list begins."""
    known, inverse = np.unique(np.concatenate([a[3 * level] for a in asked]), return_inverse=True)
    both = [np.bincount(inverse, weights=np.concatenate([a[3 * level + 1 + p] for a in asked]), minlength=len(known)).astype(np.int64) for p in (TRAIN, DELETED)]
    return known, inverse, both, np.cumsum([0] + [len(a[3 * level]) for a in asked])


_FIELDS = pa.schema([("block", pa.string()), ("part_no", pa.int64()), ("body", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """One hash range: totals for each block; the row without a block has sums of the range."""
    asked = [_opened(b) for b in table["body"].to_pylist()]
    replies: list[list[bytes]] = [[] for _ in asked]
    sums = []
    for level in range(2):
        _, inverse, both, at = _added(asked, level)
        for i in range(len(asked)):
            mine = inverse[at[i] : at[i + 1]]
            replies[i] += [blobs.pack(b[mine]) for b in both]
        if level == 0:
            sums = [both[0].sum(), both[1].sum(), (both[0] > 0).sum(), (both[0] + both[1] > 0).sum()]
    part = table["part_no"][0].as_py()
    del asked
    tc.give_back()
    return pa.table([[*table["block"].to_pylist(), ""], [part] * (len(replies) + 1), [blobs.join(*r) for r in replies] + [blobs.pack(np.array(sums))]], schema=_FIELDS)


def _asked_together(table: pa.Table, fine: int, width: int) -> pa.Table:
    """What the blocks of a team ask in a coarse range, added and cut into its fine ranges."""
    asked = [_opened(b) for b in table["body"].to_pylist()]
    sums = []
    for level in range(2):
        known, _, both, _ = _added(asked, level)
        sums.append((known, *both))
    rows = list(_pieces(sums, table["part_no"][0].as_py() * fine, fine, width))
    return pa.table([[str(table["team"][0].as_py())] * len(rows), [r[0] for r in rows], [r[1] for r in rows]], schema=_FIELDS)


def _told_apart(table: pa.Table) -> pa.Table:
    """A team's answers in a coarse range, given to its blocks."""
    table = table.sort_by([("fine", "ascending"), ("block", "ascending")])
    mine = [f < 0 for f in table["fine"].to_pylist()]
    asked = [_opened(b) for b, m in zip(table["body"].to_pylist(), mine, strict=True) if m]
    told = [blobs.split(b) for b, m in zip(table["body"].to_pylist(), mine, strict=True) if not m]
    replies: list[list[bytes]] = [[] for _ in asked]
    for level in range(2):
        _, inverse, _, at = _added(asked, level)
        for p in (TRAIN, DELETED):
            total = np.concatenate([blobs.unpack(t[2 * level + p]) for t in told])
            for i in range(len(asked)):
                replies[i].append(blobs.pack(total[inverse[at[i] : at[i + 1]]]))
    return pa.table([table["block"].to_pylist()[: len(asked)], table["part_no"].to_pylist()[: len(asked)], [blobs.join(*r) for r in replies]], schema=_FIELDS)


def _totals(asked: DataFrame, fine: int, width: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Answers to all blocks, and the sums of the ranges (one row each)."""
    schema = "block string, part_no bigint, body binary"
    dealt = lambda d, *keys: d.repartition(tasks, *keys).groupBy(*keys)
    if fine == 1:
        answers = written(dealt(asked, "part_no").applyInArrow(_answer, schema), "ngram-answers")
        return answers.where("block <> ''"), answers.where("block = ''")
    teamed = asked.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(fine)))
    together = written(dealt(teamed, "team", "part_no").applyInArrow(lambda t: _asked_together(t, fine, width), schema), "ngram-teams")
    found = written(dealt(together, "part_no").applyInArrow(_answer, schema), "ngram-answers")
    back = found.where("block <> ''").select(F.col("block").cast("bigint").alias("team"), F.floor(F.col("part_no") / fine).alias("part_no"), F.lit("").alias("block"), F.pmod("part_no", F.lit(fine)).alias("fine"), "body")
    both = teamed.select("team", "part_no", "block", F.lit(-1).cast("bigint").alias("fine"), "body").unionByName(back)
    return written(dealt(both, "team", "part_no").applyInArrow(_told_apart, schema), "ngram-told"), found.where("block = ''")


def _whole(table: pa.Table) -> pa.Table:
    """One block: its documents and all answers, joined in order of the ranges."""
    order = np.argsort(table["part_no"].to_numpy())
    bodies = [table["body"][int(i)].as_py() for i in order]
    replies = [blobs.split(b) for b in bodies[1:]]
    sums = [blobs.pack(np.concatenate([blobs.unpack(r[k]) for r in replies])) for k in range(4)]
    tc.give_back()
    return pa.table({"block": table["block"].slice(0, 1), "body": pa.array([blobs.join(bodies[0], *sums)], pa.binary())})


class _Block:
    """A block's documents with the corpus counts of their tokens."""

    def __init__(self, body: bytes):
        docs, *sums = blobs.split(body)
        ids, parts, counts, known, codes = blobs.split(docs)
        self.ids = blobs.unpack(ids).view(np.int64)
        self.parts = blobs.unpack(parts).astype(np.int64)
        self.counts = blobs.unpack(counts).astype(np.int64)
        known, self.codes = blobs.unpack_sorted(known), blobs.unpack(codes).astype(np.int64)
        _, self.pairs = np.unique(_pairs(known, self.codes, self.counts), return_inverse=True)
        self.word_main, word_del, self.pair_main, pair_del = (blobs.unpack(s).astype(np.int64) for s in sums)
        self.word_all, self.pair_all = self.word_main + word_del, self.pair_main + pair_del

    def estimates(self, total: dict, main: bool):
        """Context bucket, order-2 and order-1 estimate, count and document of each token, a slice of tokens at a time."""
        words, pairs = (self.word_main, self.pair_main) if main else (self.word_all, self.pair_all)
        n, starts = (total["n_main"], total["docs_main"]) if main else (total["n"], total["docs"])
        first, owner = np.cumsum(self.counts) - self.counts, np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        for lo in range(0, len(self.codes), SLICE):
            hi = min(lo + SLICE, len(self.codes))
            context = words[self.codes[lo - 1 : hi - 1]] if lo else np.r_[0, words[self.codes[: hi - 1]]]
            context[first[(first >= lo) & (first < hi)] - lo] = starts
            c, both = words[self.codes[lo:hi]], pairs[self.pairs[lo:hi]]
            bucket = np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)
            yield np.minimum(bucket, LEVELS - 1), both / np.maximum(context, 1), c / max(n, 1), c, owner[lo:hi]


def _step(p: np.ndarray) -> np.ndarray:
    """The grid step of estimates; DEPTH for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-GRID * np.log2(np.maximum(p, 1e-300))), DEPTH - 1), DEPTH).astype(np.int64)


def _grid(batches, total: dict):
    """Held-out tokens on the grid: (cell, n)."""
    for batch in batches:
        for body in batch.column("body"):
            block = _Block(body.as_py())
            for bucket, f2, f1, _, doc in block.estimates(total, True):
                here = block.parts[doc] == DELETED
                cells, n = np.unique((bucket[here] * (DEPTH + 1) + _step(f2[here])) * (DEPTH + 1) + _step(f1[here]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])
            tc.give_back()


def weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (order 2, 1, 0) of each bucket by expectation maximisation.

    A bucket without held-out tokens takes those of all tokens together; with
    none at all everything goes to the uniform part.
    """
    steps = np.r_[np.exp2(-np.arange(DEPTH) / GRID), 0.0]
    f = np.stack([steps[cells // (DEPTH + 1) % (DEPTH + 1)], steps[cells % (DEPTH + 1)], np.full(len(cells), uniform)], axis=1)
    bucket = cells // (DEPTH + 1) ** 2

    def fitted(at: np.ndarray) -> np.ndarray:
        a, mass = np.full(3, 1 / 3), n[at].astype(np.float64)
        if not mass.sum():
            return np.array([0.0, 0.0, 1.0])
        for _ in range(rounds):
            share = f[at] * a
            share /= share.sum(axis=1, keepdims=True)
            a = (share * mass[:, None]).sum(axis=0) / mass.sum()
        a[2] = max(a[2], LEAST_UNIFORM)
        return a / a.sum()

    everything = fitted(np.ones(len(cells), dtype=bool))
    out = np.tile(everything, (LEVELS, 1))
    for b in np.unique(bucket):
        out[b] = fitted(bucket == b)
    none = out[0]
    none[:] = np.array([0.0, none[1] + none[0], none[2]])
    return out


def _scores(batches, total: dict, mixture: np.ndarray):
    for batch in batches:
        for body in batch.column("body"):
            block = _Block(body.as_py())
            n = len(block.ids)
            known, base, model = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for bucket, f2, f1, c, doc in block.estimates(total, False):
                p = mixture[bucket, 0] * f2 + mixture[bucket, 1] * f1 + mixture[bucket, 2] / (total["v"] + 1)
                model += np.bincount(doc, weights=np.log10(p), minlength=n)
                base += np.bincount(doc, weights=np.log10((c + 1) / (total["n"] + 1 * (total["v"] + 1))), minlength=n)
                known += np.bincount(doc[c > 0], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [id_column(block.ids), pa.array(block.parts == OTHER), pa.array(block.counts), pa.array(known), pa.array(np.full(n, total["n"], np.int64)), pa.array(base), pa.array(model)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del block
            tc.give_back()


def ranges_for(size: int, most: int = MOST_RANGES) -> tuple[int, int]:
    """Coarse ranges, and fine ranges of each, for so many bytes of text."""
    wanted = max(1, -(-size // RANGE_BYTES))
    if wanted <= most:
        return wanted, 1
    fine = int(np.ceil(np.sqrt(wanted)))
    return fine, fine


def _numbers(names: list[str]):
    """Packed lists of a few numbers as columns."""

    def run(batches):
        for batch in batches:
            rows = np.array([blobs.unpack(b) for b in batch.column("body").to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=names)

    return run


def score(docs: DataFrame, held_out, deleted, id_col: str = "doc_id", text_col: str = "text", ranges: tuple[int, int] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` and ``deleted`` are Boolean columns: documents that are not
    learned from, and those of the rest that weigh the mixture. Ids are whole
    numbers. ``ranges`` is the number of coarse hash ranges and of fine ones in
    each (default: by the bytes of text).
    """
    part = F.when(F.coalesce(held_out, F.lit(False)), OTHER).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(TRAIN)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), part.alias("part"))
    sizes = {r["part"]: (r["n"], r["size"] or 0) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    size, n_docs = sum(b for _, b in sizes.values()), {p: n for p, (n, _) in sizes.items()}
    coarse, fine = ranges or ranges_for(size)
    width = (2**64 + coarse * fine - 1) // (coarse * fine)
    tasks = min(MOST_TASKS, max(1, -(-size // TASK_BYTES)))
    schema = "block string, part_no bigint, body binary"
    blocks = written(rows.mapInArrow(lambda b: _blocks(b, coarse, width * fine), schema).withColumn("kind", F.expr("if(part_no < 0, 'docs', 'asked')")), "ngram-blocks", ["kind"])
    answers, of_ranges = _totals(blocks.where("kind = 'asked'").drop("kind"), fine, width, tasks)
    names = ["n_main", "n_deleted", "v_main", "v_all"]
    added = of_ranges.select("body").mapInArrow(_numbers(names), ", ".join(f"{c} bigint" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    n_main, n_deleted, v_main, v_all = map(int, added)
    total = {"n_main": n_main, "n": n_main + n_deleted, "v_main": v_main, "v": v_all, "docs_main": n_docs.get(TRAIN, 0), "docs": n_docs.get(TRAIN, 0) + n_docs.get(DELETED, 0)}
    removed(blocks, "kind=asked")
    both = blocks.where("kind = 'docs'").drop("kind").unionByName(answers)
    joined = written(both.repartition(tasks, "block").groupBy("block").applyInArrow(_whole, "block string, body binary"), "ngram-joined")
    removed(answers)
    cells = joined.select("body").mapInArrow(lambda b: _grid(b, total), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(cells["cell"].to_numpy())
    mixture = weights(cells["cell"].to_numpy()[order], cells["n"].to_numpy()[order], 1.0 / (total["v_main"] + 1))
    return joined.select("body").mapInArrow(lambda b: _scores(b, total, mixture), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
