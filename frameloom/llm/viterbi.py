"""Operator 3: token counts by a count-only Viterbi search.

An Aho-Corasick automaton lists every occurrence of a unigram vocabulary's
pieces; dynamic programming over end positions carries only the best score and
the number of pieces, never the pieces. The rules are those of the tokenizers
library's unigram model: scores add in double precision from the left, a
character that is no piece by itself may be passed at the least score minus 10,
and of equal scores the path through the earliest start (the longest last
piece) stays. A passed character counts one for each of its UTF-8 bytes where
byte pieces exist, else runs of them count one.

All distinct words of a batch go through the search side by side: words are
independent because no piece has a word mark inside (this is checked on load).

Cases: null and empty texts have no tokens; repeated rows, ties, extra columns
and empty tables are unremarkable.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from frameloom.llm import textcols as tc
from frameloom.llm.sentencepieces import MARK, units
from frameloom.llm.shared import only

PENALTY = 10.0
_GAP = "\x00"


class Vocabulary:
    """Pieces with scores, as an automaton."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_known: bool):
        import ahocorasick

        bad = [p for p in pieces if MARK in p.lstrip(MARK)]
        if bad:
            raise ValueError(f"pieces with a word mark inside: {bad[:3]}")
        self.pieces, self.bytes_known = pieces, bytes_known
        self.scores = np.array(scores, dtype=np.float64)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.least = float(self.scores.min()) - PENALTY if len(scores) else -PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.singles = np.zeros(0x110000, dtype=bool)
        self.singles[[ord(p) for p in pieces if len(p) == 1]] = True


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The normal pieces of a SentencePiece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return Vocabulary([model.id_to_piece(i) for i in normal], [model.get_score(i) for i in normal], any(model.is_byte(i) for i in range(model.get_piece_size())))


def count_words(words: pa.StringArray, vocabulary: Vocabulary, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces and best score of each word (a mark before it)."""
    parts = [_count_block(words.slice(first, block), vocabulary) for first in range(0, len(words), block)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _count_block(words: pa.StringArray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(""), words, MARK), pattern=" ", replacement=MARK)
    with_gaps = pc.binary_join_element_wise(marked, pa.scalar(""), _GAP)
    points, at = tc.codepoints(with_gaps)
    sizes = np.diff(at)  # a gap follows each word
    text = points.tobytes().decode("utf-32-le")
    found = np.fromiter(chain.from_iterable(vocabulary.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(points)) - np.repeat(at[:-1], sizes)
    # nodes lie before each character and at the word's end, which is the gap's place
    end = found[:, 0] + 1
    start = end - vocabulary.lengths[found[:, 1]]
    gain, step = vocabulary.scores[found[:, 1]], np.ones(len(found), dtype=np.int64)
    inside = np.ones(len(points), dtype=bool)
    inside[at[1:] - 1] = False
    passed = np.flatnonzero(inside & ~vocabulary.singles[points])
    real = inside[start] & (owner[start] == owner[np.minimum(end, len(points) - 1)])
    end, start, gain, step = end[real], start[real], gain[real], step[real]
    if len(passed):
        end, start = np.r_[end, passed + 1], np.r_[start, passed]
        gain = np.r_[gain, np.full(len(passed), vocabulary.least)]
        width = 1 + (points[passed] > 0x7F) + (points[passed] > 0x7FF) + (points[passed] > 0xFFFF)
        step = np.r_[step, width if vocabulary.bytes_known else np.zeros(len(passed), np.int64)]
    order = np.lexsort((start, end, place[end]))
    end, start, gain, step = end[order], start[order], gain[order], step[order]
    best, pieces = np.zeros(len(points)), np.zeros(len(points), dtype=np.int64)
    unknown_ends = np.zeros(len(points) + 1, dtype=bool)
    is_pass = step == 0
    cuts = np.flatnonzero(np.r_[True, np.diff(place[end]) > 0, True]) if len(end) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ends, starts = end[a:b], start[a:b]
        total = best[starts] + gain[a:b]
        heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        top = np.repeat(np.maximum.reduceat(total, heads), np.diff(np.r_[heads, b - a]))
        hit = np.flatnonzero(total == top)
        hit = hit[np.r_[True, ends[hit[1:]] != ends[hit[:-1]]]]
        e, s = ends[hit], starts[hit]
        best[e] = total[hit]
        through = is_pass[a:b][hit]
        pieces[e] = pieces[s] + np.where(through, ~unknown_ends[s], step[a:b][hit])
        unknown_ends[e] = through
    last = at[1:] - 1
    return pieces[last], best[last]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, best_score."""

    def run(batches):
        vocabulary = load(model_path)
        for whole in batches:
            for batch in tc.pieces_of(whole, "text"):
                found = units(batch.column("text"))
                counts, scores = count_words(found.words, vocabulary)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.per_doc(counts)), pa.array(found.per_doc(scores))], names=["doc_id", "n_tokens", "best_score"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, best_score double")
