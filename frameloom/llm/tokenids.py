"""Token ids of whole texts with the tokenizers library, each distinct word encoded once.

Words are cut where the tokenizer never looks across (the callers say how), the
distinct words of a batch are joined into long strings, and the ids of a string
are dealt back to its words by the bytes that the tokens cover.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from frameloom.llm import textcols as tc

_JOINED = 512  # words in one string
KEPT_WORDS = 800_000  # words whose ids a worker keeps
_UNEVEN = re.compile(r"[^\S ]|  |^ | $")


class Encoder:
    """One tokenizer file; ``word_end`` is what its tokens add to a word's last piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.spaced = bool(suffix)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix(suffix) if suffix else token)

        self.forget()

    def forget(self) -> None:
        """Nothing is kept: words, ids, where each word's start, and how many it has."""
        self.kept = (pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has.

        Of a byte-level tokenizer the words must start where a match always
        starts; others are kept apart by a space, which they drop.
        """
        glue = " " if self.spaced else ""
        words, lengths = array.to_pylist(), pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, counts = [], []
        for first in range(0, len(words), _JOINED):
            part = words[first : first + _JOINED]
            joined = glue.join(part)
            ids = np.array(self._ids(joined), dtype=np.int64)
            if self.spaced and not joined.isascii():
                if _UNEVEN.search(joined):  # other blanks than the glue, or empty words
                    shown = ["".join(self.tokenizer.normalizer.normalize_str(w).split()) for w in part]
                else:
                    shown = self.tokenizer.normalizer.normalize_str(joined).split(" ")
                sizes = np.array([len(x.encode()) for x in shown], dtype=np.int64)
            else:
                sizes = lengths[first : first + _JOINED]
            ends = np.cumsum(self.width[ids])
            at = np.searchsorted(ends, np.cumsum(sizes), side="right")
            exact = len(ids) == 0 and not sizes.any() or len(ids) and ends[-1] == sizes.sum() and (ends[at[at > 0] - 1] == np.cumsum(sizes)[at > 0]).all()
            if not exact:  # cannot be dealt back: one by one
                each = [self._ids(w) for w in part]
                flat.append(np.array([i for e in each for i in e], dtype=np.int64))
                counts += [len(e) for e in each]
                continue
            flat.append(ids)
            counts += np.diff(at, prepend=0).tolist()
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).astype(np.uint32), np.array(counts, dtype=np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


_STARTS = re.compile(r"(?= \S)")
#: Blanks that the pattern language's \s leaves out.
_ODD_BLANKS = r"[\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_level_units(texts) -> tc.Units:
    """Units that start at a space before a non-blank, where a byte-level match always starts.

    A unit is written as in the text, except that most have their leading space.
    """
    texts = tc.plain(texts)
    # plain documents: no blanks but single spaces inside; their words are " w", the first one "w"
    odd = pc.or_(pc.match_substring_regex(texts, r"\s\s|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^\s|\s$"), pc.equal(texts, ""))
    special = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    fast = tc.coded_lists(texts, " ")
    lists = [[u for u in _STARTS.split(t) if u] for t in texts.take(pa.array(special)).to_pylist()]
    # the first unit of a plain document has no space: told apart by a mark that no text has at its start
    words = pc.binary_join_element_wise(pa.scalar(" "), fast.words, "") if len(fast.words) else fast.words
    firsts = fast.codes[fast.starts] if len(fast.starts) else np.zeros(0, np.int32)
    first_codes, first_inverse = np.unique(firsts, return_inverse=True)
    codes = fast.codes.copy()
    if len(fast.starts):
        codes[fast.starts] = len(words) + first_inverse
    both = pa.concat_arrays([words, fast.words.take(pa.array(first_codes))]) if len(words) else words
    return tc.with_special(tc.Units(both, codes, fast.starts, fast.counts), special, lists)


def _encoded(encoder: Encoder, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of distinct units, and how many each has."""
    if encoder.spaced:
        return encoder.words(words)
    regular = pc.match_substring_regex(words, r"(?s)^ [^\s](.*[^\s])?$").to_numpy(zero_copy_only=False)
    if len(words):  # other blanks than the pattern's are rare: those units are encoded alone
        regular &= ~pc.match_substring_regex(words, _ODD_BLANKS).to_numpy(zero_copy_only=False)
    some, rest = np.flatnonzero(regular), np.flatnonzero(~regular)
    ids_a, n_a = encoder.words(words.take(pa.array(some)))
    each = [encoder._ids(w) for w in words.take(pa.array(rest)).to_pylist()]
    counts = np.zeros(len(words), dtype=np.int64)
    counts[some], counts[rest] = n_a, [len(e) for e in each]
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), dtype=np.uint32)
    ids[tc.ranges(starts[some], n_a)] = ids_a
    ids[tc.ranges(starts[rest], counts[rest])] = np.array([i for e in each for i in e], dtype=np.uint32)
    return ids, counts


def encoded_units(encoder: Encoder, units: tc.Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in which every distinct unit's lie, where each starts, and how many it has.

    Units that the worker has met lately are not encoded again; what it keeps
    is bounded by KEPT_WORDS.
    """
    known, known_ids, known_starts, known_counts = encoder.kept
    place = pc.index_in(units.words, known) if len(known) else pa.nulls(len(units.words), pa.int32())
    new = place.is_null().to_numpy(zero_copy_only=False)
    at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)
    fresh = units.words.filter(pa.array(new))
    fresh_ids, fresh_counts = _encoded(encoder, fresh)
    starts, counts = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)
    if len(known):
        starts[~new], counts[~new] = known_starts[at[~new]], known_counts[at[~new]]
    fresh_starts = len(known_ids) + np.cumsum(fresh_counts) - fresh_counts
    starts[new], counts[new] = fresh_starts, fresh_counts
    ids = np.concatenate([known_ids, fresh_ids])
    if len(known) + len(fresh) <= KEPT_WORDS:
        encoder.kept = (pa.concat_arrays([known, fresh]), ids, np.r_[known_starts, fresh_starts], np.r_[known_counts, fresh_counts])
    elif len(new) <= KEPT_WORDS:  # begin anew with this batch
        encoder.kept = (pa.concat_arrays([units.words]), ids[tc.ranges(starts, counts)], np.cumsum(counts) - counts, counts)
    else:
        encoder.forget()
    return ids, starts, counts


def encode(texts, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts (each followed by ``end``), and how many each has."""
    encoder = load(path)
    units = tc.words(texts, lower=False) if encoder.spaced else byte_level_units(texts)
    ids, starts, counts = encoded_units(encoder, units)
    sizes = units.per_doc(counts)
    extra = int(end is not None)
    out = np.empty(int(sizes.sum()) + extra * len(sizes), dtype=np.uint32)
    firsts = np.cumsum(sizes + extra) - (sizes + extra)
    for a, b in _blocks(units.counts, 1 << 19):  # places of ids take much more room than ids
        codes = units.codes[units.starts[a] : units.starts[b - 1] + units.counts[b - 1]]
        out[tc.ranges(firsts[a:b], sizes[a:b])] = ids[tc.ranges(starts[codes], counts[codes])]
    if extra:
        out[firsts + sizes] = end
    return out, sizes + extra


def _blocks(counts: np.ndarray, most: int):
    """(first, end) of runs of documents with about ``most`` units."""
    total, first = np.cumsum(counts), 0
    while first < len(counts):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + most, side="right")))
        yield first, last
        first = last
