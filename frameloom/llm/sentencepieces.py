"""Operator 1: SentencePiece encoding and decoding by vectorised merge rounds.

All distinct words of a batch are merged at once. Their symbols lie in one flat
array; each round finds the least pair rank of every word (a segmented
minimum), merges its leftmost occurrence in all words simultaneously, and
compacts the arrays; words without a mergeable pair leave.

Exactness. The library merges the adjacent pair whose joined string has the
best score, leftmost first. No piece of such a vocabulary has a word mark
inside, so words (a mark and what follows up to the next) are independent.
Where no longer piece that starts or ends with the merged piece has a better
rank, a merge cannot create a better pair, so all further occurrences of that
piece are merged in the same round, leftmost first; else one merge is made.

Long words (no blank for LONG characters) would need a round for every few
merges. There the minimum is taken over the pairs within the length of the
longest piece on either side instead of over the word: whatever could reach a
pair before its turn is made of pairs there, so a pair that is the minimum
around itself is merged at once, and the cost grows with the length. Of equal
pairs that a merge could disturb, those after the first that made a better pair
wait for the next round.

Cases: null and empty texts have no ids and decode to the empty text; runs of
spaces and word marks in the text are one unit; characters outside the
vocabulary become byte pieces. Rows are independent: repeated rows, ties and
extra columns have no effect, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from frameloom.llm import textcols as tc
from frameloom.llm.shared import only

MARK = "▁"
NONE = np.int32(2**31 - 1)
LONG = 512  # characters of a word from which on minima are taken around each pair
_OUTSIDE = 1 << 20  # symbols of characters that no piece has: this and the code point


@dataclass
class Pieces:
    """Tables of one vocabulary."""

    texts: list[str]
    byte_ids: np.ndarray  # id of each byte's piece, -1 without
    symbol_of: np.ndarray  # code point -> symbol
    id_of: np.ndarray  # symbol -> id, -1 for characters that are no piece
    slot_key: np.ndarray  # hash table of pairs of symbols
    slot_rank: np.ndarray
    slot_symbol: np.ndarray
    single: np.ndarray  # rank -> only one merge in a round
    shift: int
    longest: int  # characters of the longest piece
    decoded: np.ndarray  # id -> bytes, as objects
    byte_value: np.ndarray  # id -> byte of a byte piece, else -1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each joined pair; rank NONE where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * _SPREAD) >> np.uint64(self.shift)).astype(np.int64)
        found = self.slot_key[slot]
        rank = np.where(found == key, self.slot_rank[slot], NONE)
        symbol = self.slot_symbol[slot]
        open_ = np.flatnonzero((found != key) & (found != _FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slot_key) - 1)
            there = self.slot_key[slot[open_]]
            hit = there == key[open_]
            rank[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            symbol[open_[hit]] = self.slot_symbol[slot[open_[hit]]]
            open_ = open_[~hit & (there != _FREE)]
        return rank, symbol


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(2**64 - 1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Read a SentencePiece BPE model file and build the merge tables."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(size)]
    is_byte = np.array([model.is_byte(i) for i in range(size)])
    normal = {t: i for i, t in enumerate(texts) if not (is_byte[i] or model.is_control(i) or model.is_unknown(i))}
    byte_ids = np.full(256, -1, dtype=np.int32)
    byte_value = np.full(size, -1, dtype=np.int32)
    for i in np.flatnonzero(is_byte):
        byte_value[i] = int(texts[i][3:5], 16)
        byte_ids[byte_value[i]] = i
    symbols = dict(normal)
    for t in normal:
        for ch in t:
            symbols.setdefault(ch, size + len(symbols))
    symbol_of = np.arange(0x110000, dtype=np.int32) + _OUTSIDE
    for t, s in symbols.items():
        if len(t) == 1:
            symbol_of[ord(t)] = s
    order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in normal.values()}, reverse=True))}
    rank_of = {t: order[model.get_score(i)] for t, i in normal.items()}
    best_longer: dict[str, int] = {}
    pairs: dict[int, tuple[int, int]] = {}
    for t, i in normal.items():
        for cut in range(1, len(t)):
            a, b = t[:cut], t[cut:]
            for part in (a, b):
                best_longer[part] = min(best_longer.get(part, int(NONE)), rank_of[t])
            if a in symbols and b in symbols:
                pairs[symbols[a] << 32 | symbols[b]] = (rank_of[t], i)
    single = np.zeros(len(order), dtype=bool)
    owner: dict[int, str] = {}
    for t, r in rank_of.items():
        if best_longer.get(t, int(NONE)) <= r or r in owner:  # pieces of equal score: one at a time
            single[r] = True
        owner[r] = t
    bits = max(4, (4 * len(pairs)).bit_length())
    slot_key = np.full(1 << bits, _FREE, dtype=np.uint64)
    slot_rank = np.full(1 << bits, NONE, dtype=np.int32)
    slot_symbol = np.zeros(1 << bits, dtype=np.int32)
    for key, (rank, symbol) in pairs.items():
        at = ((key * int(_SPREAD)) & (2**64 - 1)) >> (64 - bits)
        while slot_key[at] != _FREE:
            at = (at + 1) & ((1 << bits) - 1)
        slot_key[at], slot_rank[at], slot_symbol[at] = key, rank, symbol
    id_of = np.full(size + len(symbols) + 1, -1, dtype=np.int32)
    id_of[list(normal.values())] = list(normal.values())
    decoded = np.empty(size, dtype=object)
    for i, t in enumerate(texts):
        if is_byte[i]:
            decoded[i] = bytes([byte_value[i]])
        elif model.is_control(i):
            decoded[i] = b""
        elif model.is_unknown(i):
            decoded[i] = " ⁇ ".encode()
        else:
            decoded[i] = t.replace(MARK, " ").encode()
    return Pieces(texts, byte_ids, symbol_of, id_of, slot_key, slot_rank, slot_symbol, single, 64 - bits, max(map(len, normal), default=1), decoded, byte_value)


def units(texts) -> tc.Units:
    """The independent units of each text; a unit is written without its first mark.

    A unit is a run of marks and what follows up to the next run; every text
    but the empty one starts with an added mark.
    """
    texts = pc.replace_substring(tc.plain(texts), pattern=MARK, replacement=" ")
    fast = tc.coded_lists(texts, " ")
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")))
    special = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    runs = re.compile(r" +[^ ]*")
    lists = [[u[1:] for u in runs.findall(" " + t)] if t else [] for t in texts.take(pa.array(special)).to_pylist()] if len(special) else []
    return tc.with_special(fast, special, lists)


def merge_words(words: pa.StringArray, table: Pieces, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word (a mark before it), flat, and how many each word has."""
    long = pc.greater(pc.utf8_length(words), LONG).to_numpy(zero_copy_only=False)
    if long.any():
        short_ids, short_counts = merge_words(words.filter(pa.array(~long)), table, block)
        parts = [_finished(*_merge_long(words.slice(int(i), 1), table), 1, table) for i in np.flatnonzero(long)]
        counts = np.empty(len(words), dtype=np.int64)
        counts[~long], counts[long] = short_counts, [len(p[0]) for p in parts]
        ids, starts = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        ids[tc.ranges(starts[~long], short_counts)] = short_ids
        for at, (part, _) in zip(starts[long].tolist(), parts, strict=True):
            ids[at : at + len(part)] = part
        return ids, counts
    flat, counts = [], []
    for first in range(0, len(words), block):
        ids, n = _merge_block(words.slice(first, block), table)
        flat.append(ids)
        counts.append(n)
    if not flat:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(flat), np.concatenate(counts)


def _least_around(values: np.ndarray, reach: int) -> np.ndarray:
    """The minimum of each value and ``reach`` others on either side, by doubling steps."""
    least, width = np.r_[np.full(reach, NONE, np.int32), values, np.full(reach, NONE, np.int32)], 1
    whole = 2 * reach + 1
    while 2 * width <= whole:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(values)], least[whole - width : whole - width + len(values)])


def _merge_long(word: pa.StringArray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one long word."""
    points, _ = tc.codepoints(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(""), word, MARK), pattern=" ", replacement=MARK))
    symbols, reach = table.symbol_of[points], table.longest
    rank, joined = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
    rank[:-1], joined[:-1] = table.lookup(symbols[:-1], symbols[1:])
    while True:
        hit = (rank != NONE) & (rank == _least_around(rank, reach))
        if not hit.any():
            return symbols, np.zeros(len(symbols), np.int64)
        # of a run of equal pairs every other one is merged, from its first on and up to the first that must wait
        place = np.arange(len(rank))
        begins = np.r_[True, rank[1:] != rank[:-1]]
        start = np.maximum.accumulate(np.where(begins, place, 0))
        waits = np.maximum.accumulate(np.where(hit, -1, place))  # the last one that waits
        take = hit & (waits < start) & ((place - start) & 1 == 0)
        touchy = rank != NONE
        touchy[touchy] = table.single[rank[touchy]]
        if (take & touchy).any():
            used = np.r_[False, take[:-1]]  # the right half of a merge
            at = np.flatnonzero(touchy & ~used & np.isin(rank, np.unique(rank[take & touchy])))
            at = at[np.argsort(rank[at], kind="stable")]
            good = take[at]
            mine = at[good]
            left = np.where(mine > 0, table.lookup(symbols[np.maximum(mine - 1, 0)], joined[mine])[0], NONE)
            twin = (mine > 1) & take[np.maximum(mine - 2, 0)]  # merged before it
            left = np.where(twin, np.minimum(left, table.lookup(joined[np.maximum(mine - 2, 0)], joined[mine])[0]), left)
            after = np.minimum(mine + 2, len(symbols) - 1)
            right = np.where(mine + 2 < len(symbols), table.lookup(joined[mine], symbols[after])[0], NONE)
            stirs = ~good
            stirs[good] = np.minimum(left, right) <= rank[mine]
            chain = np.cumsum(np.r_[True, (rank[at[1:]] != rank[at[:-1]]) | (at[1:] - at[:-1] > reach + 1)])
            before = np.cumsum(stirs) - stirs  # those that stir before each, in its chain
            first = np.r_[True, chain[1:] != chain[:-1]]
            before -= np.maximum.accumulate(np.where(first, before, 0))
            take[at[before > 0]] = False
        hits = np.flatnonzero(take)
        symbols[hits] = joined[hits]
        rank[hits] = NONE
        keep = np.ones(len(symbols), dtype=bool)
        keep[hits + 1] = False
        merged = (np.cumsum(keep) - 1)[hits]
        symbols, rank, joined = symbols[keep], rank[keep], joined[keep]
        touched = np.unique(np.r_[merged, merged[merged > 0] - 1])
        rank[touched[touched == len(symbols) - 1]] = NONE
        touched = touched[touched < len(symbols) - 1]
        rank[touched], joined[touched] = table.lookup(symbols[touched], symbols[touched + 1])
        rank[-1] = NONE


def _merge_block(words: pa.StringArray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    words = pc.binary_join_element_wise(pa.scalar(""), words, MARK)  # the mark, then the word
    points, at = tc.codepoints(pc.replace_substring(words, pattern=" ", replacement=MARK))
    n = len(words)
    symbols = table.symbol_of[points]
    word = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    rank, joined = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
    if len(symbols) > 1:
        rank[:-1], joined[:-1] = table.lookup(symbols[:-1], symbols[1:])
        rank[:-1][word[:-1] != word[1:]] = NONE
    done_symbols, done_words = [], []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        least = np.minimum.reduceat(rank, starts)
        if (least == NONE).any():
            over = np.repeat(least == NONE, sizes)
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            keep = ~over
            symbols, word, rank, joined = symbols[keep], word[keep], rank[keep], joined[keep]
            if not len(symbols):
                break
            sizes, least = sizes[least != NONE], least[least != NONE]
        hits = np.flatnonzero(rank == np.repeat(least, sizes))
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        new_run = first | np.r_[True, hits[1:] != hits[:-1] + 1]
        run_start = hits[new_run][np.cumsum(new_run) - 1]
        take = ((hits - run_start) & 1 == 0) & (first | ~table.single[rank[hits]])
        hits = hits[take]
        symbols[hits] = joined[hits]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hits + 1] = False
        rank[hits] = NONE
        place = np.cumsum(keep) - 1
        symbols, word = symbols[keep], word[keep]
        # a pair's row is its left symbol; the row right of a merge carries the pair that the merged symbol now leads
        rank, joined = rank[keep], joined[keep]
        merged = place[hits]
        touched = np.r_[merged, merged[merged > 0] - 1]
        touched = touched[touched < len(symbols) - 1]
        inside = word[touched] == word[touched + 1]
        rank[touched[~inside]] = NONE
        touched = touched[inside]
        rank[touched], joined[touched] = table.lookup(symbols[touched], symbols[touched + 1])
        rank[-1] = NONE
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return _finished(symbols[order], word[order], n, table)


def _finished(symbols: np.ndarray, word: np.ndarray, n: int, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the symbols of n words, and how many each has."""
    ids = np.where(symbols < _OUTSIDE, table.id_of[np.minimum(symbols, len(table.id_of) - 1)], -1)
    missing = np.flatnonzero(ids < 0)
    if len(missing):
        ids, word = _as_bytes(symbols, ids, word, missing, table)
    return ids.astype(np.int32), np.bincount(word, minlength=n).astype(np.int64)


def _as_bytes(symbols, ids, word, missing, table: Pieces):
    """Characters that are no piece, as the pieces of their UTF-8 bytes."""
    back = {}
    for s in np.unique(symbols[missing]):
        point = int(s) - _OUTSIDE if s >= _OUTSIDE else int(np.flatnonzero(table.symbol_of == s)[0])
        back[int(s)] = table.byte_ids[list(chr(point).encode())]
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[missing] = [len(back[int(s)]) for s in symbols[missing]]
    starts = np.cumsum(sizes) - sizes
    out = np.repeat(ids, sizes)
    out[tc.ranges(starts[missing], sizes[missing])] = np.concatenate([back[int(s)] for s in symbols[missing]])
    return out, np.repeat(word, sizes)


def encode(texts, path: str) -> list[np.ndarray]:
    """The ids of each text."""
    table, docs = load(path), units(texts)
    ids, counts = merge_words(docs.words, table)
    starts = np.cumsum(counts) - counts
    out = []
    for s, n in zip(docs.starts, docs.counts, strict=True):
        codes = docs.codes[s : s + n]
        out.append(ids[tc.ranges(starts[codes], counts[codes])])
    return out


def decode(ids, path: str) -> str:
    """The text of any ids, as the library's decode() gives it."""
    table = load(path)
    parts: list[str] = []
    raw = bytearray()
    begun = False
    for i in map(int, ids):
        if table.byte_value[i] >= 0:
            raw.append(table.byte_value[i])
            begun = True
            continue
        if raw:
            parts.append(_lenient(bytes(raw)))
            raw.clear()
        piece = table.decoded[i].decode()
        if not begun and piece:
            begun = True
            if table.texts[i].startswith(MARK):
                piece = piece[1:]
        parts.append(piece)
    parts.append(_lenient(bytes(raw)))
    return "".join(parts)


def _lenient(raw: bytes) -> str:
    """Bytes as text; each byte that starts no whole character becomes one replacement sign."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _digests(batches, path: str):
    table = load(path)
    for whole in batches:
        for batch in tc.pieces_of(whole, "text"):
            docs = units(batch.column("text"))
            ids, counts = merge_words(docs.words, table)
            ends = np.cumsum(counts)
            starts = ends - counts
            listed, shown = np.empty(len(counts), object), np.empty(len(counts), object)
            flat, said = ids.tolist(), table.decoded[ids]
            for u, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                listed[u] = ",".join(map(str, flat[a:b]))
                shown[u] = b"".join(said[a:b])
            lengths = docs.per_doc(counts)
            hashes, texts = [], []
            for s, n in zip(docs.starts.tolist(), docs.counts.tolist(), strict=True):
                codes = docs.codes[s : s + n]
                hashes.append(hashlib.sha256(",".join(listed[codes]).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join(shown[codes])[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(lambda b: _digests(b, model_path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""

    def run(batches):
        for whole in batches:
            for batch in tc.pieces_of(whole, "text"):
                found = encode(batch.column("text"), model_path)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
