"""Removal of repeated word windows by recompression.

Method: a word is removed when a window of ``width`` words that covers it also
starts earlier in the corpus.  Each text is recompressed in rounds.  Round 0
names every maximal run of one word; each later round splits all symbols into
left and right ones by a bit of their names and replaces every pair (left,
right) by one symbol, named by its parts.  Names are 64-bit fingerprints of
what they stand for, so they are global without an exchange, and a symbol's
borders depend on few symbols around them: after three rounds, on four runs to
either side.  Equal windows therefore have the same symbol borders inside.

Of the borders that a window fixes by itself, the one with the lowest name is
its anchor.  Windows with equal anchors meet in one bucket (``repeats``);
stretches with equal anchor and content are the shared high-level symbols that
reveal long repeats and are settled as a whole.  What stays open is verified
from the bottom up: inside a block of buckets, pairs of names get exact dense
names, pairs of those again, until the name of a window stands for all its
words; equal names are equal windows.

Edge cases: null texts and texts without words have no words; texts shorter
than a window lose nothing; a row with a null id takes no part and keeps all;
a repeated row is the same document and gets the same result; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectriage.llm.common import Roller, U64, keyed_texts, mix, text_bytes, word_bounds, word_hashes
from vectriage.llm.repeats import Runs, Units, covered, later_equal, window_table

ROUNDS = 3
REACH = 1 << (ROUNDS - 1)
LEFT, RIGHT = U64(0xD1B54A32D192ED03), U64(0xABC98388FB8FAC03)


def symbol_borders(names: np.ndarray, new_row: np.ndarray) -> np.ndarray:
    """Places, among the runs ``names``, where a symbol starts after all rounds; ``new_row``: runs that start a text."""
    at = np.arange(len(names))
    for r in range(ROUNDS):
        bit = (mix(names + U64(r + 1)) & U64(1)).astype(bool)
        joined = np.zeros(len(at) + 1, bool)          # symbol k is the right part of a pair
        joined[1:-1] = ~bit[:-1] & bit[1:] & ~new_row[1:]
        starts = ~joined[:-1]
        paired = joined[1:]
        after = np.append(names[1:], U64(0))
        names = np.where(paired, mix(names * LEFT + after * RIGHT), names)[starts]
        at, new_row = at[starts], new_row[starts]
    return at


def word_runs(raw: np.ndarray, offsets: np.ndarray, width: int) -> Runs:
    words, first = word_hashes(raw, offsets)
    empty = np.zeros(0, np.int64)
    size = np.diff(first)
    if not len(size) or size.max() < width:
        return Runs(empty, empty, empty, empty.astype(U64), empty.astype(U64), empty)
    row_start = np.zeros(len(words), bool)
    row_start[first[:-1][size > 0]] = True
    new = row_start.copy()
    new[1:] |= words[1:] != words[:-1]
    run_at = np.flatnonzero(new)
    run_name, run_row = words[run_at], np.searchsorted(first, run_at, "right") - 1
    border = symbol_borders(run_name, row_start[run_at])
    border = border[(border >= REACH) & (border + REACH <= len(run_at))]
    border = border[(run_row[border - REACH] == run_row[border]) & (run_row[border + REACH - 1] == run_row[border])]
    # A border is fixed by windows that hold a word of each of the REACH runs to either side.
    left = run_at[border - REACH + 1] - 1
    right = run_at[border + REACH - 1] + 1
    code = np.zeros(len(border), U64)
    for k in range(-REACH, REACH):
        code = mix(code * LEFT + run_name[border + k])
    low = U64((1 << max(24, len(words).bit_length())) - 1)
    key = (code & ~low) | np.arange(len(border)).astype(U64)
    none = U64((1 << 64) - 1)
    best = np.full(len(words) + 1, none)
    lo = np.maximum(right - width, first[run_row[border]])
    for t in range(width - 2 * REACH + 3):
        use = lo + t <= left
        np.minimum.at(best, (lo + t)[use], key[use])
    usable = np.zeros(len(words) + 1, np.int32)
    fits = size >= width
    np.add.at(usable, first[:-1][fits], 1)
    np.add.at(usable, first[1:][fits] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(usable[:-1]))
    roll = Roller(words)
    whole = mix(roll.of(window, window + width))
    lone = best[window] == none                       # no border is fixed: the window is its own anchor
    chosen = np.where(lone, -1 - window, (best[window] & low).astype(np.int64))
    brk = np.ones(len(window), bool)
    brk[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(brk)
    count = np.diff(np.append(at, len(window)))
    start, pick, lone = window[at], chosen[at], lone[at]
    safe = np.where(lone, 0, pick)
    place = np.where(lone, start, run_at[border][safe] if len(border) else start)
    anchor = np.where(lone, whole[at], mix(code[safe] + U64(1)) if len(border) else whole[at])
    context = mix(roll.of(start, start + count + width - 1) ^ mix((place - start).astype(U64) + (count.astype(U64) << U64(20))))
    row = np.searchsorted(first, start, "right") - 1
    return Runs(row, start - first[row], count, anchor, context, place - start)


def word_pieces(raw: np.ndarray, offsets: np.ndarray, spans: list) -> list[bytes]:
    words, _ = word_hashes(raw, offsets)
    return [words[a:b].tobytes() for a, b in spans]


def word_units(width: int) -> Units:
    return Units(width, lambda raw, offsets: word_runs(raw, offsets, width), word_pieces, 8)


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense names of pairs of dense names."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def name_block(table: pa.Table, width: int) -> pa.Table:
    """Repeats among the windows of one block of buckets."""
    words = np.frombuffer(b"".join([p.as_py() for p in table.column("piece")]), U64)
    anchor, offset, doc, start, count = (table.column(c).to_numpy() for c in ("anchor", "offset", "doc", "start", "count"))
    size = count + width - 1
    base = np.cumsum(size) - size
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(base, count) + step
    name = np.unique(words, return_inverse=True)[1]   # level 0; level k stands for 2^k words from a place on
    length = 1
    while length * 2 <= width:
        after = np.append(name[length:], np.zeros(min(length, len(name)), name.dtype))[:len(name)]
        name = _pair_names(name, after)
        length *= 2
    window = _pair_names(name[place], name[place + width - length])
    window_doc, window_start = np.repeat(doc, count), np.repeat(start, count) + step
    late = later_equal(window_doc, window_start, window)
    return window_table(window_doc[late], window_start[late], width)


def repeated_spans(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the word spans to remove of every row."""
    if width < 2 * REACH:
        raise ValueError(f"width must be at least {2 * REACH}")
    return covered(keyed_texts(docs, id_col, text_col), word_units(width), lambda t: name_block(t, width))


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept string: the words left, joined by a space) of every row."""
    return _cut(repeated_spans(docs, width, id_col, text_col), digest=False)


def repeats_digest(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``remove_repeats`` with kept_sha256 in place of the text."""
    return _cut(repeated_spans(docs, width, id_col, text_col), digest=True)


def _cut(found: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            n_words, n_removed, kept = [], [], []
            for r, packed_spans in enumerate(batch.column("spans")):
                own = offsets[r:r + 2]
                starts, ends, _ = word_bounds(raw, own)
                left = np.ones(len(starts), bool)
                for a, b in np.frombuffer(packed_spans.as_py() or b"", np.int32).reshape(-1, 2):
                    left[a:b] = False
                words = raw[int(own[0]):int(own[1])].tobytes().split() if left.any() else []
                whole = b" ".join([w for w, k in zip(words, left.tolist()) if k])
                n_words.append(len(starts))
                n_removed.append(len(starts) - int(left.sum()))
                kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
