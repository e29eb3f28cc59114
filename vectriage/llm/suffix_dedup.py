"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Method: a byte is removed when a string of ``width`` bytes that covers it also
starts earlier in the corpus.  Suffixes are dealt into buckets by the anchor of
their first ``width`` bytes (the lowest 32-byte fingerprint in them), so a
bucket holds all suffixes that can be equal, and places in it are counted from
the anchor.  ``repeats`` settles buckets with a single context and collapses
equal contexts; the remaining suffixes are sorted block by block:

* the cover sample: places that are 0, 1, 3, 8, 12 or 18 modulo 31, of which
  any two residues have a common shift; each gets the rank of its next
  ``width - 32`` bytes, once for the block;
* each suffix bucket is sorted by its first 32 bytes; a longer tie is resolved
  by the rank of the next sample place, which lies at the same shift for all
  suffixes of the bucket, and by the last 32 bytes.

So no comparison reads beyond the head and tail of a window, and a block of
suffixes is held at a time.  Equal suffixes are neighbours; all but the
earliest are repeats.

Edge cases: null and empty texts keep their (no) bytes; texts shorter than
``width`` lose nothing; a row with a null id takes no part and keeps all; a
repeated row is the same document and gets the same result; other columns are
not read; an empty table gives an empty result.  Cuts are made at bytes, so
what is left can start inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectriage.llm.common import BYTE_CODE, Roller, U64, keyed_texts, mix, text_bytes
from vectriage.llm.repeats import Runs, Units, covered, later_equal, window_table

SEED = 32
PERIOD = 31
# A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def byte_runs(raw: np.ndarray, offsets: np.ndarray, width: int) -> Runs:
    b = raw[int(offsets[0]):int(offsets[-1])]
    rel = (offsets - offsets[0]).astype(np.int64)
    size = np.diff(rel)
    empty = np.zeros(0, np.int64)
    if not len(size) or size.max() < width:
        return Runs(empty, empty, empty, empty.astype(U64), empty.astype(U64), empty)
    roll = Roller(BYTE_CODE[b])
    at = np.arange(len(b) - SEED + 1)
    seed = mix(roll.of(at, at + SEED))
    low = U64((1 << max(24, len(b).bit_length())) - 1)
    lowest = sliding_min((seed & ~low) | at.astype(U64), width - SEED + 1)
    usable = np.zeros(len(b) + 1, np.int32)
    fits = size >= width
    usable[rel[:-1][fits]] += 1
    usable[rel[1:][fits] - width + 1] -= 1
    window = np.flatnonzero(np.cumsum(usable[:-1]))
    anchor = (lowest[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    start, place = window[first], anchor[first]
    context = mix(roll.of(start, start + count + width - 1) ^ mix((place - start).astype(U64) + (count.astype(U64) << U64(20))))
    row = np.searchsorted(rel, start, "right") - 1
    return Runs(row, start - rel[row], count, seed[place], context, place - start)


def byte_pieces(raw: np.ndarray, offsets: np.ndarray, spans: list) -> list[bytes]:
    whole = raw[int(offsets[0]):int(offsets[1])].tobytes()
    return [whole[a:b] for a, b in spans]


def byte_units(width: int) -> Units:
    return Units(width, lambda raw, offsets: byte_runs(raw, offsets, width), byte_pieces, 1)


def _words_at(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts like the bytes."""
    shifted = [data[k:len(data) - 7 + k].astype(U64) << U64(56 - 8 * k) for k in range(8)]
    return sum(shifted[1:], shifted[0])[place]


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each entry by the keys, equal entries with equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sort_block(table: pa.Table, width: int) -> pa.Table:
    """Repeats among the suffixes of one block of buckets."""
    data = np.frombuffer(b"".join([p.as_py() for p in table.column("piece")]) + b"\0" * 8, np.uint8)
    anchor, offset, doc, start, count = (table.column(c).to_numpy() for c in ("anchor", "offset", "doc", "start", "count"))
    size = count + width - 1
    base = np.cumsum(size) - size
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(base, count) + step                       # of each suffix in the block
    shift = step - np.repeat(offset, count)                     # place counted from the anchor
    word = {}

    def at(p):
        if "w" not in word:
            word["w"] = _words_at(data, np.arange(len(data) - 7))
        return word["w"][p]

    middle = width - SEED
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    sample, of_suffix = np.unique(place + to_cover[shift % PERIOD], return_inverse=True)
    head = middle // 8
    keys = [at(sample + 8 * k) for k in range(head)]
    if middle % 8:
        keys.append(at(sample + middle - 8))
    cover_rank = _dense(keys)[of_suffix]
    group = _dense([np.repeat(anchor, count), shift, *(at(place + 8 * k) for k in range(SEED // 8)), cover_rank,
                    *(at(place + width - SEED + 8 * k) for k in range(SEED // 8))])
    suffix_doc, suffix_start = np.repeat(doc, count), np.repeat(start, count) + step
    late = later_equal(suffix_doc, suffix_start, group)
    return window_table(suffix_doc[late], suffix_start[late], width)


def repeated_spans(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): the byte spans to remove of every row."""
    if width < 2 * SEED + 1:
        raise ValueError(f"width must be over {2 * SEED}")
    return covered(keyed_texts(docs, id_col, text_col), byte_units(width), lambda t: sort_block(t, width))


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row."""
    return _cut(repeated_spans(docs, width, id_col, text_col), digest=False)


def repeats_digest(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``remove_repeats`` with kept_sha256 in place of the bytes."""
    return _cut(repeated_spans(docs, width, id_col, text_col), digest=True)


def _cut(found: DataFrame, digest: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            cols = ([], [], [], [])
            for r, packed_spans in enumerate(batch.column("spans")):
                whole = raw[int(offsets[r]):int(offsets[r + 1])].tobytes()
                spans = np.frombuffer(packed_spans.as_py() or b"", np.int32).reshape(-1, 2).tolist()
                edge = [0, *(x for s in spans for x in s), len(whole)]
                left = b"".join(whole[a:b] for a, b in zip(edge[::2], edge[1::2]))
                for col, v in zip(cols, (len(whole), len(whole) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digest else left)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = found.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
