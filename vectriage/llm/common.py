"""Shared pieces: words of Arrow text columns as numpy arrays, checkpoints, components.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Text is
handled as UTF-8 bytes, a bounded number of rows at a time (``row_ranges``);
a single text longer than the bound is one range of its own.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vectriage.session import ensure_checkpoint_dir

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, r, r^2, ... (or of the inverse of r) modulo 2^64."""
    out = np.full(max(n, 1), U64(_RADIX_INV if inverse else _RADIX))
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Fingerprints of substrings of one byte array, by a polynomial over random byte codes."""

    _cache: dict[str, np.ndarray] = {}

    def __init__(self, codes: np.ndarray, kept: np.ndarray | None = None):
        n = len(codes)
        have = Roller._cache.get("p")
        if have is None or len(have) < n + 1:
            size = max(n + 1, (1 << 20) + 1)     # one range of ``row_ranges``
            Roller._cache["p"], Roller._cache["q"] = powers(size), powers(size, inverse=True)
        p, q = Roller._cache["p"], Roller._cache["q"]
        if kept is None:
            self.shift = q
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(codes * p[:n], out=self.sums[1:])
        else:                      # bytes that are not kept count neither in value nor in place
            place = np.zeros(n + 1, np.int64)
            np.cumsum(kept, out=place[1:])
            self.shift = q[place]
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(np.where(kept, codes * p[place[:-1]], U64(0)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.shift[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, (offsets if len(column) else np.zeros(1, np.int64))


def row_ranges(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most ``limit`` bytes, or one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row + total) for rows ``offsets`` of ``raw``; places count from offsets[0]."""
    base = int(offsets[0])
    rel = offsets - base
    b = raw[base:int(offsets[-1])]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rel), np.int64)
    word = ~SPACE[b]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = rel[1:] > rel[:-1]
    at = rel[:-1][full]
    first[at] = word[at]
    at = rel[1:][full] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, rel)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprint of each word, first word of each row + total)."""
    starts, ends, first = word_bounds(raw, offsets)
    b = raw[int(offsets[0]):int(offsets[-1])]
    roll = Roller(BYTE_CODE[LOWER[b] if lower else b])
    return mix(roll.of(starts, ends)), first


def release() -> None:
    """Hand freed memory back to the system: allocators keep it, and a Python worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc only
    if trim is not None:
        trim(0)


def freeing(run):
    """``run`` for mapInArrow, releasing its memory when a task ends."""
    def outer(batches):
        yield from run(batches)
        release()

    return outer


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def keep(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that the session names: cuts lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def if_few(keys: DataFrame, most: int = 4_000_000) -> DataFrame:
    """Keys of 8 bytes, checkpointed; broadcast while they are at most ``most``, so that the other side stays where it is."""
    keys = keep(keys)
    return F.broadcast(keys) if keys.count() <= most else keys


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def places(texts: DataFrame) -> DataFrame | None:
    """(place, doc_id, mark) when an id of ``texts(doc_id, text)`` stands for several texts, else None.

    Every (id, text) then has a place of its own, numbered in the order of the ids; ``mark`` is the text's fingerprint
    (null is the empty text).  Rows without an id have none."""
    marked = texts.where("doc_id is not null").select("doc_id", text_mark().alias("mark"))
    if marked.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a <> b").isEmpty():
        return None
    ordered = marked.distinct().orderBy("doc_id", "mark").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    return keep(texts.sparkSession.createDataFrame(ordered, "place long, doc_id long, mark long"))


def text_mark(text_col: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def placed(rows: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "_place") -> DataFrame:
    """``rows`` with the place of their (id, text); null without an id."""
    at = named.select(F.col("place").alias(name), F.col("doc_id").alias("_named_id"), F.col("mark").alias("_named_mark"))
    return rows.join(at, (rows[id_col].cast("long") == at["_named_id"]) & (text_mark(text_col) == at["_named_mark"]), "left").drop("_named_id", "_named_mark")


def hash_share(column: str, share: float):
    """True for about ``share`` of the values, by their hash; shares below a millionth go by a second one."""
    whole = min(1.0, share) * 1_000_000
    first, second = F.pmod(F.xxhash64(column), F.lit(1_000_000)), F.pmod(F.xxhash64(F.lit("share"), column), F.lit(1 << 31))
    return (first < int(whole)) | ((first == int(whole)) & (second < int((whole - int(whole)) * (1 << 31))))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), the component being its smallest node.

    Alternating large-star and small-star steps; both need a minimum per node
    and a join, never a node's list of neighbours, so a hub is only a skewed
    join.  Each round is checkpointed; the rounds grow with the logarithm of
    the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = keep(e)
    before = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                      F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = keep(e.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if before is not None and now[0] == before[0] and now[1] == before[1]:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {limit} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
