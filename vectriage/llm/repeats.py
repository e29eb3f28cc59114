"""Finding repeated windows of a corpus, shared by the byte and the word operator.

A window is ``width`` consecutive units (bytes, words) of one document.  Every
window belongs to an anchor, a place inside it that its content alone decides,
so equal windows have equal anchors at equal offsets.  Neighbouring windows
with the same anchor make a run; a run is named by fingerprints of its anchor
and of all its units (its context).

1. ``find_runs``: runs are dealt out by anchor, as packed arrays.  Of runs with
   the same context all but the first are repeats entirely.  Anchors that have
   one context only are settled.  For the others the first run of each context
   stays open.  A task sends one run of each context it sees, and spreads the
   contexts of an anchor of which it sees several, so a frequent context or
   anchor fills no bucket.
2. ``open_windows``: the units of open runs, dealt out by anchor (windows of
   anchors with very many open runs one by one, by content), for the operator's
   own exact ordering of windows.
3. ``covered``: the spans of both, merged for each document.

Documents are ordered by id, windows by place.  Rows with a null id take no
part; a repeated row is the same document again; an id of several texts is as
many documents, in the order of their texts' fingerprints.
"""

from __future__ import annotations

import zlib
from typing import Callable, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import U64, ids_of, keep, mix, packed, placed, places, row_ranges, text_bytes

HOT_RUNS = 5_000


class Runs(NamedTuple):
    """One run an entry: row, first window, windows, anchor and context names, place of the anchor behind the first window."""
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    offset: np.ndarray


class Units(NamedTuple):
    """What an operator defines of its units."""
    width: int
    runs: Callable[[np.ndarray, np.ndarray], Runs]
    #: (raw, offsets of one row, start, end) -> bytes of those units
    piece: Callable
    #: bytes a unit takes in a piece
    unit_bytes: int


FIELDS = (("anchor", np.uint64), ("context", np.uint64), ("doc", np.int64), ("start", np.int32), ("count", np.int32), ("offset", np.int32))


def _pack(bucket: int, kind: int, cols: dict) -> tuple:
    return (bucket, kind, *(packed(cols[f].astype(t)) for f, t in FIELDS))


def _unpack(table: pa.Table, use: np.ndarray) -> dict:
    rows = np.flatnonzero(use)
    return {f: np.concatenate([np.frombuffer(table.column(f)[int(i)].as_py(), t) for i in rows] or [np.zeros(0, t)]) for f, t in FIELDS}


def _firsts(c: dict) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, context, document, start; marks of the first of each context in that order)."""
    order = np.lexsort((c["start"], c["doc"], c["context"], c["anchor"]))
    a, x = c["anchor"][order], c["context"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
    return order, new


def _spans(c: dict, width: int) -> dict:
    return {"doc": c["doc"], "start": c["start"], "end": c["start"] + c["count"] + width - 1}


def find_runs(docs: DataFrame, units: Units, buckets: int, chunk_runs: int = 250_000) -> DataFrame:
    """(doc, start, end, anchor, offset): repeats (anchor null), and open runs, of ``docs(doc_id, text)``."""
    names = ["bucket", "kind", *(f for f, _ in FIELDS)]

    def send(parts: list[dict]) -> pa.RecordBatch:
        c = {f: np.concatenate([p[f] for p in parts]) for f, _ in FIELDS}
        order, new = _firsts(c)
        c = {f: v[order] for f, v in c.items()}
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        again = ~new & ((c["doc"] != c["doc"][first][group]) | (c["start"] != c["start"][first][group]))
        rows = []
        if again.any():                       # settled here; kind 2 passes through
            rows.append(_pack(int(c["doc"][again][0]) % buckets, 2, {f: v[again] for f, v in c.items()}))
        c = {f: v[first] for f, v in c.items()}
        lone = np.ones(len(first), bool)
        lone[1:] &= c["anchor"][1:] != c["anchor"][:-1]
        head = lone.copy()
        lone[:-1] &= c["anchor"][1:] != c["anchor"][:-1]
        goes = (mix(np.where(lone, c["anchor"], c["anchor"] ^ mix(c["context"]))) % U64(buckets)).astype(np.int64)
        mark = head & ~lone                   # kind 3 tells an anchor's bucket that it has several contexts
        home = (mix(c["anchor"][mark]) % U64(buckets)).astype(np.int64)
        for kind, use, to in ((0, lone, goes[lone]), (1, ~lone, goes[~lone]), (3, mark, home)):
            part = {f: v[use] for f, v in c.items()}
            by = np.lexsort((part["start"], part["doc"], to))
            part, to = {f: v[by] for f, v in part.items()}, to[by]
            cut = np.searchsorted(to, np.arange(buckets + 1))
            rows += [_pack(b, kind, {f: v[cut[b]:cut[b + 1]] for f, v in part.items()}) for b in np.unique(to).tolist()]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * len(FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches):
        parts, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                raw, offsets = text_bytes(batch.column("text"))
                ids = ids_of(batch)
                for a, b in row_ranges(offsets):
                    r = units.runs(raw, offsets[a:b + 1])
                    parts.append({"anchor": r.anchor, "context": r.context, "doc": ids[a:b][r.row], "start": r.start,
                                  "count": r.count, "offset": r.offset})
                    size += len(r.row)
                    if size >= chunk_runs:
                        yield send(parts)
                        parts, size = [], 0
            if size:
                yield send(parts)

    def settle(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        width = units.width
        c = _unpack(table, kind < 2)
        opened = np.repeat(kind[kind < 2] == 1, [len(table.column("start")[int(i)].as_py()) // 4 for i in np.flatnonzero(kind < 2)])
        order, new = _firsts(c)
        c, opened = {f: v[order] for f, v in c.items()}, opened[order]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        again = ~new & ((c["doc"] != c["doc"][first][group]) | (c["start"] != c["start"][first][group]))
        repeats = [_spans({f: v[again] for f, v in c.items()}, width), _spans(_unpack(table, kind == 2), width)]
        several = np.unique(_unpack(table, kind == 3)["anchor"])
        own = {f: v[first] for f, v in c.items()}
        still = np.zeros(len(first), bool)
        np.logical_or.at(still, group, opened)
        same = own["anchor"][1:] == own["anchor"][:-1]
        still[1:] |= same
        still[:-1] |= same
        still |= np.isin(own["anchor"], several)
        own = {f: v[still] for f, v in own.items()}
        spans = [*repeats, _spans(own, width)]
        lost = len(repeats[0]["doc"]) + len(repeats[1]["doc"])
        n = lost + len(own["doc"])
        settled = np.arange(n) < lost
        col = lambda f, t: pa.array(np.concatenate([s[f] for s in spans]).astype(t))
        pad = np.zeros(lost, np.int64)
        return pa.table({"doc": col("doc", np.int64), "start": col("start", np.int32), "end": col("end", np.int32),
                         "anchor": pa.array(np.concatenate([pad, own["anchor"].view(np.int64)]), mask=settled),
                         "offset": pa.array(np.concatenate([pad, own["offset"]]).astype(np.int32), mask=settled)})

    binary = ", ".join(f"{f} binary" for f, _ in FIELDS)
    return (docs.mapInArrow(run, f"bucket long, kind int, {binary}").groupBy("bucket")
            .applyInArrow(settle, "doc long, start int, end int, anchor long, offset int"))


def merged_spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of spans, as rows (start, end) in order; spans that touch become one."""
    if not len(start):
        return np.zeros((0, 2), np.int32)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([start[at], reach[np.append(at[1:], len(start)) - 1]]).astype(np.int32)


def by_document(found: DataFrame) -> DataFrame:
    """(doc_id, spans, open): a row for each document with repeats or open runs, spans merged and packed."""
    lists = found.groupBy("doc").agg(
        F.collect_list(F.when(F.col("anchor").isNull(), F.struct("start", "end"))).alias("spans"),
        F.collect_list(F.when(F.col("anchor").isNotNull(), F.struct("start", "end", "anchor", "offset"))).alias("open"))

    def run(batches):
        for batch in batches:
            lists, out = batch.column("spans"), []
            flat, at = lists.values, lists.offsets.to_numpy()
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            for a, b in zip(at[:-1], at[1:]):
                out.append(packed(merged_spans(start[a:b], end[a:b])))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary()), batch.column("open")],
                                             schema=pa.schema([("doc_id", pa.int64()), ("spans", pa.binary()), ("open", batch.column("open").type)]))

    return lists.mapInArrow(run, "doc_id long, spans binary, open array<struct<start:int,end:int,anchor:long,offset:int>>")


def open_windows(docs: DataFrame, settled: DataFrame, units: Units, hot_runs: int = HOT_RUNS, bucket_runs: int = 10_000) -> DataFrame:
    """(bucket, anchor, offset, doc, start, count, piece) of the open runs, with the units of their windows."""
    opened = settled.where(F.size("open") > 0)
    total = opened.agg(F.sum(F.size("open"))).first()[0] or 0
    buckets = 1 + total // bucket_runs
    runs = opened.select("doc_id", F.explode("open").alias("o")).select("doc_id", "o.*")
    hot = runs.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_runs).select("anchor", F.lit(True).alias("hot"))
    listed = (runs.join(hot, "anchor", "left").groupBy("doc_id")
              .agg(F.collect_list(F.struct("start", "end", "anchor", "offset", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("open")))
    width, size = units.width, units.unit_bytes

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            ids, cols = ids_of(batch), {k: [] for k in ("anchor", "offset", "doc", "start", "count", "piece", "bucket")}
            for r, runs_of_row in enumerate(batch.column("open").to_pylist()):
                pieces = units.piece(raw, offsets[r:r + 2], [(o["start"], o["end"]) for o in runs_of_row])
                for o, piece in zip(runs_of_row, pieces):
                    windows = o["end"] - o["start"] - width + 1
                    for first, count in ((t, 1) for t in range(windows)) if o["hot"] else ((0, windows),):
                        part = piece[first * size:(first + count + width - 1) * size]
                        cols["anchor"].append(o["anchor"])
                        cols["offset"].append(o["offset"] - first)
                        cols["doc"].append(int(ids[r]))
                        cols["start"].append(o["start"] + first)
                        cols["count"].append(count)
                        cols["piece"].append(part)
                        cols["bucket"].append((zlib.crc32(part) if o["hot"] else o["anchor"]) % buckets)
            types = {"anchor": pa.int64(), "offset": pa.int32(), "doc": pa.int64(), "start": pa.int32(), "count": pa.int32(),
                     "piece": pa.binary(), "bucket": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in types.items()], names=list(types))

    return docs.join(listed, "doc_id").mapInArrow(
        run, "anchor long, offset int, doc long, start int, count int, piece binary, bucket long")


def later_equal(doc: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Marks of windows whose group of equal windows has an earlier one."""
    order = np.lexsort((start, doc, group))
    g, d, s = group[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (d != d[first]) | (s != s[first])
    return out


def window_table(doc: np.ndarray, start: np.ndarray, width: int) -> pa.Table:
    """Windows as spans, neighbours of a document merged."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return pa.table({"doc": pa.array(doc[at], pa.int64()), "start": pa.array(start[at], pa.int32()),
                     "end": pa.array((start[last] + width).astype(np.int32), pa.int32())})


def covered(docs: DataFrame, units: Units, equal_windows: Callable[[pa.Table], pa.Table], bucket_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, text, spans) of every row of ``docs(doc_id, text)``: the units to remove, packed (start, end) pairs, null for none."""
    named = places(docs)
    if named is None:
        return _covered(docs, units, equal_windows, bucket_bytes)
    # An id of several texts: every text is a document of its own, in the order of the ids.
    found = _covered(placed(docs, named, name="place").select(F.col("place").alias("doc_id"), "text"), units, equal_windows, bucket_bytes)
    back = named.select(F.col("place").alias("doc_id"), F.col("doc_id").alias("_doc_id"))
    return found.join(back, "doc_id", "left").select(F.col("_doc_id").alias("doc_id"), "text", "spans")


def _covered(docs: DataFrame, units: Units, equal_windows: Callable[[pa.Table], pa.Table], bucket_bytes: int) -> DataFrame:
    known = docs.where("doc_id is not null")
    size = known.select(F.sum(F.octet_length("text"))).first()[0] or 0
    settled = keep(by_document(find_runs(known, units, 1 + size // bucket_bytes)))
    fine = (open_windows(known, settled, units).groupBy("bucket")
            .applyInArrow(equal_windows, "doc long, start int, end int"))
    fine = fine.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    spans = settled.select("doc_id", "spans").join(fine, "doc_id", "full")

    def run(batches):
        for batch in batches:
            out = []
            for first, more in zip(batch.column("spans"), batch.column("more").to_pylist()):
                have = np.frombuffer(first.as_py() or b"", np.int32).reshape(-1, 2)
                new = np.array([(m["start"], m["end"]) for m in more or []], np.int32).reshape(-1, 2)
                both = np.concatenate([have, new])
                out.append(packed(merged_spans(both[:, 0], both[:, 1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "spans"])

    merged = spans.mapInArrow(run, "doc_id long, spans binary").where(F.octet_length("spans") > 0)
    return docs.join(merged, "doc_id", "left")
