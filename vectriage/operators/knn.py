"""Exact k-nearest-neighbour search between two DataFrames.

``knn(base, queries, k, metric)`` returns one row per (query, neighbour)
with ``rank`` 1..k, ordered by distance and then by neighbour id.

Plan shape
----------
* Only ``(id, vector)`` of each side enters the search; payload columns
  are joined back by the callers after top-k (column pruning reaches the
  Parquet scan).
* ``broadcast`` strategy: when the query matrix and the running top-k of its
  rows are at most ``broadcast_bytes`` (a collect capped at that many rows;
  one row more means "too large"), it is shipped once to every task and the base is scanned in
  place with ``mapInArrow``: no shuffle of the base at all.  Each task
  keeps a running top-k per query, so a task emits at most
  ``k * n_queries`` rows (plus exact ties).  Large bases are coalesced
  to about one task per GiB (never below twice the parallelism), so the
  candidate volume follows the cluster size, not the split count.
* ``block`` strategy: above that size base rows and queries are dealt by hash
  into a grid about as wide as high: a task holds its part of the base, in
  blocks of ``block_bytes``, and streams its part of the queries past them, a
  bounded number at a time.  Rows travel as often as the grid is wide, not as
  often as there are blocks.
* In both cases the per-task candidates are merged with
  ``row_number() <= k`` over ``query_id``, which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle and a final one after it.

Distances
---------
``cosine``: 1 - a.b / (|a| |b|); ``euclidean``: |a - b|; ``dot``: -a.b
(ascending is nearest first).  Ordering uses the distance rounded to nine
decimals, then the id, so engines that sum in a different order agree on
ranks.  Euclidean distances from the matrix identity are re-computed
directly for the candidates near the k-th boundary, so cancellation never
changes the result.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.operators.partitioning import fit_scan_tasks

METRICS = ("cosine", "euclidean", "dot")
RANK_DECIMALS = 9
DEFAULT_BROADCAST_BYTES = 64 << 20
DEFAULT_BLOCK_BYTES = 128 << 20
# Upper bound on one distance tile (queries x base rows) inside a task.
TILE_BYTES = 32 << 20
# Running state of one query per neighbour: id, distance and key, kept, buffered and merged.
STATE_BYTES = 96
# Queries that a task of a dealt search compares at a time.
QUERY_ROWS = 4096


def release() -> None:
    """Hand freed memory back to the system: allocators keep it, and a Python worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc only
    if trim is not None:
        trim(0)


def _vec_matrix(arr: pa.Array, dim: int) -> np.ndarray:
    """list<float|double> Arrow column (no nulls, fixed width) -> float64 matrix; another width raises."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if (np.diff(arr.offsets.to_numpy()) != dim).any():
        raise ValueError(f"vectors that are not {dim} wide among the queries; pass dim to leave them out")
    values = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(arr), dim)


def _prepare(mat: np.ndarray, metric: str):
    """Per-row data the kernel needs: normalised rows for cosine, norms for euclidean."""
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = mat / norms[:, None]
        return unit, norms
    if metric == "euclidean":
        return mat, np.einsum("ij,ij->i", mat, mat)
    return mat, None


def _dkey(d: np.ndarray) -> np.ndarray:
    # + 0.0 turns -0.0 into 0.0 so it sorts equal to 0.0 everywhere.
    return np.round(d, RANK_DECIMALS) + 0.0


def _select(qrow, ids, dist, dkey, k):
    """Keep, per query row, the k smallest (dkey, id) candidates."""
    if len(qrow) == 0:
        return qrow, ids, dist, dkey
    order = np.lexsort((ids, dkey, qrow))
    qrow, ids, dist, dkey = qrow[order], ids[order], dist[order], dkey[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qrow)) + 1]
    lengths = np.diff(np.r_[starts, len(qrow)])
    pos = np.arange(len(qrow)) - np.repeat(starts, lengths)
    keep = pos < k
    return qrow[keep], ids[keep], dist[keep], dkey[keep]


def _without_spare_copies(ids, mat, k):
    """The rows without those that equal k others of smaller ids: such a row is among the k nearest of no query."""
    if len(ids) <= k:
        return ids, mat
    mat = np.ascontiguousarray(mat)
    same = np.unique(mat.view(np.dtype((np.void, mat.itemsize * mat.shape[1]))).ravel(), return_inverse=True)[1]
    if np.bincount(same).max() <= k:
        return ids, mat
    keep = np.sort(_select(same, ids, np.arange(len(ids)), np.zeros(len(ids)), k)[2])
    return ids[keep], mat[keep]


class _Kernel:
    """Top-k of one query matrix against streamed base batches.

    Distances are screened with a float32 matrix product (twice the
    speed of float64 and half the memory) and every candidate that could
    be in the top-k under a proven error bound is recomputed exactly in
    float64, so the result is the exact float64 top-k.  For n-wide vectors
    the float32 dot product is off by at most ``(n + 2) * 2**-24 * |q| |b|``
    (conversion included); with A the screened k-th value and e that bound,
    every true top-k row screens at or below ``A + 2e``.

    Per query it keeps the best k (distance key, id) pairs seen so far and
    their k-th distance B as a bound: later batches only pass candidates
    screened at or below ``min(A + 2e, B + e)`` (+1e-9 for ties after
    rounding), so after the first batches little but true improvements is
    kept.  Candidates are buffered and merged (one lexsort) when the buffer
    grows past a few times ``k * nq``.
    """

    def __init__(self, Q: np.ndarray, metric: str, k: int, id_dtype=object):
        self.metric, self.k = metric, k
        self.Q = Q
        self.Qp, self.Qaux = _prepare(Q, metric)
        nq, dim = Q.shape
        self.valid_q = np.isfinite(self.Qp).all(axis=1) if metric == "cosine" else np.ones(nq, bool)
        self.Q32 = np.where(self.valid_q[:, None], self.Qp, 0.0).astype(np.float32)
        self.qnorm = np.sqrt(np.einsum("ij,ij->i", Q, Q)) if metric != "cosine" else np.ones(nq)
        self.unit_err = 2.0 * (dim + 2) * 2.0 ** -24
        self.bound = np.full(nq, np.inf)
        self.acc = (np.empty(0, np.int64), np.empty(0, id_dtype), np.empty(0), np.empty(0))
        self.parts, self.n_buf = [], 0
        self.max_buf = max(2 * k * nq, 1 << 16)

    def _screen(self, sel, B32, bn2):
        """Screened float32 distances for a query tile and per-row error bounds.

        Bounds (u = 2**-24, n = width, factor 2 for safety): the float32
        dot product is within (n + 2) u |q| |b| of the exact one; each
        further float32 operation adds u times its magnitude."""
        G = self.Q32[sel] @ B32.T
        u = 2.0 ** -24
        n = self.Q.shape[1]
        if self.metric == "cosine":
            np.subtract(np.float32(1.0), G, out=G)
            return G, np.full(len(G), 2.0 * (n + 6) * u)
        bmax2 = float(bn2.max())
        if self.metric == "dot":
            np.negative(G, out=G)
            return G, 2.0 * (n + 4) * u * self.qnorm[sel] * np.sqrt(bmax2)
        # squared euclidean |q|^2 + |b|^2 - 2 q.b
        G *= np.float32(-2.0)
        G += self.Qaux[sel][:, None].astype(np.float32)
        G += bn2[None, :].astype(np.float32)
        return G, 4.0 * (n + 8) * u * (self.Qaux[sel] + bmax2)

    def _exact(self, r, c, Bp, B):
        if self.metric == "cosine":
            return np.clip(1.0 - np.einsum("ij,ij->i", self.Qp[r], Bp[c]), 0.0, 2.0)
        if self.metric == "dot":
            return -np.einsum("ij,ij->i", self.Q[r], B[c])
        diff = self.Q[r] - B[c]
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def add(self, ids: np.ndarray, B: np.ndarray, which: np.ndarray | None = None):
        """Compare base rows with all queries, or with those at ``which`` alone."""
        if len(ids) == 0:
            return
        Bp, _ = _prepare(B, self.metric)
        ok = np.isfinite(Bp).all(axis=1)
        if not ok.all():
            ids, B, Bp = ids[ok], B[ok], Bp[ok]
            if len(ids) == 0:
                return
        bn2 = np.einsum("ij,ij->i", B, B)
        B32 = Bp.astype(np.float32)
        nb = len(ids)
        kk = min(self.k, nb)
        step = max(1, TILE_BYTES // (8 * nb))
        # rows that pass the screen; of near copies all do
        pairs = max(1, TILE_BYTES // (16 * max(1, B.shape[1])))
        total = len(self.Qp) if which is None else len(which)
        for q0 in range(0, total, step):
            q1 = min(q0 + step, total)
            sel = slice(q0, q1) if which is None else which[q0:q1]
            S, err = self._screen(sel, B32, bn2)
            invalid = ~self.valid_q[sel]
            bound = self.bound[sel]
            # ties after rounding; euclidean bounds are kept as distances and compared on the squared scale: d <= T + 1e-9
            # means d^2 <= T^2 + 2e-9 T + 1e-18.  Limits are rounded up to float32 so that the compare stays in float32.
            if self.metric == "euclidean":
                bound = np.where(np.isfinite(bound), (bound + 1e-9) ** 2, np.inf)
                slack = lambda far: 2e-9 * np.sqrt(np.maximum(far, 0.0)) + 1e-18
            else:
                slack = lambda far: 1e-9
            up = lambda lim: np.nextafter(lim.astype(np.float32), np.float32(np.inf))[:, None]
            top = bound + err
            mask = S <= up(top + slack(np.where(np.isfinite(top), top, 0.0)))
            mask[invalid] = False
            # the k-th of this tile matters only to queries that have more than k rows within their bound
            many = np.flatnonzero(np.count_nonzero(mask, axis=1) > kk)
            if len(many):
                many = slice(None) if 2 * len(many) > len(S) else many
                near = S[many]
                kth = np.partition(near, kk - 1, axis=1)[:, kk - 1].copy()
                mask[many] = near <= up(np.minimum(kth + 2 * err[many], top[many]) + slack(kth + err[many]))
                mask[invalid] = False
                del near
            passed = np.flatnonzero(mask)
            del S, mask
            for at in range(0, len(passed), pairs):
                r, c = np.divmod(passed[at:at + pairs], nb)
                r = r + q0 if which is None else sel[r]
                d = self._exact(r, c, Bp, B)
                fin = np.isfinite(d)
                r, c, d = r[fin], c[fin], d[fin]
                self.parts.append((r, ids[c], d, _dkey(d)))
                self.n_buf += len(r)
                if self.n_buf > self.max_buf:
                    self._merge()

    def _merge(self):
        if not self.parts:
            return
        qa, ia, da, ka = self.acc
        qrow = np.concatenate([qa] + [p[0] for p in self.parts])
        idv = np.concatenate([ia] + [p[1] for p in self.parts])
        dist = np.concatenate([da] + [p[2] for p in self.parts])
        dkey = np.concatenate([ka] + [p[3] for p in self.parts])
        self.parts, self.n_buf = [], 0
        self.acc = qrow, idv, dist, dkey = _select(qrow, idv, dist, dkey, self.k)
        if len(qrow):
            counts = np.bincount(qrow, minlength=len(self.Q))
            ends = np.cumsum(counts) - 1
            full = np.flatnonzero(counts >= self.k)
            self.bound[full] = dist[ends[full]]

    def result(self):
        self._merge()
        return self.acc


def _id_array(col: pa.Array, dtype: T.DataType) -> np.ndarray:
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.asarray(col.to_pylist(), dtype=object)


def _id_dtype(dtype: T.DataType):
    return np.int64 if isinstance(dtype, (T.LongType, T.IntegerType)) else object


def _arrow_type(dt: T.DataType) -> pa.DataType:
    if isinstance(dt, T.LongType):
        return pa.int64()
    if isinstance(dt, T.IntegerType):
        return pa.int32()
    if isinstance(dt, T.StringType):
        return pa.string()
    raise TypeError(f"unsupported id type {dt.simpleString()}; use long, int or string")


def _out_schema(qtype: T.DataType, btype: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", qtype, False),
        T.StructField("neighbor_id", btype, False),
        T.StructField("distance", T.DoubleType(), False),
        T.StructField("dkey", T.DoubleType(), False),
    ])


def _to_batch(qids, qrow, ids, dist, dkey, qtype, btype) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[qrow] if len(qrow) else [], type=_arrow_type(qtype)),
         pa.array(ids if ids.dtype != object else list(ids), type=_arrow_type(btype)),
         pa.array(dist, type=pa.float64()),
         pa.array(dkey, type=pa.float64())],
        names=["query_id", "neighbor_id", "distance", "dkey"])


def _field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _prune(df: DataFrame, id_col: str, vec_col: str, dim: int | None) -> DataFrame:
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")).where(F.col("_vec").isNotNull())
    return rows.where(F.size("_vec") == dim) if dim else rows


# Width up to which the first collect of the queries brings their vectors along.
HEAD_WIDTH = 2048


def _query_head(queries: DataFrame, id_col: str, vec_col: str, broadcast_bytes: int):
    """(width, table): the width of the queries and, when they are all there, their (_id, _vec).

    One bounded collect: at most ``broadcast_bytes`` of vectors, none of them wider than ``HEAD_WIDTH``.  Queries of
    different widths among them raise (none may be left out without a word); further ones raise in the search."""
    rows = max(1, broadcast_bytes // (8 * HEAD_WIDTH))
    vec = F.col(vec_col)
    head = (queries.where(vec.isNotNull())
            .select(F.col(id_col).alias("_id"), F.size(vec).alias("_width"), F.when(F.size(vec) <= HEAD_WIDTH, vec).alias("_vec"))
            .limit(rows + 1).toArrow())
    widths = sorted(set(head.column("_width").to_pylist()))
    if len(widths) > 1:
        raise ValueError(f"query vectors have widths {widths}; pass dim to choose one")
    if not widths:
        return 0, None
    whole = head.num_rows <= rows and widths[0] <= HEAD_WIDTH
    return widths[0], head.select(["_id", "_vec"]) if whole else None


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", **opts) -> DataFrame:
    """Exact top-k neighbours of every query among ``base``.

    Returns ``query_id, neighbor_id, rank (long), distance (double)``.
    Rows with a null vector, a value that is not finite, a zero vector
    (cosine) or a width different from the queries' are left out of both
    sides; queries of different widths raise unless ``dim`` is given.  Keyword options:
    ``base_id, base_vec, query_id, query_vec, strategy ('auto' |
    'broadcast' | 'block'), broadcast_bytes, block_bytes``.
    """
    return knn_bounded(base, queries, k, metric, **opts)[0]


def knn_bounded(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", *,
                base_id: str = "id", base_vec: str = "embedding",
                query_id: str = "query_id", query_vec: str = "embedding",
                strategy: str = "auto", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                block_bytes: int = DEFAULT_BLOCK_BYTES, dim: int | None = None, within: float | None = None,
                num_pivots: int | None = None):
    """``knn`` plus a proven upper bound on its row count (``None`` when the
    query side was too large to count up front): callers use it to decide
    whether the result may be broadcast into a join.  ``dim``, when the
    caller knows the vector width (an embedder's output), saves the job
    that reads it from the queries.  ``within`` keeps neighbours below that
    distance only (of the k nearest); beyond ``broadcast_bytes`` of queries,
    or with ``strategy='ring'``, the search then leaves out the pairs that
    cannot be within it (``operators/ring.py``) instead of comparing all."""
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = base.sparkSession
    qtype, btype = _field_type(queries, query_id), _field_type(base, base_id)
    schema = _out_schema(qtype, btype)
    if strategy not in ("auto", "broadcast", "block", "ring"):
        raise ValueError("strategy must be 'auto', 'broadcast', 'block' or 'ring'")
    if strategy == "ring" and within is None:
        raise ValueError("strategy 'ring' needs the distance cut 'within'")
    given, tbl = dim, None
    if not dim:
        dim, tbl = _query_head(queries, query_id, query_vec, broadcast_bytes if strategy in ("auto", "broadcast") else 8)
    cand, bound = None, 0
    if dim:
        # a given width chooses among the queries; otherwise one of another width raises where it is read
        q = _prune(queries, query_id, query_vec, given)
        b = _prune(base, base_id, base_vec, dim)
        held = 8 * dim + STATE_BYTES * k            # bytes a query takes in a task
        if strategy in ("block", "ring") or (strategy == "auto" and tbl is not None and tbl.num_rows * held > max(broadcast_bytes, held)):
            tbl = None
        elif tbl is None:
            # Bounded collect: at most cap + 1 rows ever reach the driver.
            cap = max(1, broadcast_bytes // (8 * dim if strategy == "broadcast" else held))
            tbl = q.limit(cap + 1).toArrow()
            if tbl.num_rows > cap:
                if strategy == "broadcast":
                    raise ValueError("query matrix exceeds broadcast_bytes; use strategy='block'")
                tbl = None
        if tbl is not None:
            bound = tbl.num_rows * k
            if tbl.num_rows:
                cand = _broadcast_candidates(spark, fit_scan_tasks(b, "_id"), tbl, k, metric, dim,
                                             qtype, btype, schema)
        elif strategy == "ring" or (strategy == "auto" and within is not None and metric != "dot"):
            from vectriage.operators.ring import ring_candidates
            bound = None
            cand = ring_candidates(b, q, k, within, metric, base_id="_id", base_vec="_vec", query_id="_id", query_vec="_vec",
                                   block_bytes=block_bytes, num_pivots=num_pivots)
        else:
            bound = None
            cand = _block_candidates(b, q, k, metric, dim, qtype, btype, schema, block_bytes)
    if cand is None:
        cand = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("dkey", "neighbor_id")
    res = (cand.withColumn("rank", F.row_number().over(w).cast("long"))
               .where(F.col("rank") <= k)
               .select("query_id", "neighbor_id", "rank", "distance"))
    return (res if within is None else res.where(F.col("distance") < within)), bound


# Largest top-k result (rows x ~48 bytes) we broadcast into a payload join.
MAX_BROADCAST_RESULT_BYTES = 256 << 20


def join_payload(res: DataFrame, bound, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a top-k result to a (large) table on its unique key.

    When the result has a proven row bound that fits
    ``MAX_BROADCAST_RESULT_BYTES`` it is broadcast, so the table is
    streamed once with no shuffle; otherwise Spark / AQE choose.
    """
    small = bound is not None and bound * 48 <= MAX_BROADCAST_RESULT_BYTES
    return (F.broadcast(res) if small else res).join(table, key, how)


def _broadcast_candidates(spark, b, tbl, k, metric, dim, qtype, btype, schema):
    # Size was checked by the caller: at most broadcast_bytes of matrix.
    qids = np.asarray(tbl.column("_id").to_pylist(), dtype=object)
    Q = _vec_matrix(tbl.column("_vec"), dim)
    bc = spark.sparkContext.broadcast((qids, Q))

    def run(batches):
        qids_, Q_ = bc.value
        kern = _Kernel(Q_, metric, k, _id_dtype(btype))
        for rb in batches:
            if rb.num_rows:
                kern.add(*_without_spare_copies(_id_array(rb.column(0), btype), _vec_matrix(rb.column(1), dim), k))
        qrow, ids, dist, dkey = kern.result()
        yield _to_batch(qids_, qrow, ids, dist, dkey, qtype, btype)
        del kern, qrow, ids, dist, dkey
        release()

    return b.mapInArrow(run, schema)


def meet(qids, Q, pieces, metric, k, qtype, btype, wanted=None, within=None):
    """Batches of the top-k candidates of query rows among ``pieces``, functions that give (ids, vectors) of some base rows.

    ``wanted(piece, lo, hi)`` names the queries of a slice that compare with the piece (None: all of them)."""
    for lo in range(0, len(Q), QUERY_ROWS):
        hi = min(lo + QUERY_ROWS, len(Q))
        kern = _Kernel(Q[lo:hi], metric, k, _id_dtype(btype))
        if within is not None:
            kern.bound[:] = within
        for p, piece in enumerate(pieces):
            which = None if wanted is None else wanted(p, lo, hi)
            if which is None or len(which):
                kern.add(*piece(), which)
        qrow, ids, dist, dkey = kern.result()
        if within is not None:
            near = dist < within
            qrow, ids, dist, dkey = qrow[near], ids[near], dist[near], dkey[near]
        yield _to_batch(qids[lo:hi], qrow, ids, dist, dkey, qtype, btype)


def grid(spark, rows: int, most: int) -> tuple[int, int]:
    """(parts of the base, parts of the queries): no more than ``most`` rows in a base part, a task for every core."""
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, math.ceil(rows / most), math.ceil(math.sqrt(cores)))
    return parts, max(1, math.ceil(cores / parts))


def _block_candidates(b, q, k, metric, dim, qtype, btype, schema, block_bytes):
    """A grid of base parts and query parts, a task each: the base part is held in blocks of ``block_bytes``, the queries are streamed past them.

    A base part holds up to ``DEFAULT_BLOCK_BYTES`` (or one larger block); each row travels once per part of the other side."""
    block = max(1, block_bytes // (8 * dim))
    parts, asked = grid(b.sparkSession, b.count(), max(block, DEFAULT_BLOCK_BYTES // (8 * dim)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = b.select(F.pmod(F.xxhash64("_id"), F.lit(parts)).alias("_part"), every(asked).alias("_asked"), F.lit(False).alias("_asks"),
                    F.lit(None).cast(qtype).alias("_qid"), F.col("_id").alias("_bid"), F.col("_vec").cast("array<double>").alias("_vec"))
    asks = q.select(every(parts).alias("_part"), F.pmod(F.xxhash64("_id"), F.lit(asked)).alias("_asked"), F.lit(True).alias("_asks"),
                    F.col("_id").alias("_qid"), F.lit(None).cast(btype).alias("_bid"), F.col("_vec").cast("array<double>").alias("_vec"))
    dealt = (rows.unionByName(asks).withColumn("_group", F.col("_part") * F.lit(asked) + F.col("_asked")).drop("_part", "_asked")
             .repartition(4 * parts * asked, "_group").sortWithinPartitions("_group", "_asks"))

    def run(batches):
        group, held = None, []
        for rb in batches:
            at, ask = rb.column("_group").to_numpy(), rb.column("_asks").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(at) != 0) | (ask[1:] != ask[:-1])) + 1
            for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(at)].tolist()):
                if lo == hi:
                    continue
                if at[lo] != group:
                    group, held = at[lo], []
                part = rb.slice(lo, hi - lo)
                mat = _vec_matrix(part.column("_vec"), dim)
                if not ask[lo]:
                    ids, mat = _without_spare_copies(_id_array(part.column("_bid"), btype), mat, k)
                    for i in range(0, len(ids), block):
                        held.append((ids[i:i + block], mat[i:i + block]))
                elif held:
                    qids = np.asarray(part.column("_qid").to_pylist(), dtype=object)
                    yield from meet(qids, mat, [lambda piece=piece: piece for piece in held], metric, k, qtype, btype)
        held = []
        release()

    return dealt.mapInArrow(run, schema)


def _arrow_schema(qtype, btype) -> pa.Schema:
    return pa.schema([("query_id", _arrow_type(qtype)), ("neighbor_id", _arrow_type(btype)),
                      ("distance", pa.float64()), ("dkey", pa.float64())])


def distance_sql(metric: str, a: str, b: str) -> str:
    """The same distance as a DuckDB expression over two DOUBLE[] lists (for oracles)."""
    metric = metric.lower()
    if metric == "cosine":
        return f"least(greatest(list_cosine_distance({a}, {b}), 0.0), 2.0)"
    if metric == "euclidean":
        return f"list_distance({a}, {b})"
    if metric == "dot":
        return f"-list_inner_product({a}, {b})"
    raise ValueError(metric)
