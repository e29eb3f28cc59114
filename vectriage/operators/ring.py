"""Exact nearest neighbours under a distance cut, without comparing all pairs.

Rows go to the nearest of a set of pivots and, by their distance from it, to a
ring of that pivot's list.  For a query at distance ``g`` from a pivot and
``g0`` from its nearest one, a row within ``t`` of it lies, by the triangle
inequality, in the ring range ``[g - t, g0 + t]`` of that list (the upper end
because the row is no farther from its own pivot than from the query's).  Only
these cells meet the query (``ring_cells``: by list, ring, block and query
block, cut by counted rows and probes).  For cosine the vectors are taken at
unit length, where the square of the distance is twice the cosine distance.

In a search of few rows (both sides within ``block_bytes``), lists travel in
bundles (``ring_bundles``): a query goes once to each bundle with a cell of its
own, not once to each cell, and meets there the rows of its ring ranges.

Beyond that (``ring_stream``) no vector travels more often than once: both sides
are sorted by list and distance and kept in compressed blocks of ``HELD_BYTES``
in the checkpoint folder.  A task holds one block of queries and reads the
blocks of the base past it; pieces that lie in no query's ring range are not
compared, blocks of such pieces not unpacked.  The k-th distance found so far
takes the place of the cut in a query's ring range.  Disk grows with the rows,
not with pairs of blocks; a hot list is many blocks.

Pivots are the rows of the smallest id hashes, or the centroids of an index.
They and the table of cells (at most ``RINGS + 1`` a pivot) are broadcast; their
number is capped by ``PIVOT_BYTES``.  How many pairs are left depends on how the
data cluster at the cut: data without clusters leave most of them.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.operators.blocks import open_block, write_block
from vectriage.operators.ivf import _points, _repeated, _squared, _usable, assign_nearest, bundle_lists
from vectriage.operators.knn import (DEFAULT_BLOCK_BYTES, _arrow_schema, _field_type, _id_array, _id_dtype, _Kernel, _out_schema, _vec_matrix,
                                     _without_spare_copies, grid, meet, release)
from vectriage.session import ensure_checkpoint_dir

PIVOT_BYTES = 16 << 20
RINGS = 64
PIECE_ROWS = 1024               # base rows of neighbouring distances, compared at a time in a task
HELD_BYTES = 16 << 20           # vectors of one block, of queries or of the base, in a streamed search
GAP_LISTS = 64                  # lists whose distances from the queries of a block are held at a time
SLACK = 4e-6                    # of the longest vector: beyond what rounding adds to a distance of up to 10,000 dimensions


def choose_pivots(rows: DataFrame, id_col: str, vec_col: str, count: int, metric: str) -> DataFrame:
    """(list_id, centroid): the distinct vectors of the ``count`` rows of smallest id hash."""
    code = F.xxhash64(id_col)
    edge = rows.select(code.alias("_h")).orderBy("_h").limit(count).agg(F.max("_h")).first()[0]      # so that only their vectors are sorted
    first = rows.where(code <= edge).orderBy(code, id_col).limit(count).select(vec_col).toArrow().column(vec_col)
    mat = _points(_vec_matrix(first, len(first[0].as_py())), metric)
    mat = np.unique(mat, axis=0)
    schema = T.StructType([T.StructField("list_id", T.LongType(), False), T.StructField("centroid", T.ArrayType(T.DoubleType()), False)])
    return rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(mat.tolist())], schema)


def _place(base: DataFrame, queries: DataFrame, max_distance: float, metric: str, base_id: str, base_vec: str, query_id: str, query_vec: str,
           num_pivots: int | None, pivots: DataFrame | None):
    """(queries, placed rows, counted cells, pivot ids, pivots, full cells, reach, ring width, longest vector) of a search under a cut.

    None when one side has no usable vector."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError("a distance cut needs the cosine or the euclidean metric")
    ensure_checkpoint_dir(base.sparkSession)
    reach = math.sqrt(2.0 * max(max_distance, 0.0)) if metric == "cosine" else max(max_distance, 0.0)
    rows = base.select(F.col(base_id).alias("_id"), F.col(base_vec).cast("array<double>").alias("_vec")).where(_usable("_vec", metric))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_vec")).where(_usable("_vec", metric))
    if pivots is None:
        one = rows.select(F.size("_vec").alias("n")).first()
        if one is None or not one["n"]:
            return None
        most = max(1, PIVOT_BYTES // (8 * one["n"]))
        pivots = choose_pivots(rows, "_id", "_vec", min(most, num_pivots or max(1, math.ceil(math.sqrt(rows.count())))), metric)
    assigned = assign_nearest(rows, pivots, "_id", "_vec", metric).checkpoint()
    radius = assigned.agg(F.max("centroid_distance")).first()[0]
    if radius is None:
        return None
    width = max(reach / 4.0, radius / RINGS, SLACK)
    placed = assigned.withColumn("ring", F.floor(F.col("centroid_distance") / F.lit(width)).cast("long"))
    counts = placed.groupBy("list_id", "ring").agg(F.count(F.lit(1)).alias("_n")).collect()        # at most RINGS + 1 a pivot
    known = pivots.orderBy("list_id").select("list_id", "centroid").toArrow()
    ids = known.column("list_id").to_numpy()
    mat = _vec_matrix(known.column("centroid"), len(known.column("centroid")[0].as_py()))
    full = np.zeros((len(ids), max(r["ring"] for r in counts) + 1), bool)
    full[np.searchsorted(ids, [r["list_id"] for r in counts]), [r["ring"] for r in counts]] = True
    longest = float(np.sqrt(np.einsum("ij,ij->i", mat, mat)).max()) + radius
    return q, placed, counts, ids, mat, full, reach, width, longest


def ring_cells(base: DataFrame, queries: DataFrame, max_distance: float, metric: str = "cosine", *, base_id: str = "id", base_vec: str = "embedding",
               query_id: str = "query_id", query_vec: str = "embedding", num_pivots: int | None = None, pivots: DataFrame | None = None,
               block_bytes: int = DEFAULT_BLOCK_BYTES) -> tuple[DataFrame, DataFrame] | None:
    """(queries, rows) on (list_id, ring, _block, _qblock): every query meets once every row that can be within the cut.

    None when one side has no usable vector."""
    metric = metric.lower()
    spark = base.sparkSession
    found = _place(base, queries, max_distance, metric, base_id, base_vec, query_id, query_vec, num_pivots, pivots)
    if found is None:
        return None
    q, placed, counts, ids, mat, full, reach, width, longest = found
    shared = spark.sparkContext.broadcast((ids, mat, full))

    def run(batches):
        ids_, mat_, full_ = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _points(_vec_matrix(part.column("_vec"), mat_.shape[1]), metric)
                gap = np.sqrt(_squared(x, mat_))
                near = reach + SLACK * np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), max(longest, 1.0))
                least = np.maximum(np.floor((gap - near[:, None]) / width), 0).astype(np.int64)
                most = np.minimum(np.floor((gap.min(1) + near) / width), full_.shape[1] - 1).astype(np.int64)
                who, where, ring = [], [], []
                for step in range(int((most[:, None] - least).max(initial=-1)) + 1):
                    at = least + step
                    a, b = np.nonzero((at <= most[:, None]) & full_[np.arange(len(ids_))[None, :], np.minimum(at, full_.shape[1] - 1)])
                    who.append(a)
                    where.append(b)
                    ring.append(at[a, b])
                if who:
                    who, where, ring = map(np.concatenate, (who, where, ring))
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(who)), pa.array(ids_[where]), pa.array(ring)],
                                                     names=["query_id", "list_id", "ring"])

    schema = T.StructType([T.StructField("query_id", _field_type(queries, query_id)), T.StructField("list_id", T.LongType()), T.StructField("ring", T.LongType())])
    probes = q.mapInArrow(run, schema)
    row_most = max(1, block_bytes // (8 * mat.shape[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(row_most))).cast("long")
    cells = spark.createDataFrame([tuple(r) for r in counts], "list_id long, ring long, _n long")
    asked = probes.groupBy("list_id", "ring").agg(F.count(F.lit(1)).alias("_q"))
    sizes = F.broadcast(cells.join(asked, ["list_id", "ring"]).select("list_id", "ring", blocks("_n").alias("_blocks"), blocks("_q").alias("_qblocks")))
    met = placed.join(sizes, ["list_id", "ring"]).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks"))).withColumn("_qblock", every("_qblocks"))
    pq = (probes.join(q, "query_id").join(sizes, ["list_id", "ring"]).withColumn("_qblock", F.pmod(F.xxhash64("query_id"), F.col("_qblocks")))
          .withColumn("_block", every("_blocks")).withColumnRenamed("query_id", "_id"))
    keep = ["list_id", "ring", "_block", "_qblock", "_id", "_vec"]
    return pq.select(*keep), met.select(*keep)


def ring_bundles(base: DataFrame, queries: DataFrame, max_distance: float, metric: str = "cosine", *, base_id: str = "id", base_vec: str = "embedding",
                 query_id: str = "query_id", query_vec: str = "embedding", num_pivots: int | None = None, pivots: DataFrame | None = None,
                 block_bytes: int = DEFAULT_BLOCK_BYTES):
    """(queries, rows, pivots to share, reach of vectors): both sides on (list_id, _block, _qblock), a query once in each bundle of lists that it needs.

    None when one side has no usable vector."""
    kind = metric.lower()
    spark = base.sparkSession
    found = _place(base, queries, max_distance, kind, base_id, base_vec, query_id, query_vec, num_pivots, pivots)
    if found is None:
        return None
    q, placed, counts, ids, mat, full, reach, width, longest = found
    q = q.where(F.col("query_id").isNotNull())
    qtype = _field_type(queries, query_id)
    counted = {}
    for r in counts:
        counted[r["list_id"]] = counted.get(r["list_id"], 0) + r["_n"]
    most = max(1, block_bytes // (8 * mat.shape[1]))
    parts, asked = grid(spark, sum(counted.values()), most)
    bundles = bundle_lists(counted, most, parts)
    asked = max(asked, math.ceil(q.count() / most))
    places = [int(np.searchsorted(ids, i)) for i in sorted(bundles)]             # lists with rows, bundle after bundle
    firsts = [bundles[i][0] for i in sorted(bundles)]
    starts = [p for p, b in enumerate(firsts) if p == 0 or firsts[p - 1] != b]
    names = np.array([firsts[p] for p in starts], np.int64)
    before = np.concatenate([np.zeros((len(ids), 1), np.int64), np.cumsum(full, axis=1)], axis=1)      # full rings below each ring
    shared = spark.sparkContext.broadcast((ids, mat, before, places, starts, names))

    def near_of(x):
        return reach + SLACK * np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), max(longest, 1.0))

    def send(batches):
        _, mat_, before_, places_, starts_, names_ = shared.value
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            x = _points(_vec_matrix(batch.column("_vec"), mat_.shape[1]), kind)
            gap, near = np.sqrt(_squared(x, mat_)), near_of(x)
            rings = before_.shape[1] - 1
            least = np.clip(np.floor((gap[:, places_] - near[:, None]) / width), 0, rings).astype(np.int64)
            most_ = np.minimum(np.floor((gap.min(1) + near) / width), rings - 1).astype(np.int64) + 1
            lists = np.array(places_)[None, :]
            meets = before_[lists, np.maximum(most_[:, None], least)] > before_[lists, least]
            who, where = np.nonzero(np.logical_or.reduceat(meets, starts_, axis=1))
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), pa.array(names_[where]), pa.array(gap.min(1)[who]), batch.column("_vec").take(at)],
                                             names=["_id", "list_id", "_nearest", "_vec"])
        release()

    schema = T.StructType([T.StructField("_id", qtype), T.StructField("list_id", T.LongType()), T.StructField("_nearest", T.DoubleType()),
                           T.StructField("_vec", T.ArrayType(T.DoubleType()))])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    known = F.broadcast(spark.createDataFrame([(i, b, n) for i, (b, n) in bundles.items()], "list_id long, _bundle long, _blocks long"))
    firsts = F.broadcast(known.where("list_id = _bundle").select("list_id", "_blocks"))
    pq = (q.mapInArrow(send, schema).join(firsts, "list_id").withColumn("_qblock", F.pmod(F.xxhash64("_id"), F.lit(asked)))
          .withColumn("_block", every(F.col("_blocks"))).drop("_blocks"))
    rows = (placed.drop("ring").join(known, "list_id").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
            .withColumn("_qblock", every(F.lit(asked).cast("long"))).withColumnRenamed("list_id", "_list").withColumnRenamed("_bundle", "list_id").drop("_blocks"))
    return pq, rows, shared, near_of


def _sorted_blocks(rows: DataFrame, pivots: DataFrame, kind: str, total: int, most: int, k: int | None) -> RDD:
    """(number, head, body): ``rows(_id, _vec)`` by list and distance from the pivot in blocks of at most ``most``.

    With ``k``, the rows of a block that equal k others of smaller ids are left out.  ``body`` has a batch for each piece,
    ``head`` its list, least and largest distance, and the longest vector of the block."""
    placed = assign_nearest(rows, pivots, "_id", "_vec", kind)
    # about 0.8 of the most, as the ranges are drawn from a sample
    dealt = (placed.repartitionByRange(max(1, math.ceil(1.25 * total / most)), "list_id", "centroid_distance", F.xxhash64("_id"))
             .sortWithinPartitions("list_id", "centroid_distance"))

    def block(held):
        t = pa.Table.from_batches(held).combine_chunks()
        mat = _vec_matrix(t.column("_vec"), len(t.column("_vec")[0]))
        if k is not None:
            order = pc.sort_indices(t.column("_id")).to_numpy()
            spot = np.empty(len(order), np.int64)
            spot[order] = np.arange(len(order))
            left = np.sort(order[_without_spare_copies(spot, mat, k)[0]])
            if len(left) < len(mat):
                t, mat = t.take(pa.array(left)).combine_chunks(), mat[left]
        home, gone = t.column("list_id").to_numpy(), t.column("centroid_distance").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(home)) + 1, len(home)]
        lo = np.array([i for f, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for i in range(f, e, PIECE_ROWS)], np.int64)
        hi = np.r_[lo[1:], len(home)]
        head = pickle.dumps((home[lo], gone[lo], gone[hi - 1], float(np.sqrt(np.einsum("ij,ij->i", mat, mat)).max())))
        body = write_block([b for f, e in zip(lo.tolist(), hi.tolist()) for b in t.slice(f, e - f).to_batches()], t.schema)
        return pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([body], pa.binary())], names=["head", "body"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                held.append(batch.slice(lo, most - n))
                n, lo = n + held[-1].num_rows, lo + held[-1].num_rows
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)
        release()

    # as Python's own bytes, which Spark hands on as they are
    blocks = dealt.mapInArrow(run, "head binary, body binary").rdd.mapPartitionsWithIndex(
        lambda part, found: (((part, i), bytes(r.head), bytes(r.body)) for i, r in enumerate(found)))
    blocks.checkpoint()
    blocks.foreachPartition(lambda found: None)
    return blocks


def ring_stream(rows: DataFrame, q: DataFrame, n: int, asked: int, dim: int, k: int, max_distance: float, kind: str, num_pivots: int | None,
                pivots: DataFrame | None) -> DataFrame:
    """Top-k candidates below ``max_distance`` among ``n`` rows (_id, _vec) of ``asked`` queries (_id, _vec): blocks of queries, past which the base is read."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    qtype, btype = _field_type(q, "_id"), _field_type(rows, "_id")
    if pivots is None:
        pivots = choose_pivots(rows, "_id", "_vec", min(max(1, PIVOT_BYTES // (8 * dim)), num_pivots or math.ceil(math.sqrt(n))), kind)
    known = pivots.orderBy("list_id").select("list_id", "centroid").toArrow()
    ids, mat = known.column("list_id").to_numpy(), _vec_matrix(known.column("centroid"), dim)
    far = float(np.sqrt(np.einsum("ij,ij->i", mat, mat)).max())
    most = max(1, HELD_BYTES // (8 * dim))
    base = _sorted_blocks(rows, pivots, kind, n, most, k)
    # smaller blocks of few queries keep the cores busy
    asks = _sorted_blocks(q, pivots, kind, asked, max(1, min(most, math.ceil(asked / (3 * spark.sparkContext.defaultParallelism)))), None)
    shared = spark.sparkContext.broadcast((ids, mat))

    def run(pairs):
        ids_, mat_ = shared.value
        at, kern, piece = None, None, None

        def done():
            qrow, near, dist, dkey = kern.result()
            below = dist < max_distance
            return zip(qids[qrow[below]].tolist(), near[below].tolist(), dist[below].tolist(), dkey[below].tolist())

        for (no, _, asking), (_, head, body) in pairs:
            if no != at:
                if kern is not None:
                    yield from done()
                t = open_block(asking).read_all()
                kern = _Kernel(_vec_matrix(t.column("_vec"), dim), kind, k, _id_dtype(btype))
                kern.bound[:] = max_distance
                at, qids, closest = no, np.asarray(t.column("_id").to_pylist(), dtype=object), t.column("centroid_distance").to_numpy()
                x = kern.Qp                         # of unit length for cosine
                square = np.einsum("ij,ij->i", x, x)
                del t
            home, least, largest, longest = pickle.loads(head)
            held = open_block(body)
            slack = SLACK * np.maximum(np.sqrt(square) + closest, max(longest, far, 1.0))
            first = 0
            lists = np.unique(home)
            for c in range(0, len(lists), GAP_LISTS):
                centre = mat_[np.searchsorted(ids_, lists[c:c + GAP_LISTS])]
                gap = np.sqrt(np.maximum(square[:, None] + np.einsum("ij,ij->i", centre, centre)[None, :] - 2.0 * (x @ centre.T), 0.0))
                while first < len(home) and home[first] <= lists[c:c + GAP_LISTS][-1]:
                    g = gap[:, np.searchsorted(lists[c:c + GAP_LISTS], home[first])]
                    cut = kern.bound + 2e-9         # ties after rounding
                    near = (np.sqrt(2.0 * np.maximum(cut, 0.0)) if kind == "cosine" else cut) + slack
                    which = np.flatnonzero((g - near <= largest[first]) & (closest + near >= least[first]))
                    if len(which):
                        piece = held.get_batch(first)
                        kern.add(_id_array(piece.column("_id"), btype), _vec_matrix(piece.column("_vec"), dim), None if len(which) == len(x) else which)
                    first += 1
            if kern.n_buf > len(x):
                kern._merge()                       # nearer bounds for the next block
        if kern is not None:
            yield from done()
            kern = x = held = piece = None
        release()

    # one partition of the base, read as a stream by each task: none of it is held or shuffled
    cand = spark.createDataFrame(asks.cartesian(base.coalesce(1)).mapPartitions(run), _out_schema(qtype, btype), verifySchema=False)
    often = q.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumnRenamed("_id", "query_id")
    if often.isEmpty():
        return cand
    # as in the bundles: as often as the query's id occurs
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))).alias("_times")
    return cand.join(often, "query_id", "left").select(*cand.columns, times).drop("_times")


def ring_candidates(base: DataFrame, queries: DataFrame, k: int, max_distance: float, metric: str = "cosine", *, base_id: str = "id", base_vec: str = "embedding",
                    query_id: str = "query_id", query_vec: str = "embedding", num_pivots: int | None = None, pivots: DataFrame | None = None,
                    block_bytes: int = DEFAULT_BLOCK_BYTES) -> DataFrame | None:
    """Top-k candidates below ``max_distance``, for the merge of ``knn``; None when there are none.

    Rows of both sides beyond ``block_bytes`` are streamed (``ring_stream``), fewer meet in bundles (``bundle_candidates``)."""
    kind = metric.lower()
    if kind not in ("cosine", "euclidean"):
        raise ValueError("a distance cut needs the cosine or the euclidean metric")
    opts = dict(num_pivots=num_pivots, pivots=pivots)
    rows = base.select(F.col(base_id).alias("_id"), F.col(base_vec).cast("array<double>").alias("_vec")).where(_usable("_vec", kind))
    one = rows.select(F.size("_vec").alias("n")).first()
    if one is None or not one["n"]:
        return None
    q = queries.select(F.col(query_id).alias("_id"), F.col(query_vec).cast("array<double>").alias("_vec")).where(_usable("_vec", kind) & F.col(query_id).isNotNull())
    n, asked = rows.count(), q.count()
    if n + asked > block_bytes // (8 * one["n"]):
        return ring_stream(rows, q, n, asked, one["n"], k, max_distance, kind, **opts)
    return bundle_candidates(base, queries, k, max_distance, kind, base_id=base_id, base_vec=base_vec, query_id=query_id, query_vec=query_vec,
                             block_bytes=block_bytes, **opts)


def bundle_candidates(base: DataFrame, queries: DataFrame, k: int, max_distance: float, metric: str = "cosine", *, base_id: str = "id",
                      query_id: str = "query_id", **opts) -> DataFrame | None:
    """Top-k candidates below ``max_distance`` of every bundle of lists; None when one side has no usable vector."""
    kind = metric.lower()
    found = ring_bundles(base, queries, max_distance, kind, base_id=base_id, query_id=query_id, **opts)
    if found is None:
        return None
    pq, rows, shared, near_of = found
    qtype, btype = _field_type(queries, query_id), _field_type(base, base_id)

    def run(qt: pa.Table, bt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or bt.num_rows == 0:
            return pa.Table.from_batches([], schema=_arrow_schema(qtype, btype))
        ids_, mat_ = shared.value[:2]
        dim = mat_.shape[1]
        qids = np.asarray(qt.column("_id").to_pylist(), dtype=object)
        Q, B = _vec_matrix(qt.column("_vec"), dim), _vec_matrix(bt.column("_vec"), dim)
        own, home, gone = _id_array(bt.column("_id").combine_chunks(), btype), bt.column("_list").to_numpy(), bt.column("centroid_distance").to_numpy()
        order = np.lexsort((gone, home))
        cuts = np.flatnonzero(np.r_[True, np.diff(home[order]) != 0])
        spans = [order[i:min(i + PIECE_ROWS, e)] for f, e in zip(cuts.tolist(), np.r_[cuts[1:], len(order)].tolist()) for i in range(f, e, PIECE_ROWS)]
        held = np.unique(home)
        centres, place = mat_[np.searchsorted(ids_, held)], {int(i): p for p, i in enumerate(held)}
        closest = qt.column("_nearest").to_numpy()
        seen = {}

        def wanted(piece, lo, hi):
            if lo not in seen:                      # distances of a slice's queries from the lists here
                seen.clear()
                x = np.vstack([_points(Q[i:min(i + 1024, hi)], kind) for i in range(lo, hi, 1024)])
                seen[lo] = np.sqrt(_squared(x, centres)), near_of(x)
            (gap, near), at = seen[lo], spans[piece]
            return np.flatnonzero((gap[:, place[int(home[at[0]])]] - near <= gone[at[-1]]) & (closest[lo:hi] + near >= gone[at[0]]))

        pieces = [lambda at=at: (own[at], B[at]) for at in spans]
        out = pa.Table.from_batches(_repeated(meet(qids, Q, pieces, kind, k, qtype, btype, wanted, max_distance), qids.tolist()), schema=_arrow_schema(qtype, btype))
        del Q, B, pieces
        release()
        return out

    on = ["list_id", "_block", "_qblock"]
    return pq.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(run, _out_schema(qtype, btype))
