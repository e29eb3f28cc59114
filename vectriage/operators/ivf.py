"""Inverted-file (IVF) vector index: lists around centroids plus exact re-ranking.

Build
-----
``build_ivf`` learns the centroids in groups of bounded size, one task each:
on a sample of ``train_per_list`` rows a list, chosen by the hash of their id
(a documented bound; every row is indexed), and in two levels when there are
many lists, so that each branch is clustered in its own group.  They stay a
table of ``num_lists`` rows; callers may give their own (``centroids``).
``method='tree'`` splits every branch over all rows, level by level, until no
leaf has more than ``max_leaf_size`` rows.  For cosine, vectors and centroids
have unit length, so the nearest centroid is the same by angle and by
distance.  Every row goes to its nearest centroid (of its branch, for a tree)
with its distance from it, map-side.

The index is ``rows`` (written ``partitionBy('list_id')``), ``centroids`` and
``lists`` (counted rows and radius of each list).

Search
------
A task ranks the lists for its own queries; queries are not collected.  The
probed list ids become a filter on the ``list_id`` folders (dynamic partition
pruning), so only their files are read.  Lists travel in bundles (as many rows
as a task holds, a few bundles at least): a query goes once to each bundle that
holds a list of its own, with the names of those lists, not once to each list.
They meet in a cogroup on ``(list_id, block, query block)``, ``list_id`` being
the first list of the bundle: a list beyond ``max_block_rows`` rows (or
``block_bytes`` by the vectors' width) is cut into hash blocks, and the queries
into blocks of ``max_query_rows``.  A query is compared with the rows of its
own lists alone.  Candidates are merged with ``row_number() <= k``.

With a filter, its rows are counted per list and each query probes as many of
its nearest lists as hold k of them in sum, at least ``fraction`` of all: one
pass, whatever the fraction.

``bound=True`` searches each query's nearest list first; the distance of its
k-th row there then rules out, by the triangle inequality, every further list
that lies beyond it by more than its radius.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.functions.numeric import round_half_away
from vectriage.operators.knn import (DEFAULT_BLOCK_BYTES, DEFAULT_BROADCAST_BYTES, _Kernel, _arrow_schema, _arrow_type, _field_type, _id_array,
                                     _id_dtype, _out_schema, _to_batch, _vec_matrix, grid, knn, meet, release)

DEFAULT_MAX_BLOCK_ROWS = 200_000
DEFAULT_MAX_QUERY_ROWS = 20_000
DEFAULT_TRAIN_PER_LIST = 256
TRAIN_BYTES = 64 << 20          # vectors of one clustering group
FLAT_LISTS = 64                 # more lists than this are learnt in two levels
SLICE_ROWS = 2048               # rows placed at a time in a task
SLICE_PROBES = 1 << 18          # lists ranked at a time in a task, over its queries
PIECE_ROWS = 4096               # base rows compared at a time in a task
CENTROID_SCHEMA = T.StructType([T.StructField("list_id", T.LongType(), False),
                                T.StructField("centroid", T.ArrayType(T.DoubleType()), False)])


@dataclass
class IVFIndex:
    centroids: DataFrame      # list_id long, centroid array<double>
    rows: DataFrame           # <id>, list_id long, <vector>
    id_col: str
    vec_col: str
    metric: str
    num_lists: int
    sizes: DataFrame | None = None   # list_id, n_rows (counted), radius
    restricted: bool = False         # rows were cut down by a filter after the build
    path: str | None = None          # the folder it was read from


def restrict(index: IVFIndex, allowed: DataFrame) -> IVFIndex:
    """The index limited to the ids in ``allowed`` (a semi join on the id):
    pre-filtering for searches whose filter columns are not in the index."""
    rows = index.rows.join(allowed.select(index.id_col), index.id_col, "left_semi")
    return IVFIndex(index.centroids, rows, index.id_col, index.vec_col, index.metric, index.num_lists,
                    None, True, index.path)


def _usable(vec: str, metric: str):
    """Vectors that a search can return: finite, and not zero for cosine."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(vec).isNotNull() & finite
    return ok & F.exists(vec, lambda x: x != 0) if metric == "cosine" else ok


def _points(mat: np.ndarray, metric: str) -> np.ndarray:
    """The vectors as the lists see them: of unit length for cosine."""
    if metric != "cosine":
        return mat
    return mat / np.sqrt(np.einsum("ij,ij->i", mat, mat))[:, None]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def cluster(x: np.ndarray, k: int, metric: str, seed: int = 42, max_iter: int = 10) -> np.ndarray:
    """Lloyd's k-means of one group of points: at most k distinct centroids, deterministic for the order of ``x``."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(max_iter):
        near = np.concatenate([_squared(x[i:i + 8192], c).argmin(1) for i in range(0, len(x), 8192)])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        fresh = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if metric == "cosine":
            size = np.sqrt(np.einsum("ij,ij->i", fresh, fresh))[:, None]
            fresh = np.where(size > 0, fresh / np.where(size > 0, size, 1.0), c)
        # A centroid without points moves to the point farthest from its own.
        idle = np.flatnonzero(count == 0)
        if len(idle):
            gap = np.einsum("ij,ij->i", x - fresh[near], x - fresh[near])
            fresh[idle] = x[np.argsort(-gap, kind="stable")[:len(idle)]]
        if np.array_equal(fresh, c):
            break
        c = fresh
    return np.unique(c, axis=0)


def _hashed(id_col: str, seed: int):
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 62)).alias("_h")


def _matrix_broadcast(centroids: DataFrame, limit: int = DEFAULT_BROADCAST_BYTES):
    """(ids, matrix) of a centroid table on the driver, or None above ``limit`` bytes."""
    first = centroids.first()
    if first is None:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = len(first["centroid"])
    cap = max(1, limit // (8 * dim))
    tbl = centroids.select("list_id", "centroid").limit(cap + 1).toArrow()
    if tbl.num_rows > cap:
        return None
    ids = tbl.column("list_id").to_numpy()
    order = np.argsort(ids)
    return ids[order], _vec_matrix(tbl.column("centroid"), dim)[order]


def _fit_groups(points: DataFrame, metric: str, seed: int, max_iter: int) -> DataFrame:
    """``points(branch, leaves, _h, _vec)``: centroids (branch, centroid) of each branch, clustered in its own group."""
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("_h").to_numpy(), kind="stable")
        mat = _vec_matrix(t.column("_vec"), len(t.column("_vec")[0].as_py()))[order]
        c = cluster(_points(mat, metric), int(t.column("leaves")[0].as_py()), metric, seed, max_iter)
        return pa.table({"branch": pa.array([t.column("branch")[0].as_py()] * len(c), pa.int64()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return points.groupBy("branch").applyInArrow(run, "branch long, centroid array<double>")


def _numbered(centroids: DataFrame) -> DataFrame:
    """List ids 0, 1, ... in a fixed order; a table of lists, not of rows."""
    order = Window.orderBy("branch", "centroid")
    return centroids.select((F.row_number().over(order) - 1).cast("long").alias("list_id"), "centroid")


def assign_nearest(rows: DataFrame, centroids: DataFrame, id_col: str, vec_col: str, metric: str) -> DataFrame:
    """(<id>, list_id, <vec>, centroid_distance) of usable rows: the nearest centroid, ties to the smaller id.

    Map-side with the centroids broadcast while they fit ``DEFAULT_BROADCAST_BYTES``; beyond that by the blocked exact search."""
    rows = rows.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).where(_usable(vec_col, metric))
    known = _matrix_broadcast(centroids)
    if known is None:
        near = knn(centroids.select("list_id", F.col("centroid").alias("embedding")), rows.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("embedding")),
                   1, "cosine" if metric == "cosine" else "euclidean", base_id="list_id", strategy="block")
        near = near.select(F.col("query_id").alias(id_col), F.col("neighbor_id").alias("list_id"),
                           (F.sqrt(2 * F.col("distance")) if metric == "cosine" else F.col("distance")).alias("centroid_distance"))
        return rows.join(near, id_col).select(id_col, "list_id", vec_col, "centroid_distance")
    ids, mat = known
    shared = rows.sparkSession.sparkContext.broadcast((ids, mat))
    kind = "cosine" if metric == "cosine" else "euclidean"

    def run(batches):
        ids_, mat_ = shared.value
        for batch in (b.slice(lo, SLICE_ROWS) for b in batches for lo in range(0, b.num_rows, SLICE_ROWS)):
            # queries of the kernel are the rows, its base the centroids
            kern = _Kernel(_vec_matrix(batch.column(vec_col), mat_.shape[1]), kind, 1, np.int64)
            kern.add(ids_, mat_)
            qrow, near, dist, _ = kern.result()
            gap = np.sqrt(2.0 * dist) if kind == "cosine" else dist
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(qrow)), pa.array(near), batch.column(vec_col).take(pa.array(qrow)), pa.array(gap)],
                                             names=[id_col, "list_id", vec_col, "centroid_distance"])
        release()

    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, list_id long, `{vec_col}` array<double>, centroid_distance double"
    return rows.mapInArrow(run, schema)


def learn_centroids(rows: DataFrame, id_col: str, vec_col: str, metric: str, num_lists: int, n: int, seed: int = 42, max_iter: int = 10,
                    train_per_list: int = DEFAULT_TRAIN_PER_LIST) -> DataFrame:
    """(list_id, centroid): ``num_lists`` centroids at most, learnt on samples by the hash of the id.

    One group up to ``FLAT_LISTS`` lists; beyond, the first level's branches are clustered each in a group of its own,
    with lists in proportion to its rows.  No group holds more than about ``TRAIN_BYTES`` of vectors."""
    dim = len(rows.select(vec_col).first()[0])
    most = max(256, TRAIN_BYTES // (8 * dim))

    def sample(df, wanted, total):
        share = min(1.0, wanted / max(total, 1))
        return df.where(F.col("_h") <= F.lit(int(share * (1 << 62))))

    points = rows.select(_hashed(id_col, seed), F.col(vec_col).alias("_vec"))
    top = num_lists if num_lists <= FLAT_LISTS else math.ceil(math.sqrt(num_lists))
    first = sample(points, min(most, train_per_list * top), n).select(F.lit(0).cast("long").alias("branch"), F.lit(top).cast("long").alias("leaves"), "_h", "_vec")
    level = _numbered(_fit_groups(first, metric, seed, max_iter))
    if top == num_lists:
        return level
    train = sample(points, train_per_list * num_lists, n).withColumn("_id", F.monotonically_increasing_id())
    branched = assign_nearest(train.select(F.struct("_h").alias("_id"), "_vec"), level, "_id", "_vec", metric).select(
        F.col("list_id").alias("branch"), F.col("_id._h").alias("_h"), "_vec")
    from vectriage.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    branched = branched.checkpoint()
    sizes = branched.groupBy("branch").agg(F.count(F.lit(1)).alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"))
    # one row per branch, at most ceil(sqrt(num_lists)) of them
    plan = F.broadcast(sizes.join(whole).select("branch", F.greatest(F.lit(1), F.round(F.col("_n") * num_lists / F.col("_all"))).cast("long").alias("leaves"),
                                                F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")).alias("_share")))
    chosen = branched.join(plan, "branch").where(F.rand(seed) < F.lit(2.0)) if False else branched.join(plan, "branch")
    span = min(1.0, train_per_list * num_lists / max(n, 1)) * (1 << 62)
    chosen = chosen.where(F.col("_h") <= F.col("_share") * F.lit(span)).select("branch", "leaves", "_h", "_vec")
    return _numbered(_fit_groups(chosen, metric, seed, max_iter))


def _split_leaves(points: np.ndarray, limit: int, metric: str, seed: int) -> np.ndarray:
    """Leaf numbers of the points of one group, by bisection until no leaf has over ``limit``; equal points are cut by order."""
    leaf = np.zeros(len(points), np.int64)
    todo, done = [np.arange(len(points))], 0
    while todo:
        part = todo.pop()
        if len(part) <= limit:
            leaf[part], done = done, done + 1
            continue
        c = cluster(points[part], 2, metric, seed)
        side = _squared(points[part], c).argmin(1) if len(c) == 2 else np.zeros(len(part), np.int64)
        halves = [part[side == 0], part[side == 1]]
        if not all(map(len, halves)):
            halves = [part[:len(part) // 2], part[len(part) // 2:]]
        todo += halves[::-1]
    return leaf


def tree_rows(rows: DataFrame, id_col: str, vec_col: str, metric: str, max_leaf_size: int, seed: int = 42, max_iter: int = 10,
              fanout: int = 16, group_rows: int | None = None) -> DataFrame:
    """(<id>, _path, <vec>): the leaf of every row, no leaf above ``max_leaf_size`` rows.

    Level by level: a branch too large for one group is split ``fanout`` ways around centroids learnt on its rows of the
    smallest id hashes; one that fits a group is bisected to its leaves there."""
    from vectriage.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    dim = len(rows.select(vec_col).first()[0])
    group = group_rows or max(max_leaf_size, TRAIN_BYTES // (8 * dim))
    id_type = rows.schema[id_col].dataType.simpleString()
    level = rows.select(id_col, vec_col, _hashed(id_col, seed), F.lit("").alias("_path"))
    depth = 0
    while True:
        sizes = level.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
        big = sizes.where(F.col("_n") > group)
        if big.isEmpty():
            break
        large = level.join(F.broadcast(big), "_path")
        learn = large.where(F.col("_h") <= F.lit(float(1 << 62)) * F.least(F.lit(1.0), F.lit(float(group) / 2) / F.col("_n")))
        ids = F.xxhash64("_path").alias("branch")
        cents = _fit_groups(learn.select(ids, F.lit(fanout).cast("long").alias("leaves"), "_h", F.col(vec_col).alias("_vec")), metric, seed + depth, max_iter).checkpoint()
        salts = F.ceil(F.col("_n") / F.lit(group)).cast("long")
        dealt = large.select(ids, F.pmod(F.xxhash64(id_col), salts).alias("_salt"), id_col, vec_col, "_h", "_path")
        copies = cents.join(F.broadcast(big.select(F.xxhash64("_path").alias("branch"), salts.alias("_salts"))), "branch").select(
            "branch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"), "centroid")

        def place(pts: pa.Table, cen: pa.Table) -> pa.Table:
            c = _vec_matrix(cen.column("centroid"), dim)
            c = c[np.lexsort(c.T[::-1])]
            x = _points(_vec_matrix(pts.column(vec_col), dim), metric)
            near = _squared(x, c).argmin(1)
            if len(c) < 2:                      # equal points: by hash
                near = pts.column("_h").to_numpy() % fanout
            path = pa.array([f"{p}{chr(97 + int(b))}" for p, b in zip(pts.column("_path").to_pylist(), near)], pa.string())
            return pa.table({id_col: pts.column(id_col), vec_col: pts.column(vec_col), "_h": pts.column("_h"), "_path": path})

        schema = f"`{id_col}` {id_type}, `{vec_col}` array<double>, _h long, _path string"
        split = dealt.groupBy("branch", "_salt").cogroup(copies.groupBy("branch", "_salt")).applyInArrow(place, schema)
        level = level.join(F.broadcast(big), "_path", "left_anti").select(id_col, vec_col, "_h", "_path").unionByName(split).checkpoint()
        depth += 1

    def finish(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("_h").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        leaf = _split_leaves(_points(_vec_matrix(t.column(vec_col), dim), metric), max_leaf_size, metric, seed)
        path = pa.array([f"{p}/{n:09d}" for p, n in zip(t.column("_path").to_pylist(), leaf.tolist())], pa.string())
        return pa.table({id_col: t.column(id_col), vec_col: t.column(vec_col), "_path": path})

    return level.groupBy("_path").applyInArrow(finish, f"`{id_col}` {id_type}, `{vec_col}` array<double>, _path string")


def _tree(rows: DataFrame, id_col: str, vec_col: str, metric: str, max_leaf_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(centroids, rows with list_id and centroid_distance) of a tree."""
    leaves = tree_rows(rows, id_col, vec_col, metric, max_leaf_size, seed).checkpoint()

    def mean(t: pa.Table) -> pa.Table:          # a leaf has at most max_leaf_size rows
        x = _points(_vec_matrix(t.column(vec_col), len(t.column(vec_col)[0].as_py())), metric)
        c = x[np.lexsort(x.T[::-1])].mean(0)
        size = float(np.sqrt(c @ c))
        c = c / size if metric == "cosine" and size > 0 else c
        gap = np.sqrt(np.einsum("ij,ij->i", x - c, x - c))
        n = t.num_rows
        return pa.table({id_col: t.column(id_col), vec_col: t.column(vec_col), "_path": t.column("_path"),
                         "centroid": pa.array([c.tolist()] * n, pa.list_(pa.float64())), "centroid_distance": pa.array(gap)})

    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, `{vec_col}` array<double>, _path string, centroid array<double>, centroid_distance double"
    placed = leaves.groupBy("_path").applyInArrow(mean, schema).checkpoint()
    # one row per leaf
    lists = placed.groupBy("_path").agg(F.first("centroid").alias("centroid")).select(
        (F.row_number().over(Window.orderBy("_path")) - 1).cast("long").alias("list_id"), "_path", "centroid")
    return lists.select("list_id", "centroid"), placed.drop("centroid").join(lists.select("_path", "list_id"), "_path").select(
        id_col, "list_id", vec_col, "centroid_distance")


def build_ivf(base: DataFrame, id_col: str = "id", vec_col: str = "embedding", num_lists: int | None = None,
              metric: str = "cosine", method: str = "kmeans", max_leaf_size: int = 100, seed: int = 42,
              max_iter: int = 10, train_per_list: int | None = None, centroids: DataFrame | None = None) -> IVFIndex:
    """Learn the lists and assign every row with a usable vector to one of them.

    ``centroids(list_id, centroid)`` takes the caller's lists instead.  The number of lists is ``num_lists`` or, by default,
    ``ceil(sqrt(rows))``; a tree has as many as its leaves.  ``train_per_list`` (256) rows a list, chosen by the hash of
    their id, learn the centroids; rows that cannot be searched (null, not finite, zero for cosine) are in no list.
    """
    from vectriage.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(base.sparkSession)
    metric = metric.lower()
    rows = base.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).where(_usable(vec_col, metric))
    if centroids is not None:
        length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
        unit = F.transform("centroid", lambda x: x / length) if metric == "cosine" else F.col("centroid")
        cents = centroids.select(F.col("list_id").cast("long").alias("list_id"), F.col("centroid").cast("array<double>").alias("centroid"))
        cents = cents.select("list_id", unit.alias("centroid")).checkpoint()
        assigned = assign_nearest(rows, cents, id_col, vec_col, metric)
    elif method == "kmeans":
        n = rows.count()
        if n == 0:
            raise ValueError("no vectors to index")
        k = min(num_lists or max(1, math.ceil(math.sqrt(n))), n)
        cents = learn_centroids(rows, id_col, vec_col, metric, k, n, seed, max_iter, train_per_list or DEFAULT_TRAIN_PER_LIST).checkpoint()
        assigned = assign_nearest(rows, cents, id_col, vec_col, metric)
    elif method == "tree":
        if rows.isEmpty():
            raise ValueError("no vectors to index")
        cents, assigned = _tree(rows, id_col, vec_col, metric, max_leaf_size, seed)
        cents = cents.checkpoint()
    else:
        raise ValueError("method must be 'kmeans' or 'tree'")
    return IVFIndex(cents, assigned, id_col, vec_col, metric, cents.count())


def list_table(rows: DataFrame) -> DataFrame:
    """(list_id, n_rows, radius): counted rows and the largest distance from the centroid."""
    radius = F.max("centroid_distance") if "centroid_distance" in rows.columns else F.lit(None).cast("double")
    return rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"), radius.alias("radius"))


def save_ivf(index: IVFIndex, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``{path}/rows`` partitioned by list_id, ``{path}/centroids`` and ``{path}/lists``.

    Rows are shuffled on (list_id, salt) before the write, so each list lands in a few files instead of one file per
    list per input task; the salt splits a large list over ``ceil(size / rows_per_file)`` writers."""
    from vectriage.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(index.rows.sparkSession)
    rows = index.rows if index.path else index.rows.checkpoint()     # counted, then written: assigned once
    known = list_table(rows)
    sizes = F.broadcast(known.select(
        "list_id", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(rows_per_file))).alias("_salts")))
    (rows.join(sizes, "list_id")
         .withColumn("_salt", F.pmod(F.xxhash64(index.id_col), F.col("_salts")))
         .repartition("list_id", "_salt").drop("_salt", "_salts")
         .write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows"))
    index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    known.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def load_ivf(spark, path: str, id_col: str, vec_col: str = "embedding", metric: str = "cosine") -> IVFIndex:
    cents = spark.read.parquet(f"{path}/centroids")
    files = spark.read.parquet(f"{path}/rows")
    # the partition column would come back with an inferred type, and a cast hides it from partition pruning: name it
    schema = T.StructType([f for f in files.schema.fields if f.name != "list_id"] + [T.StructField("list_id", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/lists")
    return IVFIndex(cents, rows, id_col, vec_col, metric, cents.count(), sizes, path=path)


def assign_lists(index: IVFIndex, new_rows: DataFrame) -> DataFrame:
    """List ids for appended rows from the stored centroids (no refit).  Rows that cannot be searched keep a null list."""
    near = assign_nearest(new_rows, index.centroids, index.id_col, index.vec_col, index.metric).select(index.id_col, "list_id")
    return new_rows.join(near, index.id_col, "left").select(index.id_col, "list_id", index.vec_col)


def list_sizes(index: IVFIndex) -> DataFrame:
    return index.rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows"))


def probe_lists(index: IVFIndex, queries: DataFrame, nprobe: int, metric: str, k: int = 0, counts: dict[int, int] | None = None) -> DataFrame:
    """(query_id, neighbor_id: the list, rank, gap) of ``queries(query_id, _vec)``: the ``nprobe`` nearest lists by ``metric``.

    ``counts`` (rows of each list that a search may return) sends a query on to as many of its nearest lists as hold ``k`` rows,
    and leaves lists without rows out.  ``gap`` is the distance from the centroid (null for dot products).  The centroids are
    broadcast while they fit ``DEFAULT_BROADCAST_BYTES``; beyond that the lists are found by the blocked exact search."""
    known = _matrix_broadcast(index.centroids)
    qtype = _field_type(queries, "query_id")
    if known is None:
        near = knn(index.centroids.select("list_id", F.col("centroid").alias("embedding")), queries.select("query_id", F.col("_vec").alias("embedding")),
                   index.num_lists if counts is not None else nprobe, metric, base_id="list_id", strategy="block")
        gap = F.sqrt(2 * F.col("distance")) if metric == "cosine" else F.col("distance") if metric == "euclidean" else F.lit(None).cast("double")
        near = near.withColumn("gap", gap)
        if counts is None:
            return near.select("query_id", "neighbor_id", "rank", "gap")
        held = F.broadcast(queries.sparkSession.createDataFrame(list(counts.items()), "neighbor_id long, _n long"))     # num_lists rows
        before = F.sum("_n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        near = near.join(held, "neighbor_id").withColumn("_before", F.coalesce(before, F.lit(0)))
        return near.where((F.col("rank") <= nprobe) | (F.col("_before") < k)).select("query_id", "neighbor_id", "rank", "gap")
    ranked = _ranker(queries, known, nprobe, metric, k, counts)
    schema = T.StructType([T.StructField("query_id", qtype), T.StructField("neighbor_id", T.LongType()), T.StructField("rank", T.LongType()),
                           T.StructField("gap", T.DoubleType())])

    def run(batches):
        for batch, qrow, near, rank, dist in ranked(batches):
            gap = pa.array(np.sqrt(2.0 * dist) if metric == "cosine" else dist) if metric != "dot" else pa.nulls(len(dist), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(qrow)), pa.array(near), pa.array(rank), gap],
                                             names=["query_id", "neighbor_id", "rank", "gap"])
        release()

    return queries.select("query_id", "_vec").mapInArrow(run, schema)


def _ranker(queries: DataFrame, known, nprobe: int, metric: str, k: int, counts: dict[int, int] | None):
    """Function over batches (query_id, _vec): (slice, query row, list, rank, distance) of the lists that ``probe_lists`` names."""
    ids, mat = known
    held = None if counts is None else np.array([counts.get(int(i), 0) for i in ids], np.int64)
    shared = queries.sparkSession.sparkContext.broadcast((ids, mat, held))
    most = len(ids) if held is not None else nprobe
    step = max(1, min(SLICE_ROWS, SLICE_PROBES // max(1, most)))

    def ranked(batches):
        ids_, mat_, held_ = shared.value
        if not len(ids_):
            return
        place = {int(i): p for p, i in enumerate(ids_)}
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            q = batch.column("_vec")
            if (np.diff(q.offsets.to_numpy()) != mat_.shape[1]).any():
                raise ValueError(f"query vectors are not {mat_.shape[1]} wide")
            kern = _Kernel(_vec_matrix(q, mat_.shape[1]), metric, most, np.int64)
            kern.add(ids_, mat_)
            qrow, near, dist, _ = kern.result()
            start = np.searchsorted(qrow, qrow)
            rank = (np.arange(len(qrow)) - start + 1).astype(np.int64)
            if held_ is not None:
                n = held_[[place[int(i)] for i in near]] if len(near) else np.zeros(0, np.int64)
                total = np.r_[0, np.cumsum(n)]
                keep = ((rank <= nprobe) | (total[:-1] - total[start] < k)) & (n > 0)
                qrow, near, rank, dist = qrow[keep], near[keep], rank[keep], dist[keep]
            yield batch, qrow, near, rank, dist

    return ranked


def bundle_lists(counted: dict[int, int], most: int, parts: int) -> dict[int, tuple[int, int]]:
    """Lists (with their rows) in bundles of neighbouring ids: {list: (first list of its bundle, blocks of the bundle)}.

    A bundle has at most ``most`` rows, or is one larger list in blocks; there are about ``parts`` bundles at least."""
    total = sum(counted.values())
    share = max(1, min(most, math.ceil(total / max(1, parts))))
    out, lists, n = {}, [], 0

    def close():
        for i in lists:
            out[i] = (lists[0], max(1, math.ceil(n / most)))

    for i in sorted(counted):
        if lists and n + counted[i] > share:
            close()
            lists, n = [], 0
        lists.append(i)
        n += counted[i]
    close()
    return out


def _packed_probes(index: IVFIndex, q: DataFrame, known, nprobe: int, metric: str, k: int, counts: dict[int, int] | None):
    """Function of the bundles: (query_id, list_id: the bundle, _lists: the probed lists in it, _vec), made where the lists are ranked."""
    qtype = _field_type(q, "query_id")
    ranked = _ranker(q, known, nprobe, metric, k, counts)

    def packed(bundles: dict[int, tuple[int, int]]) -> DataFrame:
        shared = q.sparkSession.sparkContext.broadcast({i: b for i, (b, _) in bundles.items()})

        def run(batches):
            for batch, qrow, near, _, _ in ranked(batches):
                home = np.array([shared.value.get(int(i), -1) for i in near], np.int64)
                qrow, near, home = qrow[home >= 0], near[home >= 0], home[home >= 0]
                order = np.lexsort((near, home, qrow))
                qrow, near, home = qrow[order], near[order], home[order]
                first = np.flatnonzero(np.r_[True, (np.diff(qrow) != 0) | (np.diff(home) != 0)][:len(qrow)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(qrow)].astype(np.int32)), pa.array(near))
                at = pa.array(qrow[first])
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), pa.array(home[first]), lists, batch.column("_vec").take(at)],
                                                 names=["query_id", "list_id", "_lists", "_vec"])
            release()

        schema = T.StructType([T.StructField("query_id", qtype), T.StructField("list_id", T.LongType()), T.StructField("_lists", T.ArrayType(T.LongType())),
                               T.StructField("_vec", T.ArrayType(T.DoubleType()))])
        return q.select("query_id", "_vec").mapInArrow(run, schema)

    return packed


def ivf_search(index: IVFIndex, queries: DataFrame, k: int = 10, fraction: float = 0.1, *,
               query_id: str = "query_id", query_vec: str = "embedding", metric: str | None = None,
               max_block_rows: int | None = None, max_query_rows: int = DEFAULT_MAX_QUERY_ROWS, block_bytes: int = DEFAULT_BLOCK_BYTES,
               filters=None, widen: bool = True, bound: bool = False) -> DataFrame:
    """Approximate top-k (exact distances within the probed lists).

    Returns ``query_id, neighbor_id, rank, distance`` like ``knn``.  ``filters`` (a Column on the base rows) is applied
    before the search; then, and for a ``restrict``-ed index, a query probes further lists until those it probes hold k
    rows (not with ``widen=False``).  ``bound`` searches the nearest list first and skips lists that cannot come closer;
    the result is the same.  Another metric than the index's raises.
    """
    metric = (metric or index.metric).lower()
    if metric != index.metric:
        raise ValueError(f"the index is for {index.metric!r}, not {metric!r}")
    nprobe = max(1, min(index.num_lists, math.ceil(fraction * index.num_lists)))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_vec")).where(_usable("_vec", metric))
    rows = index.rows if filters is None else index.rows.where(filters)
    filtered = filters is not None or index.restricted
    counts = None
    if filtered and widen:
        # one row per list
        counts = {r["list_id"]: r["n"] for r in rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = rows.select(F.col(index.id_col).alias("_id"), "list_id", F.col(index.vec_col).cast("array<double>").alias("_vec"))
    stored = index.sizes is not None and not filtered
    types = _field_type(queries, query_id), _field_type(index.rows, index.id_col)
    if max_block_rows is None:
        first = index.centroids.first()
        max_block_rows = max(1, block_bytes // (8 * max(1, len(first["centroid"]) if first else 1)))
    args = (index, q, rows, stored, max_block_rows, max_query_rows, metric, k, *types)
    if bound and metric != "dot" and index.sizes is not None and "radius" in index.sizes.columns:
        cand = _bounded(probe_lists(index, q, nprobe, metric, k, counts), *args)
    elif nprobe == index.num_lists:
        cand = _candidates(None, *args)
    else:
        known = _matrix_broadcast(index.centroids)
        probes = (probe_lists(index, q, nprobe, metric, k, counts).select("query_id", "neighbor_id") if known is None
                  else _packed_probes(index, q, known, nprobe, metric, k, counts))
        cand = _candidates(probes, *args)
    w = Window.partitionBy("query_id").orderBy("dkey", "neighbor_id")
    res = (cand.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
               .select("query_id", "neighbor_id", "rank", "distance"))
    return res if query_id == "query_id" else res.withColumnRenamed("query_id", query_id)


def _bounded(probes, index, q, rows, stored, max_block_rows, max_query_rows, metric, k, qtype, btype):
    """Candidates of the nearest list, then of those others that can hold a row nearer than the k-th found."""
    args = (index, q, rows, stored, max_block_rows, max_query_rows, metric, k, qtype, btype)
    near = _candidates(probes.where("rank = 1").select("query_id", "neighbor_id"), *args)
    w = Window.partitionBy("query_id").orderBy("dkey", "neighbor_id")
    kth = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
    far = F.sqrt(2 * F.col("distance")) if metric == "cosine" else F.col("distance")
    kth = kth.select("query_id", (far + F.lit(1e-6)).alias("_far"))          # beyond rounding of either distance
    radius = F.broadcast(index.sizes.select(F.col("list_id").alias("neighbor_id"), "radius"))      # num_lists rows
    rest = (probes.where("rank > 1").join(radius, "neighbor_id").join(kth, "query_id", "left")
            .where(F.col("_far").isNull() | F.col("radius").isNull() | (F.col("gap") - F.col("radius") <= F.col("_far"))))
    return near.unionByName(_candidates(rest.select("query_id", "neighbor_id"), *args))


def _blocked(index, probes, q, rows, stored_sizes, max_block_rows, max_query_rows):
    """(queries, rows), both on (list_id, _block, _qblock): each probe meets each row of its list once.

    ``list_id`` is the first list of a bundle; ``_lists`` are a query's own ones in it (null: all), ``_list`` is a row's.
    ``probes``: rows (query_id, neighbor_id), a function of the bundles (``_packed_probes``), or None for every list."""
    spark = rows.sparkSession
    q = q.where(F.col("query_id").isNotNull())
    # list sizes only set the bundles and blocks (balance, not results): use the
    # counted sizes when there is no filter, else count the filtered rows; one row per list
    sized = (index.sizes.select("list_id", F.col("n_rows").alias("_n")) if stored_sizes and index.sizes is not None
             else rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("_n")))
    counted = {r["list_id"]: r["_n"] for r in sized.where("list_id >= 0").collect()}
    parts, _ = grid(spark, sum(counted.values()), max_block_rows)
    bundles = bundle_lists(counted, max_block_rows, parts)
    asked = max(1, math.ceil(q.count() / max_query_rows), grid(spark, sum(counted.values()), max_block_rows)[1])
    known = F.broadcast(spark.createDataFrame([(i, b, n) for i, (b, n) in bundles.items()], "list_id long, _bundle long, _blocks long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    firsts = F.broadcast(known.where("list_id = _bundle").select(F.col("_bundle").alias("list_id"), "_blocks"))
    if probes is None:
        asks = q.join(firsts.withColumnRenamed("list_id", "_first")).select(
            F.col("query_id").alias("_id"), F.col("_first").alias("list_id"), F.lit(None).cast("array<long>").alias("_lists"), "_vec", "_blocks")
    else:
        if callable(probes):
            packed = probes(bundles)
            probed = packed.select(F.explode("_lists").alias("list_id"))
        else:
            probed = probes.select(F.col("neighbor_id").alias("list_id"))
            packed = (probes.select("query_id", F.col("neighbor_id").alias("list_id")).join(known, "list_id")
                      .groupBy("query_id", "_bundle").agg(F.collect_set("list_id").alias("_lists"))
                      .join(q, "query_id").select("query_id", F.col("_bundle").alias("list_id"), "_lists", "_vec"))
        # at most num_lists ids; the comparison lets Spark take them as a filter on the list folders
        rows = rows.join(F.broadcast(probed.groupBy("list_id").agg(F.count(F.lit(1)).alias("_q")).where("list_id >= 0")), "list_id", "left_semi")
        asks = packed.where("query_id is not null").join(firsts, "list_id").select(F.col("query_id").alias("_id"), "list_id", "_lists", "_vec", "_blocks")
    met = (rows.join(known, "list_id").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
               .withColumn("_qblock", every(F.lit(asked).cast("long"))).withColumnRenamed("list_id", "_list").withColumnRenamed("_bundle", "list_id").drop("_blocks"))
    asks = asks.withColumn("_qblock", F.pmod(F.xxhash64("_id"), F.lit(asked))).withColumn("_block", every(F.col("_blocks"))).drop("_blocks")
    return asks, met


def _repeated(batches, ids):
    """Candidates as often as their query's id occurs among the queries of the group."""
    times = None
    if len(set(ids)) < len(ids):
        times = {}
        for i in ids:
            times[i] = times.get(i, 0) + 1
    for batch in batches:
        if times:
            n = np.array([times[i] for i in batch.column("query_id").to_pylist()], np.int64)
            batch = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
        yield batch


def _candidates(probes, index, q, rows, stored, max_block_rows, max_query_rows, metric, k, qtype, btype):
    """Top-k candidates of every (bundle of lists, block, query block) that the probes name."""
    pq, rows = _blocked(index, probes, q, rows, stored, max_block_rows, max_query_rows)
    schema = _out_schema(qtype, btype)

    def run(qt: pa.Table, bt: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or bt.num_rows == 0:
            return pa.Table.from_batches([], schema=_arrow_schema(qtype, btype))
        dim = len(qt.column("_vec")[0].as_py())
        qids = np.asarray(qt.column("_id").to_pylist(), dtype=object)
        Q, B = _vec_matrix(qt.column("_vec"), dim), _vec_matrix(bt.column("_vec"), dim)
        ids, wanted = _id_array(bt.column("_id").combine_chunks(), btype), None
        if qt.column("_lists").null_count:          # all lists of the bundle
            pieces = [lambda i=i: (ids[i:i + PIECE_ROWS], B[i:i + PIECE_ROWS]) for i in range(0, len(ids), PIECE_ROWS)]
        else:
            home = bt.column("_list").to_numpy()
            order = np.argsort(home, kind="stable")
            lists, first = np.unique(home[order], return_index=True)
            ends = np.r_[first[1:], len(order)]
            spans = [(p, order[i:min(i + PIECE_ROWS, e)]) for p, (f, e) in enumerate(zip(first.tolist(), ends.tolist())) for i in range(f, e, PIECE_ROWS)]
            pieces = [lambda at=at: (ids[at], B[at]) for _, at in spans]
            named = qt.column("_lists").combine_chunks()
            asker = np.repeat(np.arange(len(qids)), np.diff(named.offsets.to_numpy()))
            asked = named.flatten().to_numpy()
            by = np.lexsort((asker, asked))
            asker, asked = asker[by], asked[by]

            def wanted(piece, lo, hi):
                a, b = np.searchsorted(asked, [lists[spans[piece][0]], lists[spans[piece][0]] + 1])
                own = asker[a:b]
                return own[np.searchsorted(own, lo):np.searchsorted(own, hi)] - lo

        out = pa.Table.from_batches(_repeated(meet(qids, Q, pieces, metric, k, qtype, btype, wanted), qids.tolist()), schema=_arrow_schema(qtype, btype))
        del Q, B, pieces
        release()
        return out

    on = ["list_id", "_block", "_qblock"]
    return pq.groupBy(*on).cogroup(rows.groupBy(*on)).applyInArrow(run, schema)


def recall_at_k(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Per query: |approx ∩ exact| / |exact| over (query_id, neighbor_id)."""
    e = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    hit = (exact.select("query_id", "neighbor_id").join(approx.select("query_id", "neighbor_id"),
                                                          ["query_id", "neighbor_id"])
                .groupBy("query_id").agg(F.count(F.lit(1)).alias("_hit")))
    return (e.join(hit, "query_id", "left")
             .select("query_id", (F.coalesce("_hit", F.lit(0)) / F.col("_n")).alias("recall")))


def index_coverage(index: IVFIndex, base: DataFrame) -> DataFrame:
    """Rows of the base with a vector, rows in the index, coverage percent."""
    b = base.where(F.col(index.vec_col).isNotNull()).select(index.id_col)
    idx = index.rows.select(index.id_col).withColumn("_in", F.lit(1))
    j = b.join(idx, index.id_col, "left")
    return (j.agg(F.count(F.lit(1)).alias("base_rows"), F.count("_in").alias("indexed_rows"))
             .withColumn("coverage_pct", F.when(F.col("base_rows") > 0, round_half_away(
                 F.col("indexed_rows") * F.lit(100.0) / F.col("base_rows"), 2))))
