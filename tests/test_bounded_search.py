"""Searches of many queries: rows travel a bounded number of times, and a task's memory does not follow the number of queries, lists or texts."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vectriage.operators import ivf
from vectriage.operators import knn as knn_mod
from vectriage.operators.knn import knn


def vectors(spark, n=300, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)


def keyed(df):
    return sorted((r.query_id, r.neighbor_id, r.rank) for r in df.collect())


def few(spark):
    return math.ceil(math.sqrt(spark.sparkContext.defaultParallelism)) + 1


def test_blocks_do_not_multiply_the_queries(spark, monkeypatch):
    base = vectors(spark)
    q = base.withColumnRenamed("id", "query_id")
    dealt, real = [], type(base).mapInArrow

    def spy(self, *args, **kwargs):
        if "_group" in self.columns:
            dealt.append(self.count())
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(base), "mapInArrow", spy)
    got = knn(base, q, 4, base_id="id", strategy="block", block_bytes=6 * 8 * 5)       # 60 blocks of five rows
    assert dealt and dealt[0] <= 2 * 300 * few(spark)
    monkeypatch.undo()
    assert keyed(got) == keyed(knn(base, q, 4, base_id="id"))


def test_queries_are_broadcast_only_while_their_neighbours_fit_too(spark):
    base = vectors(spark)
    q = base.withColumnRenamed("id", "query_id")
    got = knn(base, q, 20, base_id="id", broadcast_bytes=300 * 6 * 8)                  # room for the matrix alone
    assert "_group" in got._jdf.queryExecution().executedPlan().toString()
    assert keyed(got) == keyed(knn(base, q, 20, base_id="id"))


def test_kernel_compares_named_queries_alone():
    rng = np.random.default_rng(1)
    Q, B = rng.normal(size=(40, 5)), rng.normal(size=(90, 5))
    for metric in ("cosine", "euclidean", "dot"):
        some, full = knn_mod._Kernel(Q, metric, 3, np.int64), knn_mod._Kernel(Q, metric, 3, np.int64)
        which = np.array([3, 8, 21])
        some.add(np.arange(90), B, which)
        full.add(np.arange(90), B)
        a, b = some.result(), full.result()
        own = np.isin(b[0], which)
        assert a[0].tolist() == b[0][own].tolist() and a[1].tolist() == b[1][own].tolist()


def test_a_query_goes_once_to_a_bundle_of_lists(spark):
    base = vectors(spark)
    q = base.withColumnRenamed("id", "query_id")
    idx = ivf.build_ivf(base, "id", num_lists=40)
    vec = q.select("query_id", F.col("embedding").alias("_vec"))
    rows = idx.rows.select(F.col("id").alias("_id"), "list_id", F.col("embedding").alias("_vec"))
    named = q.crossJoin(F.broadcast(idx.centroids)).select("query_id", F.col("list_id").alias("neighbor_id"))
    for probes in (named, None):
        asks, met = ivf._blocked(idx, probes, vec, rows, True, 10_000, 10_000)
        assert asks.count() <= 300 * 2 * few(spark) and met.select("_id").distinct().count() == 300
    assert keyed(ivf.ivf_search(idx, q, 5, fraction=1.0)) == keyed(knn(base, q, 5, base_id="id"))


def test_bundles_hold_every_list():
    counted = {3: 10, 5: 500, 6: 20, 9: 30, 11: 1}
    got = ivf.bundle_lists(counted, 100, 2)
    assert set(got) == set(counted) and got[5] == (5, 5)
    held = {}
    for i, (first, blocks) in got.items():
        held[first] = held.get(first, 0) + counted[i]
        assert held[first] <= 100 * blocks
    assert ivf.bundle_lists({}, 100, 2) == {}


def test_lists_are_ranked_a_bounded_number_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cents = rng.normal(size=(50, 4))
    monkeypatch.setattr(ivf, "SLICE_PROBES", 500)
    q = spark.createDataFrame([(0, [0.0] * 4)], "query_id long, _vec array<double>")
    ranked = ivf._ranker(q, (np.arange(50), cents), 50, "euclidean", 5, None)
    vecs = rng.normal(size=(95, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(95)), pa.array(vecs.tolist())], names=["query_id", "_vec"])
    seen = []
    for part, qrow, near, rank, _ in ranked([batch]):
        assert len(near) <= 500
        seen += list(zip(np.array(part.column("query_id"))[qrow].tolist(), rank.tolist(), near.tolist()))
    want = np.argsort(np.linalg.norm(vecs[:, None] - cents[None], axis=2), axis=1)
    assert sorted(seen) == [(i, r + 1, int(want[i, r])) for i in range(95) for r in range(50)]


def test_a_query_goes_once_to_a_bundle_of_rings(spark):
    from vectriage.operators.ring import ring_bundles
    base = vectors(spark, 400)
    q = base.withColumnRenamed("id", "query_id")
    asks, rows, _, _ = ring_bundles(base, q, 0.9)
    assert asks.count() <= 400 * 2 * few(spark)
    assert keyed(knn(base, q, 6, base_id="id", within=0.9, strategy="ring")) == keyed(knn(base, q, 6, base_id="id", within=0.9))


def test_texts_are_embedded_a_bounded_number_at_a_time(monkeypatch):
    from vectriage.functions import embed
    texts = pa.array([None, "", "a b c", "Straße x" * 50, "b b", None, "c d " * 30], pa.string())
    want = embed.hash_embed_arrow(texts, 16).to_pylist()
    sizes, real = [], embed._embed_slice

    def spy(part, dim, cache):
        sizes.append(sum(len((t or "").encode()) for t in part.to_pylist()) if len(part) > 1 else 0)
        return real(part, dim, cache)

    monkeypatch.setattr(embed, "_embed_slice", spy)
    monkeypatch.setattr(embed, "SLICE_BYTES", 40)
    monkeypatch.setattr(embed, "CACHED_TOKENS", 2)
    cache = {}
    assert embed.hash_embed_arrow(texts, 16, cache).to_pylist() == want
    assert len(sizes) > 2 and max(sizes) <= 40 and len(cache) <= 2
    assert embed.hash_embed_arrow(pa.array([], pa.string()), 16).to_pylist() == []


def test_streaming_triage_reads_a_folder_of_part_files(spark, tmp_path):
    from vectriage.plans.registry import QUERIES
    rng = np.random.default_rng(6)
    orders = [(i, i % 7, "FOP"[i % 3], 100.0 * i, dt.datetime(2001, 1, 1 + i % 28), "2-HIGH") for i in range(1, 41)]
    for name, files in (("one", 1), ("many", 5)):
        d = tmp_path / name
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
                              ).write.parquet(str(d / "orders.parquet"))
        vecs = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(1, 41)]
        spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label long").repartition(files).write.parquet(str(d / "embeddings.parquet"))
        got = QUERIES["streaming_triage"](spark, str(d)).collect()
        assert sorted(r.query_id for r in got) == list(range(1, 41))


def test_texts_without_a_partner_are_not_shuffled(spark, monkeypatch):
    from vectriage.llm import jaccard_join as jj
    plans, real = [], jj._packed_sets

    def spy(docs, n):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return real(docs, n)

    monkeypatch.setattr(jj, "_packed_sets", spy)
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "p q r s t"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jj.jaccard_join(docs, n=2, num=80, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert any("LeftSemi" in line and "broadcast" in line for plan in plans for line in plan.split("\n"))


def test_vectors_of_near_copies_are_gathered_a_bounded_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    near = rng.normal(size=8) + rng.normal(size=(300, 8)) * 1e-9         # the screen cannot tell them apart
    Q, B = near[:60], near[60:]
    gathered, real = [], knn_mod._Kernel._exact

    def spy(self, r, c, Bp, B):
        gathered.append(len(r))
        return real(self, r, c, Bp, B)

    for metric in ("cosine", "euclidean", "dot"):
        whole = knn_mod._Kernel(Q, metric, 4, np.int64)
        whole.add(np.arange(240), B)
        with monkeypatch.context() as m:
            m.setattr(knn_mod._Kernel, "_exact", spy)
            m.setattr(knn_mod, "TILE_BYTES", 16 * 8 * 50)                # vectors of fifty pairs
            some = knn_mod._Kernel(Q, metric, 4, np.int64)
            some.add(np.arange(240), B)
        assert gathered and max(gathered) <= 50
        assert [x.tolist() for x in some.result()] == [x.tolist() for x in whole.result()]


def test_only_k_of_equal_rows_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(5, 6))
    rows = [(int(i), vecs[i % 5 if i % 3 else 0].tolist()) for i in rng.permutation(200)] + [(7, vecs[2].tolist())]
    base = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    asked = [r for r in rows[:-1] if r[0] < 40]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    ids, mat = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    kept, left = knn_mod._without_spare_copies(ids, mat, 3)
    assert len(kept) == 15 and all((mat[ids == i] == v).all(axis=1).any() for i, v in zip(kept, left))
    for metric in ("cosine", "euclidean", "dot"):
        want = []
        for i, v in asked:
            a, b = np.array(v), mat
            d = {"cosine": 1 - b @ a / np.linalg.norm(b, axis=1) / np.linalg.norm(a), "euclidean": np.linalg.norm(b - a, axis=1), "dot": -(b @ a)}[metric]
            want += [(i, int(ids[j]), r + 1) for r, j in enumerate(np.lexsort((ids, np.round(np.maximum(d, 0.0) if metric == "cosine" else d, 9) + 0.0))[:3])]
        for strategy in ("broadcast", "block"):
            assert keyed(knn(base, q, 3, metric, base_id="id", strategy=strategy)) == sorted(want), (metric, strategy)


def test_a_task_of_a_search_of_all_tickets_holds_a_bounded_part(spark, tmp_path, monkeypatch):
    from vectriage.plans.registry import QUERIES
    rng = np.random.default_rng(8)
    held, frame = [], type(spark.range(1))
    real = frame.mapInArrow

    def spy(self, *args, **kwargs):
        if "_group" in self.columns:
            held.append(self.where("not _asks").groupBy("_group").count().agg(F.max("count")).first()[0])
        return real(self, *args, **kwargs)

    for n in (60, 200):
        d = tmp_path / str(n)
        # a quarter of an hour each: averages are exact in any order
        orders = [(i, i % 7, "FOP"[i % 3], 2500.0 * i, dt.datetime(2001, 1, 1 + i % 28), "2-HIGH") for i in range(1, n + 1)]
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
                              ).write.parquet(str(d / "orders.parquet"))
        vecs = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(1, n + 1)]
        spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label long").write.parquet(str(d / "embeddings.parquet"))
    for name in ("recommend_bands", "knn_cosine", "production_triage", "batch_triage", "multi_field_search", "knn_dot"):
        want = sorted(map(str, QUERIES[name](spark, str(tmp_path / "200")).collect()))
        with monkeypatch.context() as m:
            m.setattr(frame, "mapInArrow", spy)
            m.setattr(knn_mod, "DEFAULT_BLOCK_BYTES", 20 * 8 * 4)                       # parts of twenty rows
            m.setitem(knn_mod.knn_bounded.__kwdefaults__, "broadcast_bytes", 1)
            m.setitem(knn_mod.knn_bounded.__kwdefaults__, "block_bytes", 20 * 8 * 4)
            held.clear()
            QUERIES[name](spark, str(tmp_path / "60"))
            got = QUERIES[name](spark, str(tmp_path / "200"))
        assert sorted(map(str, got.collect())) == want, name
        assert len(held) == 2 and held[1] < 2 * held[0] and max(held) <= 2 * 20, (name, held)
