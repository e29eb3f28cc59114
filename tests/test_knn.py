import numpy as np
import pytest
from pyspark.sql import types as T

from vectriage.operators.knn import knn

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def brute(base, queries, k, metric):
    out = {}
    for qid, q in queries:
        rows = []
        for bid, b in base:
            if metric == "cosine":
                d = 1 - np.dot(q, b) / (np.linalg.norm(q) * np.linalg.norm(b))
                d = min(max(d, 0.0), 2.0)
            elif metric == "euclidean":
                d = float(np.sqrt(((np.array(q) - np.array(b)) ** 2).sum()))
            else:
                d = -float(np.dot(q, b))
            rows.append((round(d, 9) + 0.0, bid, d))
        rows.sort()
        out[qid] = [(bid, d) for _, bid, d in rows[:k]]
    return out


def _frames(spark, n=300, nq=17, dim=8, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    base = [(i, rng.normal(size=dim).tolist()) for i in range(n)]
    if dup:  # exact ties: equal vectors under different ids
        base += [(n + i, base[i][1]) for i in range(10)]
    queries = [(1000 + i, rng.normal(size=dim).tolist()) for i in range(nq)]
    return base, queries


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("strategy", ["broadcast", "block"])
def test_knn_matches_brute_force(spark, metric, strategy):
    base, queries = _frames(spark)
    bdf = spark.createDataFrame(base, SCHEMA).repartition(4)
    qdf = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "query_id")
    res = knn(bdf, qdf, 7, metric, base_id="id", strategy=strategy, block_bytes=2048)
    got = {}
    for r in res.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    exp = brute(base, queries, 7, metric)
    assert set(got) == set(exp)
    for q in exp:
        assert [b for b, _ in got[q]] == [b for b, _ in exp[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in exp[q]], atol=1e-12)


def test_knn_ties_use_id_and_self_first(spark):
    base, _ = _frames(spark, n=50)
    bdf = spark.createDataFrame(base, SCHEMA)
    # query = a duplicated vector: both copies at distance 0, smaller id first
    qdf = spark.createDataFrame([(7, base[3][1])], SCHEMA).withColumnRenamed("id", "query_id")
    rows = knn(bdf, qdf, 3, "cosine", base_id="id").orderBy("rank").collect()
    assert [r.neighbor_id for r in rows[:2]] == [3, 53]
    assert rows[0].distance == 0.0 and rows[1].distance == 0.0


def test_knn_skips_null_zero_and_wrong_width(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0, 1.0])]
    bdf = spark.createDataFrame(rows, SCHEMA)
    qdf = spark.createDataFrame([(9, [1.0, 0.1]), (10, None)], SCHEMA).withColumnRenamed("id", "query_id")
    res = knn(bdf, qdf, 10, "cosine", base_id="id").collect()
    assert sorted(r.neighbor_id for r in res) == [1, 4]
    assert {r.query_id for r in res} == {9}


def test_knn_string_ids_and_k_larger_than_base(spark):
    schema = "id string, embedding array<double>"
    bdf = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], schema)
    qdf = spark.createDataFrame([("q", [1.0, 0.0])], schema).withColumnRenamed("id", "query_id")
    res = knn(bdf, qdf, 5, "cosine", base_id="id").orderBy("rank").collect()
    assert [r.neighbor_id for r in res] == ["a", "b"]


def test_knn_no_queries(spark):
    bdf = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    qdf = spark.createDataFrame([], SCHEMA).withColumnRenamed("id", "query_id")
    assert knn(bdf, qdf, 3, base_id="id").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_kernel_streamed_batches_match_brute_force(metric):
    from vectriage.operators.knn import _Kernel
    rng = np.random.default_rng(7)
    B = rng.normal(size=(700, 5))
    B[350:360] = B[0:10]                      # exact duplicates in a later batch
    Q = np.vstack([rng.normal(size=(30, 5)), B[3:4]])
    ids = np.arange(700, dtype=np.int64)[::-1].copy()   # ids not in scan order
    kern = _Kernel(Q, metric, 6, np.int64)
    kern.max_buf = 50                          # force many merges
    for s in range(0, 700, 37):
        kern.add(ids[s:s + 37], B[s:s + 37])
    qrow, got_ids, dist, _ = kern.result()
    base = [(int(i), b.tolist()) for i, b in zip(ids, B)]
    exp = brute(base, [(q, Q[q].tolist()) for q in range(len(Q))], 6, metric)
    for q in range(len(Q)):
        assert list(got_ids[qrow == q]) == [b for b, _ in exp[q]]


def test_knn_many_small_batches(spark):
    base, queries = _frames(spark, n=400)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        bdf = spark.createDataFrame(base, SCHEMA).repartition(3)
        qdf = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "query_id")
        res = knn(bdf, qdf, 5, "cosine", base_id="id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    exp = brute(base, queries, 5, "cosine")
    assert got == {q: [b for b, _ in v] for q, v in exp.items()}


def test_keyword_vs_semantic_takes_all_words(spark):
    from vectriage.operators.search import keyword_vs_semantic
    base = spark.createDataFrame([(1, "The app app crashed", [1.0, 0.0]), (2, "an app to launch", [0.9, 0.1]),
                                  (3, "launch it", [0.0, 1.0])], "id long, text string, embedding array<double>")
    q = spark.createDataFrame([(7, "App won't launch, app!", [1.0, 0.0]), (8, "it", [0.0, 1.0]), (9, "", [1.0, 0.0])],
                              "query_id long, query_text string, embedding array<double>")
    got = {tuple(r) for r in keyword_vs_semantic(base, q, "id", "text", 2).collect()}
    assert got == {(7, 1, "app", 2, 2, 2), (7, 2, "won", 0, 2, 0), (7, 3, "t", 0, 2, 0), (7, 4, "launch", 2, 2, 1),
                   (8, 1, "it", 1, 2, 1), (9, 1, None, 0, 2, 0)}
