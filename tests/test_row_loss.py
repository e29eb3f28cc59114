"""Vectors and keys that earlier versions lost, crashed on or updated wrongly."""

import pytest

from vectriage.operators.ivf import build_ivf
from vectriage.operators.knn import knn
from vectriage.operators.triage import triage
from vectriage.sources.sinks import merge_matched
from vectriage.streaming.incremental import rows_to_embed

NAN = float("nan")
BAD = [(90, [NAN, 1.0, 0.0]), (91, [float("inf"), 0.0, 0.0]), (92, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [1.0 + i, float(i % 3), 0.5]) for i in range(20)]
    return spark.createDataFrame(rows + BAD, "id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("strategy", ["broadcast", "block"])
def test_bad_vectors_cost_only_themselves(vectors, metric, strategy):
    queries = vectors.where("id < 3").withColumnRenamed("id", "query_id")
    got = sorted(map(tuple, knn(vectors, queries, 5, metric, strategy=strategy).collect()))
    want = sorted(map(tuple, knn(vectors.where("id < 50"), queries, 5, metric, strategy=strategy).collect()))
    assert got == want and len(got) == 15


def test_mixed_query_widths_raise(spark, vectors):
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0])], "query_id long, embedding array<double>")
    with pytest.raises(ValueError, match="widths"):
        knn(vectors, queries, 3)
    assert knn(vectors, queries, 3, dim=3).count() == 3


def test_index_build_leaves_out_unusable_vectors(spark, vectors):
    zero = spark.createDataFrame([(99, [0.0, 0.0, 0.0])], vectors.schema)
    index = build_ivf(vectors.union(zero), num_lists=3)
    assert {r.id for r in index.rows.select("id").collect()} == set(range(20))


def test_triage_takes_string_ids(spark):
    rows = [(f"TKT-{i}", f"t{i}", "cat", "high", "resolved", "fix", 5, 1.0, [1.0, i / 10]) for i in range(8)]
    base = spark.createDataFrame(rows, "ticket_id string, title string, category string, priority string, status string, resolution string, "
                                       "satisfaction_score int, resolution_time_hours double, embedding array<double>")
    queries = spark.createDataFrame([("Q-1", [1.0, 0.2]), ("Q-2", None)], "query_id string, embedding array<double>")
    out = {r.query_id: r for r in triage(base, queries).collect()}
    assert out["Q-1"].similar_tickets[0].ticket_id == "TKT-2" and out["Q-1"].solution == "fix"
    assert out["Q-2"].similar_tickets == [] and out["Q-2"].error


def test_merge_applies_nulls_and_rejects_duplicate_keys(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    source = spark.createDataFrame([(1, None), (3, "z")], "k long, v string")
    assert sorted(map(tuple, merge_matched(target, source, "k", ["v"]).collect())) == [(1, None), (2, "b")]
    with pytest.raises(Exception, match="duplicate source key"):
        merge_matched(target, source.union(source), "k", ["v"]).collect()


def test_null_texts_are_embedded_once(spark):
    source = spark.createDataFrame([(1, None), (2, "x")], "id long, text string")
    stored = rows_to_embed(source, spark.createDataFrame([], "id long, text_hash string"), "id", "text").select("id", "text_hash")
    assert stored.count() == 2 and rows_to_embed(source, stored, "id", "text").count() == 0


def test_every_order_is_a_ticket(spark):
    from conftest import SF_CHECK
    from vectriage.sources import tickets_fx

    orders = spark.read.parquet(f"{SF_CHECK}/orders.parquet")
    vectors = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    every, found = tickets_fx(spark, SF_CHECK, searchable=False), tickets_fx(spark, SF_CHECK)
    assert every.count() == orders.count() > found.count()
    assert every.where("category is null").count() == 0
    have = orders.join(vectors, orders.o_orderkey == vectors.vec_id, "left_semi").count()
    assert every.where("embedding is not null").count() == found.count() == have
