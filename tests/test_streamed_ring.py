"""The search under a cut of more rows than one task holds: blocks of both sides in the checkpoint folder, no vector sent twice."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.operators import ring
from vectriage.operators.blocks import kept, open_block
from vectriage.operators.knn import knn


def rows(spark, scale=1.0, n=360, seed=5):
    rng = np.random.default_rng(seed)
    centre = scale * rng.normal(size=(15, 8))
    found = [(i, (centre[i % 15] + 0.2 * rng.normal(size=8)).tolist()) for i in range(n)]
    found += [(i, centre[0].tolist()) for i in range(n, n + 60)]                       # copies
    found += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    return spark.createDataFrame(found, "id long, embedding array<double>").repartition(3)


def keyed(df):
    return sorted((r.query_id, r.rank, r.neighbor_id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """Blocks of 50 rows, pieces of 16; above 100 rows a search is streamed."""
    monkeypatch.setattr(ring, "HELD_BYTES", 8 * 8 * 50)
    monkeypatch.setattr(ring, "PIECE_ROWS", 16)
    monkeypatch.setattr(ring, "GAP_LISTS", 3)
    seen = []
    made = ring._sorted_blocks
    monkeypatch.setattr(ring, "_sorted_blocks", lambda *a: seen.append(made(*a)) or seen[-1])
    return {"strategy": "ring", "block_bytes": 8 * 8 * 100}, seen


@pytest.mark.parametrize("metric, cut, scale", [("cosine", 0.05, 1.0), ("euclidean", 6.0, 1e7), ("euclidean", 0.6, 1.0)])
def test_streamed_search_equals_the_full_search(spark, small, metric, cut, scale):
    base = rows(spark, scale)
    q = base.withColumnRenamed("id", "query_id")
    if metric == "euclidean":
        q = q.where("query_id <> 901")
    want = keyed(knn(base, q, 7, metric, base_id="id", within=cut))
    assert want and keyed(knn(base, q, 7, metric, base_id="id", within=cut, **small[0])) == want
    assert len(small[1]) == 2


def test_streamed_search_sends_no_vector_twice(spark, small):
    base = rows(spark)
    q = base.withColumnRenamed("id", "query_id").withColumn("query_id", F.col("query_id").cast("string"))
    got = knn(base, q, 7, base_id="id", within=0.05, **small[0])
    got.collect()
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    held, asks = ([open_block(body).read_all().num_rows for _, _, body in side.collect()] for side in small[1])
    assert len(held) > 7 and len(asks) > 7 and max(held + asks) <= 50
    # every usable query once; of the base all but spare copies
    assert sum(asks) == 420 and 360 <= sum(held) <= 420
    for _, head, body in small[1][0].collect():
        home, least, largest, _ = pickle.loads(head)
        block = open_block(body)
        assert len(home) == block.num_record_batches and max(block.get_batch(i).num_rows for i in range(len(home))) <= 16 and (least <= largest).all()


def test_streamed_search_of_repeated_and_null_ids_as_in_bundles(spark, small):
    base = rows(spark)
    twice = base.union(base.where("id < 100"))
    q = twice.withColumnRenamed("id", "query_id").withColumn("query_id", F.when(F.col("query_id") != 7, F.col("query_id")))
    got = keyed(knn(twice, q, 7, base_id="id", within=0.05, **small[0]))
    assert len(small[1]) == 2
    assert got == keyed(knn(twice, q, 7, base_id="id", within=0.05, strategy="ring")) and len(small[1]) == 2


def test_kept_rows_are_computed_once_and_equal(spark):
    count = spark.sparkContext.accumulator(0)

    def run(batches):
        for rb in batches:
            count.add(rb.num_rows)
            yield rb

    df = rows(spark).withColumn("text", F.when(F.col("id") % 2 == 0, "é"))
    held = kept(df.mapInArrow(run, df.schema))
    for _ in range(2):
        plain = lambda d: sorted((r.id, repr(r.embedding), r.text) for r in d.collect())
        assert plain(held) == plain(df)
    assert count.value == df.count() and held.schema == df.schema
    assert kept(df.where("id < 0")).count() == 0


def test_many_queries_with_a_cut_are_streamed(spark, small):
    base = rows(spark)
    q = base.withColumnRenamed("id", "query_id")
    got = knn(base, q, 5, base_id="id", within=0.02, broadcast_bytes=48 * 10, block_bytes=small[0]["block_bytes"])
    assert keyed(got) == keyed(knn(base, q, 5, base_id="id", within=0.02)) and len(small[1]) == 2


@pytest.mark.parametrize("query", ["duplicate_detection", "duplicate_detection_ring"])
def test_duplicate_detection_embeds_the_documents_once(spark, monkeypatch, query):
    from vectriage.plans import registry
    count, made = spark.sparkContext.accumulator(0), registry._docs_embedded

    def counted(*a):
        def run(batches):
            for rb in batches:
                count.add(rb.num_rows)
                yield rb

        df = made(*a).select("doc_id", "embedding")
        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(registry, "_docs_embedded", counted)
    texts = [(i, f"word{i % 9} word{i % 4} thing", "en", "s", 1) for i in range(60)] + [(60, "", "en", "s", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr("vectriage.sources.tables.read_table", lambda *a: docs)
    assert registry.QUERIES[query](spark, "").count() > 60 and count.value == 61
