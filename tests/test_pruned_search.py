"""Searches that leave work out: list folders, list bounds, filtered lists, rings; and the settings they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.operators.ivf import build_ivf, ivf_search, load_ivf, probe_lists, save_ivf, tree_rows
from vectriage.operators.knn import knn
from vectriage.operators.ring import ring_cells


def clustered(spark, n=600, centres=12, dim=8, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    rows = [(i, (c[i % centres] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4), rows


def keyed(df):
    return sorted((r.query_id, r.neighbor_id, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base, rows = clustered(spark)
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    save_ivf(build_ivf(base, "id", num_lists=12), path)
    return base, rows, load_ivf(spark, path, "id"), path


def brute_probe(index, rows, nprobe, k, allowed=None):
    """Top-k among the rows of the nprobe nearest lists, and of more while those hold fewer than k allowed rows."""
    cents = sorted((r.list_id, np.array(r.centroid)) for r in index.centroids.collect())
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    home = {r.id: r.list_id for r in index.rows.select("id", "list_id").collect()}
    out = []
    for q, v in rows[:40]:
        order = sorted((round(1 - unit(v) @ unit(c), 9), i) for i, c in cents)
        held, lists = 0, set()
        for place, (_, i) in enumerate(order):
            if place >= nprobe and (allowed is None or held >= k):
                break
            lists.add(i)
            held += sum(1 for b, _ in rows if home[b] == i and (allowed is None or b in allowed))
        near = sorted((round(1 - unit(v) @ unit(w), 9), b) for b, w in rows if home[b] in lists and (allowed is None or b in allowed))
        out += [(q, b, r) for r, (_, b) in enumerate(near[:k], 1)]
    return sorted(out)


def test_probe_reads_only_the_folders_of_its_lists(spark, stored):
    base, rows, index, _ = stored
    q = base.where("id < 40").withColumnRenamed("id", "query_id")
    for bound in (False, True):
        got = ivf_search(index, q, 5, fraction=2 / 12, bound=bound)
        assert keyed(got) == brute_probe(index, rows, 2, 5)
    one = q.where("query_id = 3")
    got = ivf_search(index, one, 5, fraction=1 / 12)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "/rows]" in line]
    assert scans and all("dynamicpruning" in line for line in scans)


def test_every_learnt_row_is_in_its_nearest_list(stored):
    _, rows, index, _ = stored
    cents = {r.list_id: np.array(r.centroid) for r in index.centroids.collect()}
    got = {r.id: r for r in index.rows.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, v in rows:
        gap = {c: np.linalg.norm(np.array(v) / np.linalg.norm(v) - m) for c, m in cents.items()}
        assert gap[got[i].list_id] <= min(gap.values()) + 1e-9 and abs(gap[got[i].list_id] - got[i].centroid_distance) < 1e-6
    sizes = {r.list_id: (r.n_rows, r.radius) for r in index.sizes.collect()}
    assert sum(n for n, _ in sizes.values()) == len(rows)
    assert all(r.centroid_distance <= sizes[r.list_id][1] for r in got.values())


def test_two_level_fit_and_given_lists(spark):
    base, rows = clustered(spark, 900, 30, 6)
    assert 25 <= build_ivf(base, "id").num_lists <= 30           # ceil(sqrt(rows)) lists, if so many centroids stay distinct
    index = build_ivf(base, "id", num_lists=100)
    assert 60 <= index.num_lists <= 140 and index.rows.count() == 900
    q = base.where("id < 20").withColumnRenamed("id", "query_id")
    assert keyed(ivf_search(index, q, 5, fraction=1.0)) == keyed(knn(base, q, 5, base_id="id"))
    given = spark.createDataFrame([(7, rows[0][1]), (9, rows[1][1])], "list_id long, centroid array<double>")
    mine = build_ivf(base, "id", centroids=given)
    assert {r.list_id for r in mine.rows.select("list_id").distinct().collect()} == {7, 9} and mine.num_lists == 2


def test_filtered_probe_takes_as_many_lists_as_hold_k_rows(spark, stored):
    base, rows, index, _ = stored
    q = base.where("id < 40").withColumnRenamed("id", "query_id")
    allowed = {i for i, _ in rows if i % 12 == 4 or i % 97 == 0}       # one list's rows, and a few of the others
    flt = (F.col("id") % 12 == 4) | (F.col("id") % 97 == 0)
    got = ivf_search(index, q, 6, fraction=1 / 12, filters=flt)
    assert keyed(got) == brute_probe(index, rows, 1, 6, allowed)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FlatMapCoGroupsInArrow") == 1
    few = ivf_search(index, q, 6, fraction=1 / 12, filters=F.col("id").isin([5, 9]))      # fewer than k in all
    assert {(r.query_id, r.neighbor_id) for r in few.collect()} == {(a, b) for a in range(40) for b in (5, 9)}


def test_block_rows_follow_the_width(spark):
    from vectriage.operators import ivf
    rng = np.random.default_rng(2)
    base = spark.createDataFrame([(i, rng.normal(size=768).tolist()) for i in range(200)], "id long, embedding array<double>")
    index = build_ivf(base, "id", num_lists=2)
    q = base.where("id < 5").withColumnRenamed("id", "query_id")
    seen, real = [], ivf._blocked

    def spy(index_, probes, q_, rows, stored_, most, queries_):
        seen.append(most)
        return real(index_, probes, q_, rows, stored_, most, queries_)

    ivf._blocked = spy
    try:
        got = ivf_search(index, q, 3, fraction=1.0, block_bytes=64 * 768 * 8)
    finally:
        ivf._blocked = real
    assert seen == [64] and keyed(got) == keyed(knn(base, q, 3, base_id="id"))


def test_another_metric_and_stray_options_raise(spark, stored):
    from vectriage.operators.search import find_similar
    base, _, index, _ = stored
    q = base.where("id < 3").withColumnRenamed("id", "query_id")
    with pytest.raises(ValueError):
        ivf_search(index, q, 3, metric="euclidean")
    with pytest.raises(ValueError):
        find_similar(base.withColumnRenamed("id", "ticket_id"), q, 3, index=index, strategy="block")


@pytest.mark.parametrize("group", [None, 60])
def test_tree_leaves_stay_within_the_limit(spark, group):
    base, rows = clustered(spark, 500, 5, 4)
    same = spark.createDataFrame([(1000 + i, rows[0][1]) for i in range(150)], "id long, embedding array<double>")     # cannot be told apart
    out = tree_rows(base.unionByName(same), "id", "embedding", "cosine", 40, group_rows=group)
    sizes = [r[1] for r in out.groupBy("_path").count().collect()]
    assert sum(sizes) == 650 and max(sizes) <= 40
    assert out.select("id").distinct().count() == 650


def test_lists_are_found_in_blocks_when_centroids_are_too_many(spark, stored, monkeypatch):
    from vectriage.operators import ivf
    base, rows, index, _ = stored
    q = base.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("_vec"))
    cols = ("query_id", "neighbor_id", "rank")
    want = sorted(tuple(r[c] for c in cols) for r in probe_lists(index, q, 3, "cosine").collect())
    held = {i: 50 for i in range(12)}
    want_k = sorted(tuple(r[c] for c in cols) for r in probe_lists(index, q, 1, "cosine", 120, held).collect())
    assert len(want_k) == 40 * 3
    monkeypatch.setattr(ivf, "_matrix_broadcast", lambda c: None)
    assert sorted(tuple(r[c] for c in cols) for r in probe_lists(index, q, 3, "cosine").collect()) == want
    assert sorted(tuple(r[c] for c in cols) for r in probe_lists(index, q, 1, "cosine", 120, held).collect()) == want_k
    near = ivf.assign_nearest(base, index.centroids, "id", "embedding", "cosine")
    assert {r.id: r.list_id for r in near.collect()} == {r.id: r.list_id for r in index.rows.collect()}


def test_block_search_sends_base_rows_once_when_blocks_are_many(spark):
    base, _ = clustered(spark, 300, 10, 6)
    q = base.withColumnRenamed("id", "query_id")
    got = knn(base, q, 4, base_id="id", strategy="block", block_bytes=6 * 8 * 10)
    assert keyed(got) == keyed(knn(base, q, 4, base_id="id"))
    few = knn(base, q, 4, base_id="id", strategy="block", block_bytes=1 << 20)      # one block, copied to keep the cores busy
    assert keyed(few) == keyed(got)


# ---------------------------------------------------------------- distance cut

@pytest.mark.parametrize("metric, cut", [("cosine", 0.05), ("euclidean", 0.4), ("euclidean", 3.0), ("cosine", 1.2)])
def test_ring_search_equals_the_full_search(spark, metric, cut):
    base, _ = clustered(spark, 400, 10, 6, seed=3)
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6)], "id long, embedding array<double>")
    base = base.unionByName(odd)
    q = base.withColumnRenamed("id", "query_id")
    if metric == "euclidean":
        q = q.where("query_id <> 901")
    full = knn(base, q, 7, metric, base_id="id", within=cut)
    ring = knn(base, q, 7, metric, base_id="id", within=cut, strategy="ring")
    assert keyed(ring) == keyed(full) and full.count() > 0


def test_ring_search_compares_few_pairs_of_clustered_rows(spark):
    base, _ = clustered(spark, 600, 20, 8, spread=0.02)
    q = base.withColumnRenamed("id", "query_id")
    pq, rows = ring_cells(base, q, 0.01, "cosine", num_pivots=25)
    on = ["list_id", "ring", "_block", "_qblock"]
    asked, held = pq.groupBy(*on).agg(F.count("*").alias("a")), rows.groupBy(*on).agg(F.count("*").alias("b"))
    pairs = asked.join(held, on).agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert 600 * 30 <= pairs < 600 * 600 / 8
    met = pq.select(*on, F.col("_id").alias("a")).join(rows.select(*on, F.col("_id").alias("b")), on)
    assert met.count() == met.select("a", "b").distinct().count()       # no pair twice


def test_ring_search_of_large_vectors_loses_none_to_rounding(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 16)) * 1e7
    rows = [(i, (centre[i % 5] + rng.normal(size=16)).tolist()) for i in range(100)]
    base = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = base.withColumnRenamed("id", "query_id")
    assert keyed(knn(base, q, 4, "euclidean", base_id="id", within=6.0, strategy="ring")) == keyed(knn(base, q, 4, "euclidean", base_id="id", within=6.0))


def test_many_queries_with_a_cut_take_the_rings(spark):
    base, _ = clustered(spark, 300, 10, 6)
    q = base.withColumnRenamed("id", "query_id")
    few = knn(base, q, 5, base_id="id", within=0.02, broadcast_bytes=48 * 10)
    few.collect()
    assert "FlatMapCoGroupsInArrow" in few._jdf.queryExecution().executedPlan().toString()
    assert keyed(few) == keyed(knn(base, q, 5, base_id="id", within=0.02))
    with pytest.raises(ValueError):
        knn(base, q, 5, base_id="id", strategy="ring")


# ---------------------------------------------------------------- settings

@pytest.mark.parametrize("size", ["16m", "1g", "134217728", "64kb"])
def test_byte_sizes_in_the_session(spark, size):
    from vectriage.functions.embed import HashingEmbedder
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        base, _ = clustered(spark, 60)
        q = base.where("id < 3").withColumnRenamed("id", "query_id")
        assert knn(base, q, 2, base_id="id").count() == 6
        texts = spark.createDataFrame([(1, "a b")], "id long, text string")
        assert HashingEmbedder().transform(texts, "text").first().embedding is not None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_queries_of_another_width_raise_wherever_they_are(spark):
    base, _ = clustered(spark, 60)
    q = base.withColumnRenamed("id", "query_id").unionByName(
        spark.createDataFrame([(999, [1.0, 2.0])], "query_id long, embedding array<double>"))
    for opts in ({}, {"strategy": "block"}, {"broadcast_bytes": 8 * 8 * 4}):
        with pytest.raises(Exception, match="wid"):
            knn(base, q.coalesce(1), 2, base_id="id", **opts).collect()
    assert knn(base, q, 2, base_id="id", dim=8).select("query_id").distinct().count() == 60
