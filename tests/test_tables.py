"""Tables: atomic replacement, clustered layout, CSV by splits, incremental vectors, index upkeep, samples, one search in triage."""

import csv
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectriage.operators.reviews import read_reviews_csv, sample_fixed_n
from vectriage.sources import sinks
from vectriage.sources.csv_records import csv_records, read_csv_records


def test_replacement_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert sinks.replace_table(spark.range(3), path) == 1
    real = sinks._point

    def lost(*args):
        raise RuntimeError("driver lost between the rows and the pointer")

    monkeypatch.setattr(sinks, "_point", lost)
    with pytest.raises(RuntimeError):
        sinks.replace_table(spark.range(10), path)
    assert sinks.read_table_version(spark, path).count() == 3
    monkeypatch.setattr(sinks, "_point", real)
    grown = sinks.read_table_version(spark, path).unionByName(spark.range(100, 102))
    assert sinks.replace_table(grown, path) == 2                      # reads what it replaces
    assert sinks.read_table_version(spark, path).count() == 5
    assert sinks.read_table_version(spark, path, 1).count() == 3
    with pytest.raises(Exception):                                    # a second writer of the same version
        sinks._point(spark, path, 2, "other")
    assert sinks.replace_table(spark.range(1), path) == 3
    assert sinks.drop_old_versions(spark, path, 1) == [1, 2] and sinks.versions(spark, path) == [3]
    assert sinks.read_table_version(spark, path).count() == 1
    with pytest.raises(ValueError):
        sinks.read_table_version(spark, path, 2)


def test_plain_folder_reads_as_it_is_until_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    assert sinks.read_table_version(spark, path).count() == 4
    sinks.replace_table(sinks.read_table_version(spark, path).where("id > 0"), path)
    assert sinks.read_table_version(spark, path).count() == 3


def test_table_info_does_not_hide_other_errors(spark, tmp_path):
    assert sinks.table_info(spark, str(tmp_path / "none")) == {"exists": False}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        sinks.table_info(spark, str(bad))


def test_a_large_date_is_written_by_several_tasks(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 5) if i % 10 else dt.datetime(2024, 1, 2 + i % 5, 5), f"c{i % 3}", "open", "low") for i in range(2000)]
    rows += [(5000 + i, dt.datetime(2024, 1, 1, 5), "c0", "open", "low") for i in range(2000)]      # one combination holds most
    df = spark.createDataFrame(rows, "ticket_id long, created_at timestamp_ntz, category string, status string, priority string").repartition(3)
    path = str(tmp_path / "t")
    sinks.write_partitioned_tickets(df, path, files=8)
    back = spark.read.parquet(path)
    assert back.count() == 4000 and "_salt" not in back.columns
    files = back.where("created_date = '2024-01-01'").select(F.col("_metadata.file_path").alias("f"), "category")
    sizes = [r[1] for r in files.groupBy("f").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1200
    spans = files.groupBy("f").agg(F.min("category").alias("lo"), F.max("category").alias("hi")).collect()
    assert sum(r.lo == r.hi for r in spans) >= len(spans) - 3         # statistics tell the categories apart


def csv_rows(n=300, seed=3):
    rnd = random.Random(seed)
    bits = ['plain', 'with, comma', 'a "quoted" word', 'two\nlines', '\n\n', 'ends with "', '"', '""', "", "tab\t", "é日本", 'x' * 400, '","', '"\n"']
    return [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(4))), rnd.choice(bits)) for i in range(n)]


@pytest.mark.parametrize("split", ["64", "200", "1k", "128m"])
def test_csv_records_by_splits(spark, tmp_path, split):
    rows = csv_rows()
    for k in range(2):
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
            w.writerow(["id", "a", "b"])
            w.writerows(rows[k::2])
    schema = spark.createDataFrame([], "id long, a string, b string").schema
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r.id, r.a or "", r.b or "") for r in read_csv_records(spark, str(tmp_path), schema).collect())
        if split == "64":
            assert csv_records(spark, str(tmp_path)).select("file", "split").distinct().count() > 20
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == sorted(rows)


def test_malformed_csv_records_keep_their_text(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text("Id,ProductId,UserId,ProfileName,HelpfulnessNumerator,HelpfulnessDenominator,Score,Time,Summary,Text\n"
                 "1,P1,U1,Al,1,2,5,100,fine,ok\n"
                 "2,P1,U1,Al,one,2,5,100,fine,\"two\nlines\"\n"
                 "\n"
                 "3,P1\n")
    rows = {r.Id: r for r in read_reviews_csv(spark, str(p), corrupt_col="_bad").collect()}
    assert set(rows) == {1, 2, 3} and rows[1]._bad is None
    assert rows[2].HelpfulnessNumerator is None and rows[2]._bad.startswith("2,P1") and "two\nlines" in rows[2]._bad
    assert rows[3]._bad == "3,P1"


def test_incremental_batches(spark, tmp_path):
    from vectriage.functions.embed import HashingEmbedder
    from vectriage.streaming.incremental import append_batch, current_vectors
    path = str(tmp_path / "v")
    one = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "changed"), (3, None), (4, "new")], "id long, text string")
    assert append_batch(one, path, "id", "text") == 1
    assert append_batch(two, path, "id", "text") == 2
    stored = spark.read.parquet(path)
    assert sorted((r.batch_id, r.id) for r in stored.collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 4)]
    now = {r.id: r.embedding for r in current_vectors(stored, "id").collect()}
    want = {r.id: r.embedding for r in HashingEmbedder().transform(two, "text").collect()}
    assert now == want
    assert append_batch(two, path, "id", "text") == 3 and current_vectors(spark.read.parquet(path), "id").count() == 4


def test_index_upkeep(spark, tmp_path):
    from vectriage.operators.index_store import append_rows, compact, drop_index, index_status, open_index, remove_rows
    from vectriage.operators.ivf import build_ivf, ivf_search, save_ivf
    from vectriage.operators.knn import knn
    rng = np.random.default_rng(8)
    vec = lambda: rng.normal(size=5).tolist()
    frame = lambda rows: spark.createDataFrame(rows, "id long, embedding array<double>")
    now = {i: vec() for i in range(120)}
    path = str(tmp_path / "ivf")
    save_ivf(build_ivf(frame(list(now.items())), "id", num_lists=6), path)
    more = {i: vec() for i in range(120, 160)} | {i: vec() for i in range(10)}
    now |= more
    assert append_rows(spark, path, frame(list(more.items())), "id") == 1
    assert remove_rows(spark, path, frame([(i, None) for i in range(5, 30)]), "id") == 2
    for i in range(5, 30):
        now.pop(i)
    back = {7: vec(), 8: vec()}
    now |= back
    append_rows(spark, path, frame([*back.items(), (100, None)]), "id")       # 7 and 8 return, 100 loses its vector
    now.pop(100)
    index = open_index(spark, path, "id")
    base = frame(list(now.items()))
    q = base.withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r.neighbor_id, r.rank) for r in df.collect())
    assert key(ivf_search(index, q, 4, fraction=1.0)) == key(knn(base, q, 4, base_id="id"))
    s = index_status(spark, path, "id", base=base).first()
    assert (s.lists, s.batches, s.built_rows, s.rows_added, s.rows_removed, s.indexed_rows, s.coverage_pct) == (index.num_lists, 3, 120, 52, 26, len(now), 100.0)
    spark.range(1).write.parquet(f"{path}/delta/4")                   # a batch that was never committed
    assert open_index(spark, path, "id").rows.count() == len(now)
    small = compact(spark, path, str(tmp_path / "ivf2"), "id")
    assert key(ivf_search(small, q, 4, fraction=1.0)) == key(knn(base, q, 4, base_id="id"))
    assert drop_index(spark, path) and not drop_index(spark, path)


def test_appended_rows_without_a_usable_vector_are_not_lost(spark):
    from vectriage.operators.ivf import assign_lists, build_ivf
    base = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(20)], "id long, embedding array<double>")
    new = spark.createDataFrame([(50, [1.0, 2.0]), (51, None), (52, [0.0, 0.0])], "id long, embedding array<double>")
    got = {r.id: r.list_id for r in assign_lists(build_ivf(base, "id", num_lists=3), new).collect()}
    assert set(got) == {50, 51, 52} and got[50] is not None and got[51] is None and got[52] is None


def test_sample_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(str(i % 50) if i % 7 else None, i) for i in range(400)], "review_id string, x long").repartition(6)
    for n in (1, 17, 399, 400, 1000):
        assert sample_fixed_n(df, n).count() == min(n, 400)
    want = [r.review_id for r in df.distinct().orderBy(F.md5(F.concat(F.lit("42"), "review_id")), "review_id").limit(30).collect()]
    assert sorted(map(str, want)) == sorted(str(r.review_id) for r in sample_fixed_n(df, 30).collect())


def test_embed_distinct_with_a_hot_text(spark):
    from vectriage.functions.embed import HashingEmbedder, embed_distinct
    rows = [(i, "hot words" if i % 3 else (None if i % 2 else f"text {i}"), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, embedding string").repartition(4)
    out = embed_distinct(df, "text", heavy_share=10)
    got = {r.id: r.embedding for r in out.collect()}
    want = {r.id: r.embedding for r in HashingEmbedder().transform(df.drop("embedding"), "text").collect()}
    assert got == want and out.count() == 300
    assert [c for c in out.columns] == ["id", "text", "embedding"]


def triage_frames(spark, n=80):
    rng = np.random.default_rng(5)
    rows = [(i, f"t{i % 9}", f"c{i % 4}" if i % 11 else None, ["high", "low"][i % 2], "resolved" if i % 3 else "open", f"fix{i % 3}" if i % 5 else None,
             int(3 + i % 3), None if i % 4 == 0 else float(i % 7), rng.normal(size=4).tolist()) for i in range(n)]
    base = spark.createDataFrame(rows, "ticket_id long, title string, category string, priority string, status string, resolution string, "
                                       "satisfaction_score int, resolution_time_hours double, embedding array<double>")
    q = base.select(F.col("ticket_id").alias("query_id"), "embedding")
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 4), (902, [float("nan")] * 4)], "query_id long, embedding array<double>")
    return base, q.unionByName(odd)


def test_triage_from_one_search_equals_its_parts(spark):
    from vectriage.operators.search import find_similar
    from vectriage.operators.triage import categorize, recommend, triage
    base, q = triage_frames(spark)
    out = triage(base, q)
    got = {r.query_id: r for r in out.collect()}
    cats = {r.query_id: r for r in categorize(base, q, 10).collect()}
    recs = {r.query_id: r for r in recommend(base, q, 20).collect()}
    near = {}
    for r in sorted(find_similar(base, q, 5).collect(), key=lambda r: r.rank):
        near.setdefault(r.query_id, []).append((r.ticket_id, r.similarity_score))
    assert set(got) == set(cats) and any(r.solution for r in got.values())
    for k, r in got.items():
        assert [(x.ticket_id, x.similarity_score) for x in r.similar_tickets] == near.get(k, [])
        for c in ("category", "category_votes", "category_similarity", "category_confidence", "priority", "priority_votes", "priority_similarity"):
            assert r[c] == cats[k][c]
        rec = recs[k]
        assert (r.solution, r.confidence, r.similar_ticket_count, r.avg_satisfaction, r.avg_resolution_hours, r.avg_similarity_pct) == (
            rec.resolution, rec.confidence_score, rec.frequency, rec.avg_satisfaction, rec.avg_resolution_hours, rec.avg_similarity_pct)
        assert [tuple(e) for e in r.example_tickets] == [tuple(e) for e in rec.example_tickets]
    assert {k for k, r in got.items() if r.error} == {900, 901, 902}
    assert "solution" not in triage(base, q, include_recommendations=False).columns


def test_triage_plan_holds_one_search(spark):
    from vectriage.operators.triage import triage, triage_summary
    base, q = triage_frames(spark)
    for df in (triage(base, q), triage_summary(triage(base, q))):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("MapInArrow") == 1
