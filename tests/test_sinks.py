import pytest
from pyspark.sql import functions as F

from vectriage.sources.sinks import merge_matched, table_info, write_partitioned_tickets, write_table
from vectriage.streaming.incremental import incremental_embed, rows_to_embed


def test_write_dispositions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    write_table(df, path, "WRITE_EMPTY")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        write_table(df, path, "WRITE_EMPTY")
    write_table(df, path, "WRITE_APPEND")
    assert spark.read.parquet(path).count() == 10
    write_table(spark.range(2), path, "WRITE_TRUNCATE")
    assert table_info(spark, path)["row_count"] == 2
    empty = str(tmp_path / "e")
    write_table(spark.range(0), empty, "WRITE_EMPTY")
    write_table(df, empty, "WRITE_EMPTY")          # an existing empty table may be written
    assert spark.read.parquet(empty).count() == 5
    assert table_info(spark, str(tmp_path / "missing")) == {"exists": False}


def test_merge_matched_keeps_row_count(spark):
    target = spark.createDataFrame([(1, None), (2, [1.0]), (3, None)], "id long, embedding array<double>")
    source = spark.createDataFrame([(1, [5.0]), (4, [9.0])], "id long, embedding array<double>")
    out = {r.id: r.embedding for r in merge_matched(target, source, "id", ["embedding"]).collect()}
    assert out == {1: [5.0], 2: [1.0], 3: None}


def test_partitioned_layout(spark, tmp_path):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, 5), f"c{i % 2}", "open", "low") for i in range(12)]
    df = spark.createDataFrame(rows, "ticket_id long, created_at timestamp_ntz, category string, "
                                     "status string, priority string")
    path = str(tmp_path / "tickets")
    write_partitioned_tickets(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 12
    assert back.where(F.col("created_date") == "2024-01-02").count() == 4


def test_incremental_embed_only_new_or_changed(spark):
    src = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "new text")], "id long, text string")
    stored = spark.createDataFrame([(1, "a b"), (2, "old")], "id long, text string").select(
        "id", F.sha2("text", 256).alias("text_hash"))
    todo = sorted(r.id for r in rows_to_embed(src, stored, "id", "text").collect())
    assert todo == [2, 3]
    out = incremental_embed(src, stored, "id", "text").collect()
    assert sorted(r.id for r in out) == [2, 3] and all(r.embedding is not None for r in out)


def test_catalog_tables(spark, tmp_path):
    from vectriage.sources.sinks import create_database, drop_table, save_table, table_exists, table_row_count
    create_database(spark, "vt_test_db")
    name = "vt_test_db.t1"
    drop_table(spark, name)
    df = spark.range(3).withColumnRenamed("id", "ticket_id")
    save_table(df, name, "WRITE_EMPTY", description="tickets", labels={"env": "test"})
    assert table_exists(spark, name) and table_row_count(spark, name) == 3
    props = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    assert props.get("env") == "test"
    assert spark.catalog.getTable(name).description == "tickets"
    save_table(df, name, "WRITE_APPEND")
    assert table_row_count(spark, name) == 6
    drop_table(spark, name)
    assert not table_exists(spark, name)


def test_recent_prunes_date_partitions(spark, tmp_path):
    import datetime as dt
    from vectriage.operators.trends import recent
    rows = [(i, dt.datetime(2024, 1, 1 + i % 10, 12), "c", "open", "low") for i in range(30)]
    df = spark.createDataFrame(rows, "ticket_id long, created_at timestamp_ntz, category string, "
                                     "status string, priority string")
    path = str(tmp_path / "tickets")
    write_partitioned_tickets(df, path)
    got = recent(spark.read.parquet(path), dt.datetime(2024, 1, 10, 12), 2)
    assert sorted(r.ticket_id for r in got.collect()) == [7, 8, 9, 17, 18, 19, 27, 28, 29]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
