"""Keeping a written IVF index up to date: append, change, remove, status, drop.

A stored index is never rewritten in place.  Every batch goes to folders of its
own: ``delta/batch=N`` holds the batch's rows with their lists (assigned by the
stored centroids), ``removed/batch=N`` the ids taken out; ``batches`` gets a row
last, with counted sizes, and a batch without one is not read.  A row's newest
batch counts: appending an id again changes its vector, removing hides it, and
appending it later brings it back.  ``compact`` writes a new index of the rows
that count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectriage.operators.ivf import IVFIndex, _usable, assign_nearest, list_table, load_ivf, save_ivf
from vectriage.sources.sinks import drop_path, table_info


def _batches(spark: SparkSession, path: str) -> list[int]:
    if not table_info(spark, f"{path}/batches")["exists"]:
        return []
    return sorted(r["batch"] for r in spark.read.parquet(f"{path}/batches").select("batch").collect())      # a row per batch


def _write_batch(spark: SparkSession, path: str, rows: DataFrame | None, removed: DataFrame | None) -> int:
    number = (_batches(spark, path) or [0])[-1] + 1
    counted = {"rows": 0, "removed": 0}
    for name, df in (("rows", rows), ("removed", removed)):
        if df is not None:
            folder = f"{path}/{'delta' if name == 'rows' else 'removed'}/{number}"
            df.write.mode("overwrite").parquet(folder)
            counted[name] = spark.read.parquet(folder).count()
    spark.createDataFrame([(number, counted["rows"], counted["removed"])], "batch long, added long, removed long").write.mode("append").parquet(f"{path}/batches")
    return number


def append_rows(spark: SparkSession, path: str, rows: DataFrame, id_col: str, vec_col: str = "embedding", metric: str = "cosine") -> int:
    """Add or change vectors; the batch's number.  An id whose new vector cannot be searched leaves the index."""
    centroids = spark.read.parquet(f"{path}/centroids")
    slim = rows.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col))
    placed = assign_nearest(slim, centroids, id_col, vec_col, metric)
    lost = slim.where(~F.coalesce(_usable(vec_col, metric), F.lit(False))).select(id_col)
    return _write_batch(spark, path, placed, lost)


def remove_rows(spark: SparkSession, path: str, ids: DataFrame, id_col: str) -> int:
    """Take ids out of the index; the batch's number."""
    return _write_batch(spark, path, None, ids.select(id_col).distinct())


def _union(spark: SparkSession, path: str, name: str, numbers: list[int]) -> DataFrame | None:
    out = None
    for n in numbers:
        if table_info(spark, f"{path}/{name}/{n}")["exists"]:
            part = spark.read.parquet(f"{path}/{name}/{n}").withColumn("_batch", F.lit(n).cast("long"))
            out = part if out is None else out.unionByName(part)
    return out


def open_index(spark: SparkSession, path: str, id_col: str, vec_col: str = "embedding", metric: str = "cosine") -> IVFIndex:
    """The index as its batches leave it, ready to search.

    The last batch of each changed id is found among the batches alone; the base rows lose those ids by an anti join
    and keep their list folders, so a search still reads only the lists it probes.
    """
    base = load_ivf(spark, path, id_col, vec_col, metric)
    numbers = _batches(spark, path)
    if not numbers:
        return base
    added, removed = _union(spark, path, "delta", numbers), _union(spark, path, "removed", numbers)
    events = [df.select(id_col, "_batch") for df in (added, removed) if df is not None]
    touched = events[0] if len(events) == 1 else events[0].unionByName(events[1])
    last = touched.groupBy(id_col).agg(F.max("_batch").alias("_batch"))
    rows = base.rows.join(last.select(id_col), id_col, "left_anti")
    if added is not None:
        fresh = added.join(last, [id_col, "_batch"])
        if removed is not None:                 # a batch that both adds and loses an id holds two rows of it
            fresh = fresh.join(removed.select(id_col, "_batch"), [id_col, "_batch"], "left_anti")
        fresh = fresh.dropDuplicates([id_col])
        rows = rows.select(id_col, "list_id", vec_col, "centroid_distance").unionByName(fresh.select(id_col, "list_id", vec_col, "centroid_distance"))
    sizes = list_table(rows)
    return IVFIndex(base.centroids, rows, id_col, vec_col, metric, base.num_lists, sizes, path=path)


def index_status(spark: SparkSession, path: str, id_col: str, vec_col: str = "embedding", base: DataFrame | None = None) -> DataFrame:
    """One row: lists, batches, rows of the base, rows now, rows added and removed since, largest list, coverage of ``base``."""
    index = open_index(spark, path, id_col, vec_col)
    now = index.rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("indexed_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_list"))
    first = spark.read.parquet(f"{path}/lists").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("built_rows"))
    numbers = _batches(spark, path)
    since = (spark.read.parquet(f"{path}/batches").agg(F.sum("added").alias("rows_added"), F.sum("removed").alias("rows_removed")) if numbers
             else spark.range(1).select(F.lit(0).cast("long").alias("rows_added"), F.lit(0).cast("long").alias("rows_removed")))
    out = now.join(first).join(since).select(F.lit(index.num_lists).cast("long").alias("lists"), F.lit(len(numbers)).cast("long").alias("batches"),
                                             "built_rows", "rows_added", "rows_removed", "indexed_rows", "largest_list")
    if base is not None:
        total = base.agg(F.count_if(F.col(vec_col).isNotNull()).alias("_base"))
        out = out.join(total).withColumn("coverage_pct", F.when(F.col("_base") > 0, F.round(F.col("indexed_rows") * 100.0 / F.col("_base"), 2))).drop("_base")
    return out


def compact(spark: SparkSession, path: str, new_path: str, id_col: str, vec_col: str = "embedding", metric: str = "cosine") -> IVFIndex:
    """Write the rows that count to ``new_path``, with the same centroids."""
    index = open_index(spark, path, id_col, vec_col, metric)
    index.path = None
    save_ivf(index, new_path)
    return load_ivf(spark, new_path, id_col, vec_col, metric)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Remove a stored index with all its batches."""
    return drop_path(spark, path)
