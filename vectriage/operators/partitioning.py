"""Partitioning helpers for compute-heavy, per-row stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def largest_input_bytes(df: DataFrame) -> int | None:
    """Size of the largest input relation of the optimized plan (file
    sizes from the catalog / file listing; no job runs).  Join estimates
    without statistics multiply their inputs, so the inputs are used."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        est = max(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001 - estimate unavailable
        return None
    # relations without statistics report spark.sql.defaultSizeInBytes (Long.MaxValue)
    return None if est >= (1 << 62) else est


def split_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as Spark reads it (``16m``, ``1g``, a plain number)."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Give a CPU-heavy map stage (Arrow kernels, embedders) at least the
    cluster's parallelism.

    Decided from the optimizer's size of the largest input, without
    running anything: an input larger than ``parallelism * maxPartitionBytes``
    already has at least one split per core and is returned unchanged (no
    shuffle).  A
    smaller input may sit in a handful of splits (one Parquet row group,
    say); it is hash-partitioned on ``key`` (round-robin without one),
    which costs little because it is small.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if target <= 1:
        return df
    split = split_bytes(spark)
    est = largest_input_bytes(df)
    if est is None or est > target * split:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def fit_scan_tasks(df: DataFrame, key: str | None = None, task_bytes: int = 1 << 30) -> DataFrame:
    """Task count for a scan whose tasks each emit a fixed-size result
    (a per-task top-k): small inputs are spread over every core; large
    ones are coalesced (no shuffle) to about one task per ``task_bytes``
    but never below twice the parallelism, so the per-task results stay
    proportional to the cluster, not to the number of file splits."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    split = split_bytes(spark)
    est = largest_input_bytes(df)
    if est is None:
        return df
    if est <= par * split:
        return spread(df, key)
    return df.coalesce(max(2 * par, -(-est // task_bytes)))
