"""Writing tables: dispositions, typed partitioned layout, matched update.

Paths are whatever the cluster's storage uses (HDFS, object store); the
caller passes them.  Nothing here uses a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DISPOSITIONS = {"WRITE_APPEND": "append", "WRITE_TRUNCATE": "overwrite", "WRITE_EMPTY": "errorifexists"}


def _path_has_rows(spark: SparkSession, path: str) -> bool | None:
    """None when nothing is at ``path``; else whether it holds any row."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return not df.isEmpty()


def write_table(df: DataFrame, path: str, disposition: str = "WRITE_EMPTY",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write with a load disposition.

    ``WRITE_APPEND`` appends, ``WRITE_TRUNCATE`` replaces, ``WRITE_EMPTY``
    writes only when the destination is absent or holds no rows.
    """
    if disposition not in DISPOSITIONS:
        raise ValueError(f"disposition must be one of {sorted(DISPOSITIONS)}")
    mode = DISPOSITIONS[disposition]
    if disposition == "WRITE_EMPTY":
        state = _path_has_rows(df.sparkSession, path)
        if state:
            raise ValueError(f"WRITE_EMPTY: {path} already holds rows")
        mode = "overwrite" if state is False else "errorifexists"
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_partitioned_tickets(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """Date-partitioned, clustered layout: ``created_date=...`` folders,
    rows sorted by category, status, priority inside each file so Parquet
    min/max statistics skip files and row groups on those columns.

    Tasks take ranges of (date, category, status, priority, hash of the row):
    a large date, or one combination that holds most of it, is cut over as many
    tasks as its rows need, and small dates share a task.  ``files`` sets the
    number of ranges (the session's shuffle partitions by default).

    Readers filter on ``created_date`` as well as ``created_at`` so that
    partition pruning applies (it is not derived from ``created_at``).
    """
    dated = df.withColumn("created_date", F.to_date("created_at"))
    hashable = [c for c, t in df.dtypes if not t.startswith("map")]
    order = ["created_date", "category", "status", "priority"]
    dated = dated.withColumn("_salt", F.xxhash64(*hashable))
    ranged = dated.repartitionByRange(files, *order, "_salt") if files else dated.repartitionByRange(*order, "_salt")
    ranged.sortWithinPartitions(*order).drop("_salt").write.mode(mode).partitionBy("created_date").parquet(path)


def add_column_if_missing(df: DataFrame, name: str, dtype: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def merge_matched(target: DataFrame, source: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """MERGE ... WHEN MATCHED THEN UPDATE SET cols = source.cols.

    A left join on the key: unmatched target rows keep their values,
    matched ones take the source's, null included, source rows without a
    target row are ignored, and the row count of the target is unchanged.
    A key that the source holds twice fails the job.
    """
    for c in cols:
        target = add_column_if_missing(target, c, source.schema[c].dataType.simpleString())
    s = source.groupBy(key).agg(F.any_value(F.struct(*cols)).alias("_src"), F.count("*").alias("_n"))
    s = s.select(key, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"MERGE: duplicate source key in {key}")).cast(s.schema["_src"].dataType))
                 .otherwise(F.col("_src")).alias("_src"))
    joined = target.join(s, key, "left")
    out = [F.when(F.col("_src").isNotNull(), F.col("_src")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return joined.select(*out)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table kept by ``replace_table``, oldest first."""
    p, fs = _hadoop(spark, f"{path}/_versions")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def replace_table(df: DataFrame, path: str) -> int:
    """Replace the table at ``path`` by ``df``, which may read it; the new version's number.

    The rows go to a folder of their own, ``{path}/_data/N-<id>``; then a file
    ``{path}/_versions/N`` that names it is created, which is the one step that
    makes readers (``read_table_version``) see it.  A writer that is lost before leaves
    the old version as it was; of two writers of the same N the second fails.
    """
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    folder = f"{number}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/_data/{folder}")
    _point(spark, path, number, folder)
    return number


def _point(spark: SparkSession, path: str, number: int, folder: str) -> None:
    p, fs = _hadoop(spark, f"{path}/_versions/{number}")
    out = fs.create(p, False)                   # fails when the version exists
    out.write(bytearray(folder.encode()))
    out.close()


def read_table_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a table written by ``replace_table``, or the one asked for; a plain Parquet folder as it is."""
    found = versions(spark, path)
    if not found and version is None:
        return spark.read.parquet(path)
    number = found[-1] if version is None else version
    if number not in found:
        raise ValueError(f"{path} has no version {number}")
    folder = spark.read.text(f"{path}/_versions/{number}").first()[0]
    return spark.read.parquet(f"{path}/_data/{folder}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Drop all but the last ``keep`` versions, pointers first; the numbers dropped."""
    found = versions(spark, path)
    old = found[:-keep] if keep else found
    for number in old:
        folder = spark.read.text(f"{path}/_versions/{number}").first()[0]
        for name in (f"_versions/{number}", f"_data/{folder}"):
            p, fs = _hadoop(spark, f"{path}/{name}")
            fs.delete(p, True)
    return old


def drop_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder from the storage; False when there was none."""
    p, fs = _hadoop(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def table_info(spark: SparkSession, path: str) -> dict:
    """Existence, schema and row count of a Parquet table."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {"exists": False}
    return {"exists": True, "schema": df.schema, "row_count": df.count()}


# ---- catalog tables (metastore) -------------------------------------------

def _quote(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_database(spark: SparkSession, name: str, exists_ok: bool = True) -> None:
    spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if exists_ok else ''}{_quote(name)}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str, not_found_ok: bool = True) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if not_found_ok else ''}{_quote(name)}")


def save_table(df: DataFrame, name: str, disposition: str = "WRITE_EMPTY",
               partition_by: list[str] | None = None, description: str | None = None,
               labels: dict | None = None) -> None:
    """``saveAsTable`` with a load disposition, a description (COMMENT) and
    labels (TBLPROPERTIES)."""
    spark = df.sparkSession
    if disposition not in DISPOSITIONS:
        raise ValueError(f"disposition must be one of {sorted(DISPOSITIONS)}")
    mode = DISPOSITIONS[disposition]
    if disposition == "WRITE_EMPTY" and table_exists(spark, name):
        if not spark.table(name).isEmpty():
            raise ValueError(f"WRITE_EMPTY: {name} already holds rows")
        mode = "overwrite"
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    props = dict(labels or {})
    if description is not None:
        props["comment"] = description
    if props:
        kv = ", ".join(f"'{k}' = '{str(v).replace(chr(39), chr(92) + chr(39))}'" for k, v in props.items())
        spark.sql(f"ALTER TABLE {_quote(name)} SET TBLPROPERTIES ({kv})")


def table_schema(spark: SparkSession, name: str):
    return spark.table(name).schema


def table_row_count(spark: SparkSession, name: str) -> int:
    return spark.table(name).count()
