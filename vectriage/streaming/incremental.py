"""Embed only new or changed rows and append them (change capture by key).

A row needs a vector when its (id, text hash) pair is not in the stored
vectors: either the id is new or its text changed.  The anti join is an
equi-join on the key; only those rows go through the embedder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectriage.functions.embed import HashingEmbedder


def rows_to_embed(source: DataFrame, stored: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Source rows whose (id, sha-256 of text) is not stored yet."""
    src = source.withColumn("text_hash", F.sha2(F.col(text_col), 256))
    have = stored.select(F.col(id_col).alias("_have_id"), F.col("text_hash").alias("_have_hash"))
    # null-safe: a row whose text is null is stored once, not on every run
    return src.join(have, src[id_col].eqNullSafe(have["_have_id"]) & src["text_hash"].eqNullSafe(have["_have_hash"]), "left_anti")


def incremental_embed(source: DataFrame, stored: DataFrame, id_col: str, text_col: str,
                      embedder=None) -> DataFrame:
    """Vectors for the new or changed rows: (id, text_hash, embedding)."""
    embedder = embedder or HashingEmbedder()
    todo = rows_to_embed(source, stored, id_col, text_col)
    return embedder.transform(todo, text_col).select(id_col, "text_hash", "embedding")


def append_batch(source: DataFrame, path: str, id_col: str, text_col: str, embedder=None) -> int:
    """Embed the new or changed rows of ``source`` and append them to the vectors at ``path`` as the next batch; its number.

    The batch is a folder ``batch_id=N`` written with overwrite, so a batch that was lost half way is written again whole."""
    spark = source.sparkSession
    from vectriage.sources.sinks import table_info
    info = table_info(spark, path)
    stored = spark.read.parquet(path) if info["exists"] and info["row_count"] else None
    last = stored.agg(F.max("batch_id")).first()[0] if stored is not None else None
    number = 1 if last is None else int(last) + 1
    have = current_vectors(stored, id_col) if stored is not None else source.select(id_col, F.lit("").alias("text_hash")).where("false")
    incremental_embed(source, have, id_col, text_col, embedder).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
    return number


def current_vectors(stored: DataFrame, id_col: str, version_col: str = "batch_id") -> DataFrame:
    """The latest vector per id when appended batches change a text."""
    from pyspark.sql import Window
    w = Window.partitionBy(id_col).orderBy(F.desc(version_col))
    return stored.withColumn("_v", F.row_number().over(w)).where(F.col("_v") == 1).drop("_v")
