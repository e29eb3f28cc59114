"""Embedding coverage and quality checks (single aggregates or filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectriage.functions.numeric import round_half_away


def embedding_coverage(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """total rows, rows with a vector, and the percentage (one partial aggregate)."""
    return (df.agg(F.count(F.lit(1)).alias("total"), F.count(vec_col).alias("with_embeddings"))
              .withColumn("coverage_pct", F.when(F.col("total") > 0, round_half_away(
                  F.col("with_embeddings") * F.lit(100.0) / F.col("total").cast("double"), 2))))


def embedding_stats(df: DataFrame, vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """Width statistics and the mean / sample deviation of the first dimension."""
    def r(c):
        return c if digits is None else round_half_away(c, digits)
    v = df.where(F.col(vec_col).isNotNull())
    first = F.get(F.col(vec_col), 0).cast("double")
    return v.agg(
        F.lit("Embedding Statistics").alias("metric_type"),
        F.count(F.lit(1)).alias("total_embeddings"),
        F.avg(F.size(vec_col)).alias("avg_dimensions"),
        F.min(F.size(vec_col)).cast("long").alias("min_dimensions"),
        F.max(F.size(vec_col)).cast("long").alias("max_dimensions"),
        r(F.avg(first)).alias("avg_first_dim"),
        r(F.stddev_samp(first)).alias("stddev_first_dim"),
    )


def embedding_status(vec_col: str = "embedding", dim: int = 768):
    c = F.col(vec_col)
    return (F.when(c.isNull(), "Missing embedding")
             .when(F.size(c) != dim, "Wrong dimensions").otherwise("OK"))


def embedding_issues(df: DataFrame, id_col: str, dim: int, vec_col: str = "embedding",
                     cols: tuple = ()) -> DataFrame:
    """Rows whose vector is missing or not ``dim`` wide."""
    c = F.col(vec_col)
    return (df.where(c.isNull() | (F.size(c) != dim))
              .select(id_col, *cols, F.when(c.isNotNull(), F.size(c).cast("long")).alias("embedding_dims"),
                      embedding_status(vec_col, dim).alias("embedding_status")))


def embedding_sample(df: DataFrame, id_col: str, vec_col: str = "embedding", n_values: int = 5,
                     fmt: str | None = None) -> DataFrame:
    """Width and the first values (as strings, or ``format_string(fmt)``) of each vector."""
    c = F.col(vec_col)

    def show(x):
        return x.cast("string") if fmt is None else F.format_string(fmt, x)
    return df.select(id_col, F.size(c).cast("long").alias("dimensions"),
                     F.array_join(F.transform(F.slice(c, 1, n_values), show), ",").alias("first_values"))
