"""Corpus build: load, enrich, statistics, embed, write, index.

The stages are plain DataFrame steps; the embedded table is written once
and read back, which cuts the lineage before the index build reads it
several times (k-means passes).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectriage.functions.embed import HashingEmbedder
from vectriage.operators.reviews import enrich_reviews, review_statistics, sample_fixed_n


@dataclass
class Corpus:
    reviews: DataFrame
    statistics: DataFrame
    index: object | None


def build_corpus(spark: SparkSession, raw_reviews: DataFrame, out: str, embedder=None, sample_size: int = 0,
                 seed: int = 42, build_index: bool = True, num_lists: int | None = None) -> Corpus:
    """Enrich and embed raw reviews into ``{out}/reviews`` (Parquet),
    optionally build an IVF index into ``{out}/index``."""
    from vectriage.operators.ivf import build_ivf, load_ivf, save_ivf

    embedder = embedder or HashingEmbedder()
    enriched = enrich_reviews(raw_reviews)
    if sample_size:
        enriched = sample_fixed_n(enriched, sample_size, seed)
    embedded = embedder.transform(enriched, "combined_text")
    embedded.write.mode("overwrite").parquet(f"{out}/reviews")
    reviews = spark.read.parquet(f"{out}/reviews")
    stats = review_statistics(reviews)
    index = None
    if build_index:
        save_ivf(build_ivf(reviews, "review_id", "embedding", num_lists=num_lists), f"{out}/index")
        index = load_ivf(spark, f"{out}/index", "review_id")
    return Corpus(reviews, stats, index)


def corpus_summary(corpus: Corpus) -> DataFrame:
    return corpus.reviews.select(
        "review_id", "score", "sentiment_category",
        F.coalesce(F.size(F.filter("embedding", lambda x: x > 0)), F.lit(0)).cast("long").alias("nonzero_buckets"))
