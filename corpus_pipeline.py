"""Corpus pipeline: documents to token ids, through five of the llm operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the output
of one, written as Parquet, is the ``docs`` of the next.  All but the last
return the columns of ``documents``.

Edge cases: nulls, empty texts and empty tables go through as the operators
state.  Rows without an id cannot be told apart: the stages that compare
documents for near copies leave them as they are.  Rows equal in id and text are
copies of one document and leave one row; of an id of several texts each is a
document of its own.  Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectriage.llm import bpe, common, decontam, jaccard_join, pii_crf, quality_model, queries
from vectriage.session import ensure_checkpoint_dir
from vectriage.sources.sinks import drop_path

MOST_KEYS = 1_000_000          # of 8 or 16 bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality classifier accepts."""
    return quality_model.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of links of similarity 0.8 over five-word shingles.

    Where an id stands for several texts, each of them is judged by itself."""
    named = common.places(common.keyed_texts(docs))
    keyed, key = (docs, "doc_id") if named is None else (common.placed(docs, named), "_place")
    joined = jaccard_join.jaccard_join(keyed, n=5, num=80, den=100, id_col=key)
    dropped = common.keep(joined.where("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct())
    marked = keyed.where("doc_id is not null").withColumn("_mark", common.text_mark())
    again = common.keep(marked.groupBy("doc_id", "_mark").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id", "_mark"))
    few, more = _if_few(dropped), _if_few(again)
    left = marked.join(few, F.col(key).cast("long") == F.col("_dropped"), "left_anti")
    once = left.join(more, ["doc_id", "_mark"], "left_anti")
    twice = left.join(more, ["doc_id", "_mark"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(docs.columns).unionByName(twice.select(docs.columns)).unionByName(docs.where("doc_id is null"))


def _if_few(keys: DataFrame) -> DataFrame:
    """Keys to broadcast while they are at most ``MOST_KEYS``, so that texts stay where they are; more are joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also none with other numbers or names."""
    # By text: an id may be null or stand for several texts.
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    found = decontam.matches(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="text_key")
    found = found.select(F.col("doc_id").alias("_text_key")).distinct()
    return docs.join(found, F.xxhash64(docs["text"]) == found["_text_key"], "left_anti").select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets, and their new lengths."""
    return pii_crf.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian 32-bit integers."""
    return bpe.encode(docs, queries.tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private_data),
    ("BPE encoding and decoding", encoded),
]

#: No SQL: a trained scorer decides the first stage.  tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; stage outputs go to the shared folder of the session, where the last one stays."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:                                  # the stage before is read no more
            drop_path(spark, f"{shared}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
