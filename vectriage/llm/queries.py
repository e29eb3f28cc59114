"""The registered queries of this folder: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectriage.llm import (bpe, chat, decontam, jaccard_join, line_dedup, oracle, pii_crf, quality_model, quality_rules,
                           recompress_dedup, source_audit, suffix_dedup, toxicity, whitening)

TOKENIZER = "word_bpe_49k.json"
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their 4-word shingle counts and the component of links of similarity 0.85."""
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of a linear scorer trained on weak labels."""
    return quality_model.classify(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items whose templates they contain."""
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one full of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.read_back(chat.format_turns(rows.unionByName(more)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics of documents and the verdict of risk-controlled cutoffs."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of documents by fixed patterns and a random field."""
    return pii_crf.pii_digest(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity scores of documents."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of earlier 100-byte strings."""
    return suffix_dedup.repeats_digest(_table(spark, sf_dir, "documents"), width=100)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of earlier 20-word windows."""
    return recompress_dedup.repeats_digest(_table(spark, sf_dir, "documents"), width=20)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the sources of each language from one another and, term by term, from the language."""
    return source_audit.audit(_table(spark, sf_dir, "documents"), min_df=3, top=200)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the four leading components of their exact covariance, whitened."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), k=4, id_col="vec_id")
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more hold, but for the last holder."""
    return line_dedup.dedup_digest(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_bpe, op3_quality_classifier, op4_decontamination, op5_chat_formatting, op6_quality_rules, op7_pii, op8_toxicity,
    op9_suffix_array_dedup, op10_substring_dedup, op11_source_audit, op12_whitening, op13_line_dedup)}

ORACLE: dict[str, str] = dict(oracle.ORACLE)
