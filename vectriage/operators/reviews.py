"""Review tables: typed load, enrichment, filters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.functions.bands import sentiment_from_score
from vectriage.functions.numeric import round_half_away, safe_ratio
from vectriage.functions.text import preview, stars, strip_ws
from vectriage.functions.timefn import ntz_from_epoch_seconds

# The raw review CSV columns and their types.
RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()),
    T.StructField("ProductId", T.StringType()),
    T.StructField("UserId", T.StringType()),
    T.StructField("ProfileName", T.StringType()),
    T.StructField("HelpfulnessNumerator", T.LongType()),
    T.StructField("HelpfulnessDenominator", T.LongType()),
    T.StructField("Score", T.IntegerType()),
    T.StructField("Time", T.LongType()),
    T.StructField("Summary", T.StringType()),
    T.StructField("Text", T.StringType()),
])

# Tokens a pandas CSV reader turns into missing values.
CSV_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                   "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The enriched review table (19 columns).
ENRICHED_REVIEW_COLUMNS = (
    "review_id", "product_id", "user_id", "profile_name", "helpfulness_numerator",
    "helpfulness_denominator", "score", "time_unix", "summary", "text", "review_date",
    "helpfulness_ratio", "combined_text", "sentiment_category", "is_helpful", "text_length",
    "summary_length", "created_at", "updated_at")


def read_reviews_csv(spark: SparkSession, path: str, corrupt_col: str | None = None) -> DataFrame:
    """Read the raw review CSV with an explicit schema (quoted, multi-line).

    One file is read by many tasks (``sources/csv_records.py``).  String
    columns holding one of the pandas missing-value tokens become null, as the
    pandas reader would make them.  ``corrupt_col`` keeps the text of records
    that do not fit the schema, whose fields are then null where they do not.
    """
    from vectriage.sources.csv_records import read_csv_records

    raw = read_csv_records(spark, path, RAW_REVIEW_SCHEMA, corrupt_col="_malformed")
    cols = []
    for f in RAW_REVIEW_SCHEMA.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(list(CSV_NULL_TOKENS)), F.lit(None).cast("string")).otherwise(c).alias(f.name)
        cols.append(c)
    if corrupt_col:
        cols.append(F.col("_malformed").alias(corrupt_col))
    return raw.select(*cols)


def enrich_reviews(raw: DataFrame) -> DataFrame:
    """Rename, cast, fill and derive the 19 enriched review columns."""
    summary = F.coalesce(F.col("Summary"), F.lit(""))
    text = F.coalesce(F.col("Text"), F.lit(""))
    review_date = ntz_from_epoch_seconds(F.col("Time"))
    ratio = safe_ratio("HelpfulnessNumerator", "HelpfulnessDenominator")
    combined = strip_ws(F.concat(strip_ws(summary), F.lit(". "), strip_ws(text)))
    return raw.select(
        F.col("Id").cast("string").alias("review_id"),
        F.col("ProductId").alias("product_id"),
        F.col("UserId").alias("user_id"),
        F.coalesce(F.col("ProfileName"), F.lit("Anonymous")).alias("profile_name"),
        F.col("HelpfulnessNumerator").cast("long").alias("helpfulness_numerator"),
        F.col("HelpfulnessDenominator").cast("long").alias("helpfulness_denominator"),
        F.col("Score").cast("int").alias("score"),
        F.col("Time").cast("long").alias("time_unix"),
        summary.alias("summary"),
        text.alias("text"),
        review_date.alias("review_date"),
        ratio.alias("helpfulness_ratio"),
        combined.alias("combined_text"),
        sentiment_from_score(F.col("Score")).alias("sentiment_category"),
        ((ratio >= 0.7) & (F.col("HelpfulnessDenominator") >= 5)).alias("is_helpful"),
        F.length(text).alias("text_length"),
        F.length(summary).alias("summary_length"),
        review_date.alias("created_at"),
        review_date.alias("updated_at"),
    )


def sample_fixed_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "review_id") -> DataFrame:
    """A fixed-size sample: the n rows with the smallest md5(seed || id).

    n = 0 keeps every row.  Keys are counted by their first four hex digits
    (65,536 counts, partial per task).  The counts name the digits in which the
    n-th key lies: rows below are kept where they are, rows above dropped, and
    only the rows of those digits (N / 65,536 of them) are ranked for the rest.
    Nothing runs when the plan is made, and no task sorts n rows.
    """
    if n <= 0:
        return df
    keyed = df.withColumn("_sample_key", F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string"))))
    keyed = keyed.withColumn("_digits", F.coalesce(F.substring("_sample_key", 1, 4), F.lit("")))
    counts = keyed.groupBy("_digits").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.orderBy("_digits"))       # over the counts, not the rows
    cut = (counts.withColumn("_upto", upto).where(F.col("_upto") - F.col("_rows") < n)
           .agg(F.max("_digits").alias("_cut"), (F.lit(n) - F.max(F.col("_upto") - F.col("_rows"))).alias("_left")))
    near = keyed.join(F.broadcast(cut), F.col("_digits") <= F.col("_cut"))      # one row
    whole = near.where("_digits < _cut")
    w = Window.partitionBy("_digits").orderBy("_sample_key", id_col)
    last = near.where("_digits = _cut").withColumn("_at", F.row_number().over(w)).where("_at <= _left")
    return whole.select(*df.columns).unionByName(last.select(*df.columns))


def product_reviews(reviews: DataFrame, product_id: str, min_score: int = 1, limit: int = 20) -> DataFrame:
    """Reviews of one product with score >= min_score, most helpful first."""
    return (reviews.where((F.col("product_id") == F.lit(product_id)) & (F.col("score") >= min_score))
                   .select("review_id", "score", "summary", "text", "helpfulness_ratio", "sentiment_category",
                           "profile_name", "review_date")
                   .orderBy(F.desc("helpfulness_ratio"), F.desc("score"), "review_id")
                   .limit(limit))


def helpful_reviews(reviews: DataFrame, min_score: int = 4, min_helpful_ratio: float = 0.8,
                    min_votes: int = 10, limit: int = 20) -> DataFrame:
    """Highly rated reviews that many readers found helpful."""
    return (reviews.where((F.col("score") >= min_score)
                          & (F.col("helpfulness_ratio") >= min_helpful_ratio)
                          & (F.col("helpfulness_denominator") >= min_votes))
                   .select("review_id", "product_id", "score", "summary", "helpfulness_numerator",
                           "helpfulness_ratio")
                   .orderBy(F.desc("helpfulness_numerator"), F.desc("helpfulness_ratio"), "review_id")
                   .limit(limit))


def custom_review_filter(reviews: DataFrame, min_score: int = 4, min_ratio: float = 0.8,
                         min_votes: int = 10, helpful_only: bool = True, limit: int = 100) -> DataFrame:
    """Ad hoc filter: score, helpful flag, ratio and votes; the ``limit``
    reviews with the most helpful votes (then id)."""
    cond = ((F.col("score") >= min_score) & (F.col("helpfulness_ratio") >= min_ratio)
            & (F.col("helpfulness_denominator") >= min_votes))
    if helpful_only:
        cond = cond & F.col("is_helpful")
    return (reviews.where(cond)
                   .select("review_id", "product_id", "score", "helpfulness_numerator", "helpfulness_ratio")
                   .orderBy(F.desc("helpfulness_numerator"), "review_id").limit(limit))


def review_statistics(reviews: DataFrame, digits: int | None = None) -> DataFrame:
    """One row of dataset statistics (a single aggregate, partial per task)."""
    def r(c):
        return c if digits is None else round_half_away(c, digits)
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count_distinct("user_id").alias("unique_users"),
        F.date_format(F.min("review_date"), "yyyy-MM-dd").alias("date_start"),
        F.date_format(F.max("review_date"), "yyyy-MM-dd").alias("date_end"),
        F.sum(F.col("is_helpful").cast("long")).alias("helpful_reviews"),
        r(F.avg("helpfulness_ratio")).alias("avg_helpfulness_ratio"),
        r(F.avg("text_length")).alias("avg_text_length"),
    )


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Count and share of reviews per score (share over the aggregated rows)."""
    counts = reviews.groupBy("score").agg(F.count(F.lit(1)).alias("review_count"))
    total = F.sum("review_count").over(Window.partitionBy())
    return counts.withColumn("pct", round_half_away(F.col("review_count") * F.lit(100.0) / total, 2))


def review_preview(reviews: DataFrame) -> DataFrame:
    """Display columns: stars, 200-character preview, helpful percent."""
    return reviews.select(
        "review_id",
        stars("score").alias("stars"),
        preview("text").alias("text_preview"),
        F.format_string("%d%%", round_half_away(F.col("helpfulness_ratio") * 100.0, 0).cast("long"))
         .alias("helpful_pct"),
    )
