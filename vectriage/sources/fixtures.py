"""Ticket and review views derived from the shared tables.

The triage and review operators expect ticket- and review-shaped tables.
These views derive them from ``orders``, ``embeddings``, ``documents`` and
``customer`` with joins and column expressions only, so their size grows
with the inputs.  The same views are written in DuckDB SQL in
``vectriage.plans.oracle`` for the cross-engine checks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectriage.functions.timefn import epoch_seconds_ntz
from vectriage.operators.partitioning import spread
from vectriage.sources.tables import read_table

# Fixed value: the "current time" for recency windows over the order dates.
TICKETS_AS_OF = dt.datetime(2001, 8, 2)


def tickets_fx(spark: SparkSession, sf_dir: str, searchable: bool = True) -> DataFrame:
    """Tickets: one row per order that has a vector in ``embeddings``.

    With ``searchable=False`` every order is a ticket; one without a vector has
    a null ``embedding`` and takes its category from the customer key.
    """
    o = read_table(spark, sf_dir, "orders")
    e = read_table(spark, sf_dir, "embeddings")
    status = (F.when(F.col("o_orderstatus") == "F", "resolved")
               .when(F.col("o_orderstatus") == "O", "open")
               .otherwise("in_progress"))
    resolved = F.col("o_orderstatus") == "F"
    priority = F.lower(F.substring("o_orderpriority", 3, 1 << 20))
    cols = [
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("Issue "), (F.col("o_orderkey") % 30).cast("string")).alias("title"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" for customer "),
                 F.col("o_custkey").cast("string")).alias("description"),
        F.concat(F.lit("cat"), F.coalesce("label", F.col("o_custkey") % 10).cast("string")).alias("category"),
        priority.alias("priority"),
        status.alias("status"),
        F.when(resolved & (F.col("o_orderkey") % 13 != 0),
               F.concat(F.lit("fix-"), (F.col("o_orderkey") % 12).cast("string"))).alias("resolution"),
        F.when(resolved, (F.lit(3) + F.col("o_custkey") % 3).cast("int")).alias("satisfaction_score"),
        F.when(resolved & (F.col("o_orderkey") % 7 != 0),
               F.col("o_totalprice") / F.lit(10000.0)).alias("resolution_time_hours"),
        F.col("o_custkey").alias("customer_id"),
        F.array(priority, status).alias("tags"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ]
    return o.join(e, e["vec_id"] == o["o_orderkey"], "inner" if searchable else "left").select(*cols)


def raw_reviews_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review rows (the CSV column names) from orders, documents and customers."""
    o = read_table(spark, sf_dir, "orders")
    # long texts: string work per row is CPU-heavy, give it every core
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    c = read_table(spark, sf_dir, "customer")
    return (o.join(d, d["doc_id"] == o["o_orderkey"])
             .join(c, c["c_custkey"] == o["o_custkey"])
             .select(
                 F.col("o_orderkey").cast("string").alias("Id"),
                 F.concat(F.lit("P"), (F.col("o_custkey") % 20).cast("string")).alias("ProductId"),
                 F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("UserId"),
                 F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string"))
                  .otherwise(F.col("c_name")).alias("ProfileName"),
                 F.floor((F.col("o_orderkey") % 40) * (F.col("o_custkey") % 11) / F.lit(10.0))
                  .cast("long").alias("HelpfulnessNumerator"),
                 (F.col("o_orderkey") % 40).alias("HelpfulnessDenominator"),
                 F.substring("o_orderpriority", 1, 1).cast("int").alias("Score"),
                 epoch_seconds_ntz("o_orderdate").alias("Time"),
                 F.when(F.col("o_orderkey") % 17 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit(" about "), F.col("source"), F.lit(" "))).alias("Summary"),
                 F.col("text").alias("Text"),
             ))
