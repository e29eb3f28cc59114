"""Ticket table operations: schema enforcement, combined text, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.functions.numeric import round_half_away

# The typed ticket table (name, type, nullable, default).
TICKET_COLUMNS = (
    ("ticket_id", "bigint", False, None),
    ("created_at", "timestamp_ntz", False, None),
    ("updated_at", "timestamp_ntz", True, None),
    ("resolved_at", "timestamp_ntz", True, None),
    ("title", "string", False, None),
    ("description", "string", False, None),
    ("category", "string", False, None),
    ("priority", "string", False, None),
    ("status", "string", False, None),
    ("resolution", "string", True, None),
    ("resolution_time_hours", "double", True, None),
    ("customer_id", "string", True, None),
    ("customer_tier", "string", True, None),
    ("assigned_agent_id", "string", True, None),
    ("assigned_team", "string", True, None),
    ("satisfaction_score", "bigint", True, None),
    ("reopened_count", "bigint", True, 0),
    ("combined_text", "string", False, None),
    ("tags", "array<string>", True, None),
    ("source_channel", "string", True, None),
    ("language", "string", True, "en"),
)


def ticket_schema(id_type: str = "bigint") -> T.StructType:
    """The declared schema; ids are numbers or, with ``id_type='string'``, texts."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(id_type if n == "ticket_id" else t), nullable)
                         for n, t, nullable, _ in TICKET_COLUMNS])


def combined_text(title="title", description="description", missing_as_empty: bool = False):
    """title || ' ' || description.  With ``missing_as_empty`` a null part
    counts as '' (the batch form); otherwise a null part gives null."""
    t, d = F.col(title), F.col(description)
    if missing_as_empty:
        return F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(d, F.lit("")))
    return F.concat(t, F.lit(" "), d)


def enforce_schema(df: DataFrame, columns=TICKET_COLUMNS, on_violation: str = "drop") -> DataFrame:
    """Cast to the declared types, fill defaults, add missing nullable
    columns as null (ticket ids that are texts stay texts), and handle rows with a null in a required column:
    ``'drop'`` removes them, ``'flag'`` keeps them with ``_violation = true``,
    ``'fail'`` raises on the first action via ``assert_true``."""
    cols, required = [], []
    for name, typ, nullable, default in columns:
        if name == "ticket_id" and name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
            typ = "string"
        c = F.col(name).cast(typ) if name in df.columns else F.lit(None).cast(typ)
        if default is not None:
            c = F.coalesce(c, F.lit(default).cast(typ))
        cols.append(c.alias(name))
        if not nullable:
            required.append(name)
    out = df.select(*cols)
    bad = None
    for name in required:
        cond = F.col(name).isNull()
        bad = cond if bad is None else (bad | cond)
    if bad is None:
        return out
    if on_violation == "drop":
        return out.where(~bad)
    if on_violation == "flag":
        return out.withColumn("_violation", bad)
    if on_violation == "fail":
        return out.where(F.assert_true(~bad, "required ticket column is null").isNull())
    raise ValueError("on_violation must be 'drop', 'flag' or 'fail'")


def tickets_by_category(df: DataFrame) -> DataFrame:
    return (df.groupBy("category").agg(F.count(F.lit(1)).alias("ticket_count"))
              .orderBy(F.desc("ticket_count"), "category"))


def status_share(df: DataFrame) -> DataFrame:
    """Count and percentage per status; the total is a window over the
    already-aggregated rows (a handful), never over the table."""
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", round_half_away(F.col("count") * F.lit(100.0) / total, 2))


def ticket_summary(df: DataFrame) -> DataFrame:
    """Load summary: rows, distinct categories, resolved, with a solution, per-status counts."""
    return df.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_distinct("category").alias("categories"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count("resolution").alias("with_solution"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "in_progress").alias("in_progress"),
    )
