"""Triage new tickets as they arrive (Structured Streaming).

New ticket vectors are read as a file stream; every micro-batch is
triaged against the static base of historical tickets with the same
batch operators (one search per batch).  A ticket is compared with the
base only, not with other tickets of its own batch.

Each micro-batch is written to ``{sink}/epoch_id=N`` with overwrite, so
a batch replayed after a failure replaces its own output instead of
duplicating it; the stream's progress lives in ``checkpoint``, which must
be on shared storage (the session's ``spark.checkpoint.dir`` by default).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectriage.operators.triage import triage
from vectriage.session import ensure_checkpoint_dir


def start_triage_stream(spark: SparkSession, source: DataFrame, base: DataFrame, sink: str, checkpoint: str,
                        id_col: str = "query_id", vec_col: str = "embedding", available_now: bool = True,
                        **triage_opts):
    """Start the stream; returns the StreamingQuery."""
    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        queries = batch.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
        res = triage(base, queries, **triage_opts)
        flat = res.select(
            "query_id", "category", "category_confidence", "priority", "solution", "confidence",
            "similar_ticket_count",
            F.array_join(F.transform("similar_tickets", lambda x: x["ticket_id"].cast("string")), ",")
             .alias("similar_ids"), "error")
        flat.write.mode("overwrite").parquet(f"{sink}/epoch_id={epoch_id}")

    writer = source.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def triage_files(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, base: DataFrame,
                 id_col: str, vec_col: str = "embedding", files_per_batch: int | None = None, **triage_opts) -> DataFrame:
    """Run the stream over the files available now and return what it wrote."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/triage-stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    source = reader.parquet(folder)
    q = start_triage_stream(spark, source, base, f"{root}/out", f"{root}/checkpoint", id_col, vec_col,
                            **triage_opts)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(f"{root}/out")
