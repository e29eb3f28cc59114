"""CSV with quoted line breaks, read by many tasks per file.

Spark's multi-line reader takes one task per file, as only a scan from the
start knows which line breaks are inside quotes.  Here the lines are read in
splits.  Quotes come in pairs inside a record, so a line break ends a record
when the number of quotes before it is even:

1. every split reports its number of quotes (odd or even) and whether a line of
   it would start a record if the split began inside quotes;
2. prefix sums over the splits of a file (a row per split) tell for each whether
   it begins inside quotes, and in which split the record begun there starts;
3. every split cuts its lines into records.  At most two records of a split
   reach into others; their pieces are put together by the split in which the
   record starts.

Records are then parsed by Spark's CSV parser.  One that does not fit the schema
keeps its text in a column of its own.  Quotes inside quotes are doubled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split): the lines of every split in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _runs(batch: pa.RecordBatch):
    """(first row, end) of the runs of one split in a batch."""
    split = batch.column("split").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((np.diff(split) != 0) | (np.diff(file) != 0)) + 1
    return zip(np.r_[0, cut].tolist(), np.r_[cut, len(split)].tolist())


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, inside, opener): whether a split begins inside quotes, and the split where that record starts."""
    def run(batches):
        at, odd, seen, out = None, 0, False, []

        def row():
            return (*at, odd, seen)

        for batch in batches:
            if not batch.num_rows:
                continue
            quotes = pc.count_substring(batch.column("value"), QUOTE).to_numpy()
            for lo, hi in _runs(batch):
                here = (batch.column("file")[lo].as_py(), batch.column("split")[lo].as_py())
                if here != at:
                    if at is not None:
                        out.append(row())
                    at, odd, seen = here, 0, False
                before = (odd + np.r_[0, np.cumsum(quotes[lo:hi])]) % 2
                seen = seen or bool(before[:-1].any())          # a line after an odd number of quotes
                odd = int(before[-1])
        if at is not None:
            out.append(row())
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "split", "odd", "seen"), r)) for r in out],
                                         schema=pa.schema([("file", pa.string()), ("split", pa.int64()), ("odd", pa.int32()), ("seen", pa.bool_())]))

    # A split is one run of one task.
    found = _lines(spark, path).mapInArrow(run, "file string, split long, odd int, seen boolean")
    w = Window.partitionBy("file").orderBy("split")
    before = F.coalesce(F.sum("odd").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    states = found.withColumn("inside", before == 1)
    # A split leaves a record of its own open when it ends inside quotes and a line of it starts a record.
    leaves = ((F.when(F.col("inside"), 1).otherwise(0) + F.col("odd")) % 2 == 1) & (~F.col("inside") | F.col("seen"))
    opener = F.last(F.when(leaves, F.col("split")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return states.select("file", "split", "inside", F.when(F.col("inside"), opener).alias("opener"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, record): the text of every record; ``at`` counts the records that start in a split."""
    lines = _lines(spark, path).join(F.broadcast(split_states(spark, path)), ["file", "split"])      # a row per split

    def run(batches):
        at, odd, number, held, origin = None, 0, 0, [], None
        file, split, no, part, text = [], [], [], [], []

        def put(done: bool):
            # ``origin``: None for a record that starts here
            file.append(at[0])
            split.append(at[1] if origin is None else origin)
            no.append(number if done and origin is None else None)
            part.append(at[1])
            text.append("\n".join(held))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(split, pa.int64()), pa.array(no, pa.int64()), pa.array(part, pa.int64()),
                                              pa.array(text, pa.string())], names=["file", "split", "at", "part", "text"])
            for x in (file, split, no, part, text):
                x.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("value").to_pylist()
            quotes = pc.count_substring(batch.column("value"), QUOTE).to_numpy()
            for lo, hi in _runs(batch):
                here = (batch.column("file")[lo].as_py(), batch.column("split")[lo].as_py())
                if here != at:
                    if held:
                        put(False)
                    at, number, held = here, 0, []
                    odd = int(batch.column("inside")[lo].as_py())
                    origin = batch.column("opener")[lo].as_py() if odd else None
                for value, n in zip(values[lo:hi], quotes[lo:hi].tolist()):
                    held.append(value)
                    odd = (odd + n) % 2
                    if not odd:
                        put(True)
                        number += origin is None
                        held, origin = [], None
            yield flush()
        if held:
            put(False)
        yield flush()

    pieces = lines.mapInArrow(run, "file string, split long, at long, part long, text string")
    # A record that reaches over splits has one piece in each; a split has at most one that it leaves open.
    pieces = pieces.withColumn("_open", F.col("at").isNull())
    whole = pieces.where("not _open").select("file", "split", "at", F.col("text").alias("record"))
    joined = (pieces.where("_open").groupBy("file", "split").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
              .select("file", "split", F.lit(None).cast("long").alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("record")))
    return whole.unionByName(joined)


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, corrupt_col: str = "_malformed") -> DataFrame:
    """The records of ``path`` by ``schema``, with the text of a record that does not fit it in ``corrupt_col``."""
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
    if header:                                  # the first record of a file, and never one that spans splits
        records = records.where(~((F.col("split") == 0) & F.coalesce(F.col("at") == 0, F.lit(False))))
    full = T.StructType([*schema.fields, T.StructField(corrupt_col, T.StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    parsed = F.from_csv("record", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col, "quote": QUOTE, "escape": QUOTE,
                                        "multiLine": "true", "maxCharsPerColumn": "-1"})
    return records.select(parsed.alias("r")).select("r.*")
