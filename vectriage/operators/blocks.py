"""Rows kept in compressed blocks, in the shared checkpoint folder.

A plain checkpoint writes vectors at full width; here a binary value holds a
block of rows as an Arrow file (LZ4), read back in the same order and with
the same values.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectriage.session import ensure_checkpoint_dir

BLOCK_ROWS = 4096


def write_block(batches: list[pa.RecordBatch], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_block(block) -> pa.ipc.RecordBatchFileReader:
    """Its batches can be read one at a time."""
    return pa.ipc.open_file(block, options=pa.ipc.IpcReadOptions(use_threads=False))


def unpacked(blocks: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of blocks, the first column of ``blocks``."""
    def run(batches):
        for rb in batches:
            for block in rb.column(0):
                held = open_block(block.as_buffer())
                yield from (held.get_batch(i) for i in range(held.num_record_batches))

    return blocks.mapInArrow(run, schema)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept, as ``checkpoint`` does, in compressed blocks of at most ``BLOCK_ROWS`` rows."""
    ensure_checkpoint_dir(df.sparkSession)

    def run(batches):
        for rb in (b.slice(lo, BLOCK_ROWS) for b in batches for lo in range(0, b.num_rows, BLOCK_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([write_block([rb], rb.schema)], pa.binary())], names=["block"])
        pa.default_memory_pool().release_unused()

    return unpacked(df.mapInArrow(run, "block binary").checkpoint(), df.schema)
