"""Chunked transfer: row chunks of a frame and byte chunks of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.rowindex import ROW

ROWS_PER_CHUNK = 1000
FETCH_BYTES = 100 * 1024 * 1024
DOWNLOAD_BYTES = 5 * 1024 * 1024


def with_chunk(frame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """The frame with the number of the chunk each row travels in."""
    dense = frame.indexed()
    return dense.df.withColumn("chunk", F.floor(F.col(ROW) / rows))


def chunk_sizes(frame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """``chunk, n_rows`` of every chunk of a transfer; only the row count is needed."""
    total = frame.num_rows
    numbers = frame.df.sparkSession.range(-(-total // rows)).withColumnRenamed("id", "chunk")
    return numbers.withColumn("n_rows", F.least(F.lit(rows).cast("bigint"), F.lit(total) - F.col("chunk") * rows))


def stream_batches(frame, rows: int = ROWS_PER_CHUNK) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows`` rows (the last one shorter) in row order.

    Tasks hand over Arrow messages; the driver holds one partition at a time while the
    next is prefetched, and cuts the batches to size.
    """

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"message": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    held: list = []
    for row in frame.ordered.mapInArrow(pack, "message binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(row["message"]).read_all())
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held)
        whole = table.num_rows // rows * rows
        for start in range(0, whole, rows):
            yield table.slice(start, rows).combine_chunks().to_batches()[0]
        held = [table.slice(whole)] if whole < table.num_rows else []
    if held:
        yield pa.concat_tables(held).combine_chunks().to_batches()[0]


def chunk_plan(files: DataFrame, size: str = "size", chunk_bytes: int = FETCH_BYTES) -> DataFrame:
    """One row per byte range of each file: ``chunk_no, chunk_offset, chunk_length``."""
    last = F.floor((F.col(size) - 1) / chunk_bytes).cast("bigint")
    numbers = F.when(F.col(size) > 0, F.sequence(F.lit(0).cast("bigint"), last))
    spread = files.withColumn("chunk_no", F.explode(numbers))
    start = F.col("chunk_no") * chunk_bytes
    return spread.withColumn("chunk_offset", start).withColumn(
        "chunk_length", F.least(F.lit(chunk_bytes).cast("bigint"), F.col(size) - start)
    )
