"""File contents as columns: whole blobs and byte ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlake.sources.files import open_input, spread
from gridlake.streaming.chunks import FETCH_BYTES, chunk_plan


def _read(path: str, start: int = 0, length: int | None = None) -> bytes | None:
    try:
        with open_input(path) as source:
            source.seek(start)
            return source.read(length) if length is not None else source.read()
    except OSError:
        return None


def load_blobs(files: DataFrame, root: str = "") -> DataFrame:
    """Fill the ``blob`` column with the bytes at ``root || path``; null if unreadable.

    The paths are spread over all tasks, then each task reads its files one at a time;
    contents never cross a shuffle.  Use :func:`load_chunks` for files too large for one value.
    """
    schema = files.schema

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path = row.column("path")[0].as_py()
                blob = _read(root + path) if path is not None else None
                at = row.schema.get_field_index("blob")
                yield row.set_column(at, "blob", pa.array([blob], pa.binary()))

    return spread(files, "path").mapInArrow(read, schema)


def load_chunks(files: DataFrame, root: str = "", chunk_bytes: int = FETCH_BYTES) -> DataFrame:
    """``path, chunk_no, chunk_offset, chunk_length, bytes`` of every file, range by range.

    Ranges are spread over all tasks, so one huge file is read by many of them.  A file that is gone
    or shorter than its size fails the job: a transfer is whole or none.
    """
    plan = chunk_plan(files.select("path", "size"), "size", chunk_bytes).drop("size")
    schema = plan.schema.add("bytes", "binary")

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                path, start, length = (
                    part.column(c)[0].as_py() for c in ("path", "chunk_offset", "chunk_length")
                )
                found = _read(root + path, start, length)
                if found is None or len(found) != length:
                    raise OSError(f"{root + path}: {'unreadable' if found is None else len(found)}, expected {length} bytes at {start}")
                data = pa.array([found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*part.schema.names, "bytes"])

    return spread(plan, "path", "chunk_no").mapInArrow(read, schema)
