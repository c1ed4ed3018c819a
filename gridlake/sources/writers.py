"""Frame output: CSV, JSON lines, Parquet and Arrow files, chosen by suffix or name."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from gridlake.sources.files import open_output, rename
from gridlake.sources.tables import CSV_OPTIONS, TIME_OPTIONS

# Format by output suffix.
FORMATS = {
    ".csv": "csv", ".arrow": "arrow", ".ipc": "arrow", ".json": "json", ".parquet": "parquet",
    ".nc": "netcdf", ".netcdf": "netcdf",
}


def write_frame(frame, output_path: str, format: str | None = None) -> None:
    """Write a folder of part files; parts follow the row order of the frame."""
    if format is None:
        suffix = os.path.splitext(output_path)[1].lower()
        if suffix not in FORMATS:
            raise ValueError(f"cannot tell the format of {output_path!r}; pass format=")
        format = FORMATS[suffix]
    if format == "csv":
        frame.ordered.write.options(**CSV_OPTIONS, **TIME_OPTIONS).option("emptyValue", "").csv(output_path)
    elif format == "json":
        frame.ordered.write.options(**TIME_OPTIONS).option("ignoreNullFields", False).json(output_path)
    elif format == "parquet":
        frame.ordered.write.parquet(output_path)
    elif format == "arrow":
        write_arrow(frame.ordered, output_path)
    elif format == "netcdf":
        from gridlake.sources.netcdf import write_columns

        write_columns(frame.indexed(), output_path)
    else:
        raise NotImplementedError(f"unsupported output format: {format}")


def write_arrow(df: DataFrame, folder: str) -> int:
    """One Arrow IPC file per task; returns the number of rows written.

    Each attempt writes under its own name and moves the file into place when done,
    so a repeated task leaves one complete file.
    """
    schema = to_arrow_schema(df.schema)

    def write(batches):
        part = TaskContext.get().partitionId()
        done = f"{folder}/part-{part:06d}.arrow"
        trying = f"{folder}/.trying-{part:06d}-{uuid.uuid4().hex}"
        rows = 0
        with open_output(trying) as sink, pa.ipc.new_file(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(schema) if batch.schema != schema else batch)
                rows += batch.num_rows
        rename(trying, done)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    counts = df.mapInArrow(write, "rows bigint")
    return counts.agg({"rows": "sum"}).first()[0] or 0
