"""Columnar and text tables: Parquet, CSV, JSON lines, Arrow files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from gridlake.frame import Frame
from gridlake.functions.nulls import is_float
from gridlake.operators.pruning import ScanFiles
from gridlake.operators.rowindex import ROW, line_index, scan_index
from gridlake.sources.files import list_files, open_input, spread

# Quotes are doubled inside quoted cells.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}

# Times are written with all their microseconds.
TIME_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def read_parquet(spark: SparkSession, path: str) -> Frame:
    """A Parquet scan in file order; the row positions cost no shuffle of the rows."""
    whole = spark.read.parquet(path)

    def read(files: list[str] | None):
        return whole if files is None else _below(spark.read.schema(whole.schema), path, files).parquet(*files)

    return Frame(scan_index(whole), dense=True, scan=ScanFiles(read, scan_index))


def _below(reader, path: str, files: list[str]):
    """Files of a folder keep the columns that the names of its subfolders give."""
    inner = all(f.rstrip("/") != path.rstrip("/") and not f.endswith(path) for f in files)
    return reader.option("basePath", path) if inner and not any(c in path for c in "*?[{,") else reader


def _by_line(df):
    return line_index(df, F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))


def _text_frame(spark: SparkSession, path: str, reader, kind: str, finish=lambda df: df) -> Frame:
    """A text scan in the order of files and lines; later reads of some files keep its types."""
    whole = getattr(reader, kind)(path)

    def read(files: list[str] | None):
        if files is None:
            return whole
        return getattr(_below(reader.schema(whole.schema), path, files), kind)(files)

    scan = ScanFiles(read, _by_line, finish, lines=True)
    return Frame(scan.number(whole), dense=True, scan=scan)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Frame:
    """A CSV scan with a header row, in file order.

    Without ``schema`` Spark reads the data once more to find the types; pass one for
    large inputs.  Empty cells are null in typed columns and ``''`` in text columns;
    a NaN cell is null.
    """
    reader = spark.read.options(**CSV_OPTIONS)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return _text_frame(
        spark, path, reader, "csv", lambda df: df.withColumns({f.name: _cell(f) for f in df.schema.fields if f.name != ROW})
    )


def _cell(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(column, F.lit(""))
    if isinstance(field.dataType, T.IntegerType):
        return column.cast("bigint")
    if isinstance(field.dataType, T.TimestampType):
        return column.cast("timestamp_ntz")
    if is_float(field.dataType):
        return F.when(~F.isnan(column), column)
    return column


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Frame:
    reader = spark.read.schema(schema) if schema else spark.read
    return _text_frame(spark, path, reader, "json")


def read_arrow(spark: SparkSession, path: str) -> Frame:
    """Arrow IPC files of a folder, in file order.

    A first pass lists the record batches of every file, so that the batches of one
    large file are read by many tasks.
    """
    files = list_files(spark, path, "*.arrow").select("path")
    first = files.limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no .arrow file under {path}")
    with open_input(first[0][0]) as source:
        schema = pa.ipc.open_file(source).schema

    def count_batches(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with open_input(name) as source:
                    n = pa.ipc.open_file(source).num_record_batches
                yield pa.RecordBatch.from_pydict({"path": [name], "n": pa.array([n], pa.int64())})

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as source:
                    rows = pa.ipc.open_file(source).get_batch(row["batch_no"])
                if sorted(rows.schema.names) != sorted(schema.names):
                    raise ValueError(f"{row['path']} has other columns than the first file of the folder")
                rows = rows.select(schema.names)
                if row["file_no"] >= 1 << 19 or row["batch_no"] >= 1 << 20 or rows.num_rows > 1 << 24:
                    raise ValueError(f"{row['path']}: too many files, batches or rows in a batch for row positions")
                start = (row["file_no"] << 44) + (row["batch_no"] << 24)
                position = pa.array(range(start, start + rows.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, position], [*schema.names, ROW])

    # one row per file
    numbered = files.withColumn("file_no", F.row_number().over(Window.orderBy("path")) - 1)
    sizes = spread(files, "path").mapInArrow(count_batches, "path string, n bigint").where("n > 0")
    plan = numbered.join(sizes, "path").select(
        "path", F.col("file_no").cast("bigint").alias("file_no"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("batch_no"),
    )
    rows = spread(plan, "path", "batch_no").mapInArrow(
        read, from_arrow_schema(schema, prefer_timestamp_ntz=True).add(ROW, "long")
    )
    return Frame(rows)
