"""Open, count and sample a path by its suffix."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.operators import profile
from gridlake.sources import files, netcdf, tables, tiff

READERS = {
    ".csv": tables.read_csv,
    ".parquet": tables.read_parquet,
    ".arrow": tables.read_arrow,
    ".nc": netcdf.open_cells,
    ".tif": tiff.open_cells,
    ".tiff": tiff.open_cells,
}

# formats that tell count and sample without reading the data
HEADED = {".nc": netcdf, ".tif": tiff, ".tiff": tiff}


def _suffix(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix and suffix not in READERS:
        raise ValueError(f"Unsupported file extension: {suffix}")
    return suffix


def open_path(spark: SparkSession, path: str, **options) -> Frame:
    """A frame over the file or folder; a path without suffix is a folder of files."""
    suffix = _suffix(path)
    if suffix:
        return READERS[suffix](spark, path, **options)
    return Frame(files.directory_from_disk(spark, path), order=[F.col("path")])


def count_path(spark: SparkSession, path: str, **options) -> int | None:
    """Rows of the file as a frame; a folder has no row count."""
    suffix = _suffix(path)
    if not suffix:
        return None
    if suffix in HEADED:
        return HEADED[suffix].count_rows(spark, path).first()[0]
    return READERS[suffix](spark, path, **options).num_rows


def sample_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """Columns, types, first values and row count of a file or folder."""
    suffix = _suffix(path)
    if not suffix:
        listed = files.directory_from_disk(spark, path).orderBy("path").limit(10)
        nothing = spark.range(1).select(F.lit(None).cast("bigint").alias("total_count"))
        return profile.sample_summary(Frame(listed, order=[F.col("path")]), total=nothing)
    if suffix in HEADED:
        source = HEADED[suffix]
        return profile.sample_summary(source.sample_frame(spark, path), total=source.count_rows(spark, path))
    return profile.sample_summary(READERS[suffix](spark, path, **options))
