"""File listings, directory frames and file access from tasks."""

from __future__ import annotations

import fnmatch
import posixpath
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of a directory frame, in order.
DIRECTORY_COLUMNS = ["name", "path", "suffix", "type", "size", "time", "blob"]

LISTING = "path string, length bigint, modificationTime timestamp"


def locate(path: str):
    """The Arrow file system of a path or URI, the path inside it, and what precedes it."""
    local = re.match(r"^(?:file:(?://)?)?(?=/)", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem(), path[local.end():] if local else path, ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def open_input(path: str):
    """A random-access file for a plain path or a URI of any Arrow file system."""
    system, inner, _ = locate(path)
    return system.open_input_file(inner)


def open_output(path: str):
    """A new file for a plain path or URI, creating its folder."""
    system, inner, _ = locate(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def rename(source: str, target: str) -> None:
    """Move a finished file into place, replacing what an earlier attempt left."""
    system, inner, _ = locate(source)
    system.move(inner, locate(target)[1])


def spread(work: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows that each stand for file work, whatever their own few bytes.

    The number of partitions is given, because adaptive execution would merge a small
    table of large reads into a handful of tasks.
    """
    spark = work.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local"):
        # with dynamic allocation few cores may be registered yet
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return work.repartition(tasks, *keys)


def _hidden(name: str) -> bool:
    # as everywhere in Spark: markers, checksums and unfinished files
    return name.startswith((".", "_"))


def _listing_batch(entries: list, prefix: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([prefix + e.path for e in entries], pa.string()),
        pa.array([e.size for e in entries], pa.int64()),
        pa.array([(e.mtime_ns or 0) // 1000 for e in entries], pa.int64()).cast(pa.timestamp("us", "UTC")),
    ], ["path", "length", "modificationTime"])


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """All files at or below a path (``path, length, modificationTime``), empty ones too.

    The driver lists the first level only; the folders found there are walked by the
    tasks, one folder at a time.  Names starting with a dot or underscore are hidden.
    """
    system, inner, prefix = locate(folder)
    top = system.get_file_info(inner)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    entries = [top] if top.is_file else system.get_file_info(pafs.FileSelector(inner))
    shown = [(prefix + e.path, not e.is_file) for e in entries if not _hidden(posixpath.basename(e.path))]

    def wanted(path: str) -> bool:
        return pattern is None or any(
            fnmatch.fnmatch(posixpath.basename(path).lower(), p) for p in pattern.split("|")
        )

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, start, prefix = locate(row["path"])
                if not row["is_folder"]:
                    if wanted(start):
                        yield _listing_batch([system.get_file_info(start)], prefix)
                    continue
                folders = [start]
                while folders:
                    here = system.get_file_info(pafs.FileSelector(folders.pop()))
                    here = [e for e in here if not _hidden(posixpath.basename(e.path))]
                    folders += [e.path for e in here if not e.is_file]
                    yield _listing_batch([e for e in here if e.is_file and wanted(e.path)], prefix)

    tops = spark.createDataFrame(shown, "path string, is_folder boolean")
    spread = tops.repartition(max(1, min(len(shown), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(walk, LISTING)


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, with a leading slash; other paths stay as they are."""
    root = root.rstrip("/")
    inside = F.substr(path, F.lit(len(root) + 1))
    return F.when(path.startswith(root + "/"), inside).otherwise(path)


def folder_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a storage root with their dataset, the first folder under the root."""
    files = list_files(spark, root).withColumn("relative_path", relative_to(F.col("path"), root))
    return files.withColumn("dataset", F.split("relative_path", "/")[1])


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names without one and for dot files."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def directory_frame(dataset_file: DataFrame) -> DataFrame:
    """Catalogue file rows as a directory frame: no folders, contents not loaded."""
    has_time = "time" in dataset_file.columns
    return dataset_file.where(F.col("type") != "dir").select(
        "name", "path", "suffix", "type", F.col("size").cast("bigint").alias("size"),
        (F.col("time").cast("string") if has_time else F.lit(None).cast("string")).alias("time"),
        F.lit(None).cast("binary").alias("blob"),
    )


def directory_samples(dataset_file: DataFrame, dataset: str, listed: int = 11, kept: int = 10) -> DataFrame:
    """Per dataset: the first listed entries by path, less folders, at most ten."""
    by_path = Window.partitionBy(dataset).orderBy("path")
    first = dataset_file.withColumn("_at", F.row_number().over(by_path)).where(F.col("_at") <= listed)
    shown = first.where(F.col("type") != "dir").withColumn("_at", F.row_number().over(by_path))
    return shown.where(F.col("_at") <= kept).select("name", "path", "suffix", "type", "size", dataset)


def directory_from_disk(spark: SparkSession, folder: str) -> DataFrame:
    """A directory frame of the files below a folder."""
    files = list_files(spark, folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path"),
        F.ltrim(suffix_of(F.col("path")), F.lit(".")).alias("suffix"),
        F.lit("file").alias("type"),
        F.col("length").alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        F.lit(None).cast("binary").alias("blob"),
    )
