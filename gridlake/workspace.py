"""A storage root with its datasets: list, open, sample, count and download."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.sources import blobs, files, registry
from gridlake.streaming.chunks import DOWNLOAD_BYTES


class Workspace:
    """Datasets are the folders directly below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def list_datasets(self) -> DataFrame:
        return files.folder_listing(self.spark, self.root).select("dataset").distinct()

    def list_dataframes(self, dataset: str) -> DataFrame:
        """Paths of all files of a dataset, at any depth."""
        return files.list_files(self.spark, f"{self.root}/{dataset}").select("path")

    def resolve(self, name: str) -> str:
        """The path behind ``scheme://host/dataset/relative/path``; the root holds the relative path.

        Paths at or below the root pass through.
        """
        if name.startswith(self.root) or "://" not in name:
            return name
        parts = name.split("://", 1)[1].split("/", 2)
        if len(parts) < 3:
            raise ValueError(f"no path below a dataset in {name!r}")
        return f"{self.root}/{parts[2]}"

    def open(self, name: str, **options) -> Frame:
        return registry.open_path(self.spark, self.resolve(name), **options)

    def sample(self, name: str, **options) -> DataFrame:
        return registry.sample_path(self.spark, self.resolve(name), **options)

    def count(self, name: str, **options) -> int | None:
        return registry.count_path(self.spark, self.resolve(name), **options)

    def download(self, name: str, chunk_bytes: int = DOWNLOAD_BYTES) -> Iterator[bytes]:
        """The bytes of one file in order, at most ``chunk_bytes`` at a time."""
        listed = files.list_files(self.spark, self.resolve(name))
        parts = blobs.load_chunks(listed.select("path", F.col("length").alias("size")), chunk_bytes=chunk_bytes)
        for row in parts.orderBy("path", "chunk_no").select("bytes").toLocalIterator():
            yield bytes(row["bytes"])
