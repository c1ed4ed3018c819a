"""Convert once, reuse the columnar copy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import shared_dir
from gridlake.sources.files import list_files


def source_key(spark: SparkSession, path: str) -> str:
    """A key of the source: changes when any file below it changes name, size or time."""
    stamp = F.xxhash64("path", "length", "modificationTime")
    row = list_files(spark, path).agg(
        F.count(F.lit(1)), F.sum(stamp.cast("decimal(38,0)")), F.sum("length")
    ).first()
    return hashlib.sha256(repr((path, *row)).encode()).hexdigest()[:32]


def materialize(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The Parquet copy of ``read(spark, path)``, written on first use of this source state."""
    target = f"{shared_dir(spark)}/gridlake/columnar/{source_key(spark, path)}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(jvm_path):
        read(spark, path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
