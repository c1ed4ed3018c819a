"""Session defaults and the shared staging folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app_name: str = "gridlake", master: str | None = None, **conf) -> SparkSession:
    """Build a session with the library defaults; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows with long texts to Python tasks in batches of ``BATCH_BYTES``, where the session
    names no bound of its own; Spark's default is sixteen times as much, several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return the memory that a task no longer uses; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session.  Only a local master may go
    without it: there a temporary folder is as shared as any other.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by all executors before using "
            "operators that stage intermediate tables"
        )
    chosen = tempfile.mkdtemp(prefix="gridlake-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def staging_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/gridlake/{app}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Freezes values that would differ if the plan ran twice (sampled range bounds,
    row ids) and cuts the lineage, so a lost executor re-reads files instead of
    recomputing a different answer.
    """
    path = staging_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
