"""Roll-ups of transfer benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The measures a result record holds.
MEASURES = [
    "connect_time", "total_time", "throughput_mbps", "rows_per_sec", "memory_change_mb", "file_size_mb",
]


def rollup_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Per key: number of runs, six averages, shortest and longest total time."""
    averages = [F.avg(m).alias(f"avg_{m}") for m in MEASURES]
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), *averages,
        F.min("total_time").alias("min_total_time"), F.max("total_time").alias("max_total_time"),
    )


def compare_protocols(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two roll-ups by ``dataset_name``: how much faster the first protocol was."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, "dataset_name", "left")

    def times(over: str, under: str):
        return F.try_divide(F.col(over), F.col(under))

    return joined.select(
        "dataset_name",
        times("b.avg_connect_time", "a.avg_connect_time").alias("connect_ratio"),
        times("b.avg_total_time", "a.avg_total_time").alias("total_ratio"),
        times("a.avg_throughput_mbps", "b.avg_throughput_mbps").alias("throughput_ratio"),
    )
