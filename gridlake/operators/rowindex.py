"""Dense row positions without a single-partition window.

``scan_index``   positions of a columnar scan: file offset plus position in file.
``sort_index``   positions under a sort: range partitions, then partition offsets.
``densify``      closes the gaps in an existing unique position column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import stage

ROW = "_row"
BLOCK_ROWS = 1 << 17
MAX_BROADCAST_FILES = 200_000  # one path and one long per file, some tens of MB


def scan_index(df: DataFrame, name: str = ROW) -> DataFrame:
    """Number the rows of a Parquet scan by file name and position in the file.

    Reads nothing but row counts to find the file offsets, and shuffles no rows.
    """
    files = df.inputFiles()
    position = F.col("_metadata.row_index")
    if len(files) == 1:
        return df.select("*", position.alias(name))
    located = df.select("*", F.col("_metadata.file_path").alias("_file"), position.alias("_pos"))
    sizes = located.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # one row per file, so the unpartitioned window is small
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if len(files) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    # a left join on a unique key: it vanishes from plans that never use the position
    joined = located.join(offsets, "_file", "left")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_pos")).alias(name))


def line_index(df: DataFrame, file: Column, block: Column, name: str = ROW) -> DataFrame:
    """Number the rows of a text scan (CSV, JSON) by file, split and line in the split.

    The lines of one split are consecutive within one task, so their position is the
    distance from the first generated id of that split.
    """
    located = df.select(
        "*", file.alias("_file"), block.alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    sizes = located.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    joined = located.join(offsets, ["_file", "_block"], "left")
    return joined.select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def sort_index(df: DataFrame, keys: list[Column], name: str = ROW) -> DataFrame:
    """Number the rows in the order of ``keys`` (add a unique key last to break ties).

    One range shuffle puts each partition's rows in order.  The range bounds are
    sampled, hence differ from run to run, so the ordered rows are staged before the
    partition sizes are read.  A unique last key lets the bounds split hot values.
    An existing position column may be among the keys; it is replaced.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    staged = stage(ordered.withColumn("_id", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_id", 33)
    sizes = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per shuffle partition, whatever the data size
    joined = staged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local = F.col("_id").bitwiseAND((1 << 33) - 1)
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return joined.select(*others, (F.col("_offset") + local).alias(name))


def densify(df: DataFrame, name: str = ROW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Renumber a unique position column 0, 1, 2 ... after rows were filtered out.

    Positions are cut into blocks of at most ``block_rows``; each block counts its
    survivors and numbers them locally, so no task sees more than one block at once.
    """
    block = F.floor(F.col(name) / block_rows)
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(sizes, "_block", "_n")
    local = F.row_number().over(Window.partitionBy("_block").orderBy(name)) - 1
    joined = blocked.withColumn("_local", local).join(offsets, "_block")
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return joined.select(*others, (F.col("_offset") + F.col("_local")).alias(name))


def running_offsets(sizes: DataFrame, key: str, size: str, fan: int = 4096) -> DataFrame:
    """Sum of ``size`` over all smaller keys, in two levels of windows.

    Used on tables with one row per block.  The outer window sees one row per
    ``fan`` blocks, so even billions of blocks stay out of a single task.
    """
    grouped = sizes.select(key, size, F.floor(F.col(key) / fan).alias("_fan"))
    within = Window.partitionBy("_fan").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_fan").rowsBetween(Window.unboundedPreceding, -1)
    fans = grouped.groupBy("_fan").agg(F.sum(size).alias("_total")).select(
        "_fan", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    )
    return grouped.join(fans, "_fan").select(
        key, (F.col("_base") + F.coalesce(F.sum(size).over(within), F.lit(0))).alias("_offset")
    )
