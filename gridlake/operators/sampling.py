"""Samples of a fixed size, the same rows however the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts in which the sample of a stratum is found first
PARTS = 32


def rank_key(ids: list[str], seed: str) -> Column:
    """A text that orders rows at random, from their ids alone."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in ids]
    return F.md5(F.concat_ws("|", F.lit(seed), *named))


def sample_rows(df: DataFrame, k: int, ids: list[str], strata: list[str] | None = None, seed: str = "sample") -> DataFrame:
    """``k`` rows of each stratum, all rows of smaller ones: those with the smallest hash of ``ids``.

    ``ids`` should tell rows apart; rows that tie are taken in the order of their ids and are the
    same for these columns.  Null strata are a stratum.  The smallest hashes of each part of a stratum
    are found first, so what is brought together is ``k`` rows a part, however many rows it has.
    """
    if k < 0:
        raise ValueError("a sample has no negative size")
    strata = strata or []
    hidden = {"_hash", "_part", "_rank"} & set(df.columns)
    if hidden:
        raise ValueError(f"columns {sorted(hidden)} are used by the sample")
    order = [F.col("_hash"), *[F.col(f"`{c}`") for c in ids]]
    rows = df.withColumn("_hash", rank_key(ids, seed))
    rows = rows.withColumn("_part", F.conv(F.substring("_hash", 29, 4), 16, 10).cast("int") % PARTS)
    for by in ([*strata, "_part"], strata or [F.lit(0)]):
        w = Window.partitionBy(*by).orderBy(*order)
        rows = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return rows.drop("_hash", "_part", "_rank")


def sample_share(df: DataFrame, share: float, ids: list[str], seed: str = "sample") -> DataFrame:
    """Rows whose hash lies in the first ``share`` of all hashes: a filter, about that share of the rows."""
    number = F.conv(F.substring(rank_key(ids, seed), 1, 13), 16, 10).cast("double")
    return df.where(number < F.lit(float(share) * (1 << 52)))
