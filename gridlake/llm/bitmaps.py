"""Bitmaps of fixed size that tell tasks which numbers may be in a table of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 32768  # bits of one of Spark's bitmaps


def bitmap(rows: DataFrame, number: Column, cells: int) -> np.ndarray:
    """Bytes with bit ``number % cells`` set for each row; what reaches the driver is of fixed size."""
    cell = rows.select(F.pmod(number, F.lit(cells)).alias("cell"))
    maps = cell.groupBy(F.floor(F.col("cell") / _SPAN).alias("at")).agg(
        F.bitmap_construct_agg(F.pmod("cell", F.lit(_SPAN))).alias("bits")
    )
    out = np.zeros(-(-cells // _SPAN) * (_SPAN // 8), np.uint8)
    for r in maps.collect():
        out[r["at"] * _SPAN // 8:(r["at"] + 1) * _SPAN // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, cell: int) -> int:
    return bits[cell >> 3] >> (cell & 7) & 1
