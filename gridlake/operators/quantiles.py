"""Exact quantiles of groups of any size, by counting digits.

Values become whole numbers of 64 bits in the same order.  Each pass counts the rows of a group by
the next 16 bits of those that are still in question, which Spark adds up where the rows are read;
the running counts tell which digit the wanted ranks fall into.  After four passes the values are
known.  No group is ever held or sorted in one place: a task sees at most 65,536 counts of a digit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.operators.ranges import same_all

DIGIT, PASSES = 16, 4
_FLIP = np.int64((1 << 63) - 1)


@F.arrow_udf(T.LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """Doubles as whole numbers in the same order; NaN is the largest."""
    v = values.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ _FLIP, bits))


@F.arrow_udf(T.DoubleType())
def _value(codes: pa.Array) -> pa.Array:
    bits = codes.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits ^ _FLIP, bits).view(np.float64))


def _digit(pass_no: int) -> Column:
    """The digit of a pass; the first one is shifted so that negative numbers come first."""
    moved = F.shiftright("_code", 64 - DIGIT * (pass_no + 1))
    return moved + (1 << DIGIT - 1) if pass_no == 0 else moved.bitwiseAND((1 << DIGIT) - 1)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Per group the interpolated quantiles ``{name: share}`` of the known values of a numeric column.

    Groups without a known value give no row, null keys are a group.  Whole numbers are exact up to
    64 bits; floats and decimals count as doubles.
    """
    kind = df.schema[value].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"quantiles need numbers, {value} is {kind.simpleString()}")
    if not all(0 <= q <= 1 for q in points.values()):
        raise ValueError("quantiles lie between 0 and 1")
    whole = isinstance(kind, T.IntegralType)
    number = F.col(f"`{value}`").cast("long") if whole else _ordered(F.col(f"`{value}`").cast("double"))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], number.alias("_code"))
    group = list(names.values())

    def counted(source: DataFrame, pass_no: int, by: list[str], *carried: Column) -> DataFrame:
        digits = source.groupBy(*by, _digit(pass_no).alias("_digit")).agg(F.count(F.lit(1)).alias("_n"), *carried)
        before = Window.partitionBy(*by).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        return digits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))

    def narrowed(digits: DataFrame, prefix: Column) -> DataFrame:
        """The ranks that fall into each digit, counted from its first row, and the codes so far."""
        low, high = F.col("_before"), F.col("_before") + F.col("_n")
        inside = F.filter("_ranks", lambda r: (r["rank"] >= low) & (r["rank"] < high))
        moved = F.transform(inside, lambda r: F.struct(r["name"].alias("name"), r["weight"].alias("weight"), (r["rank"] - low).alias("rank")))
        return digits.select(*group, prefix.alias("_prefix"), moved.alias("_ranks")).where(F.size("_ranks") > 0)

    first = counted(rows, 0, group)
    total = F.sum("_n").over(Window.partitionBy(*group))
    wanted = []
    for name, q in points.items():
        at = F.lit(float(q)) * (total - 1)
        share = at - F.floor(at)
        wanted.append(F.struct(F.lit(name).alias("name"), (1 - share).alias("weight"), F.floor(at).alias("rank")))
        wanted.append(F.struct(F.lit(name).alias("name"), share.alias("weight"), (F.floor(at) + 1).alias("rank")))
    # a weight of zero asks for nothing
    asked = F.filter(F.array(*wanted), lambda r: r["weight"] > 0)
    found = narrowed(first.withColumn("_ranks", asked), F.col("_digit") - (1 << DIGIT - 1))
    for pass_no in range(1, PASSES):
        # a row for each digit that is still open, with the ranks it holds
        open_ = found.select(*[F.col(g).alias(f"o{g}") for g in group], F.col("_prefix").alias("_open"), "_ranks")
        met = [(F.col(g), F.col(f"o{g}")) for g in group]
        high = F.shiftright("_code", 64 - DIGIT * pass_no)
        left = rows.join(open_, same_all(met) & (high == F.col("_open"))).select(*group, "_code", F.col("_open").alias("_prefix"), "_ranks")
        digits = counted(left, pass_no, [*group, "_prefix"], F.first("_ranks").alias("_ranks"))
        found = narrowed(digits, F.shiftleft("_prefix", DIGIT) + F.col("_digit"))
    decoded = F.col("_prefix").cast("double") if whole else _value(F.col("_prefix"))
    told = found.withColumn("_value", decoded).select(*group, "_value", F.explode("_ranks").alias("r"))
    parts = told.select(*group, F.col("r.name").alias("_name"), (F.col("r.weight") * F.col("_value")).alias("_part"))
    return parts.groupBy(*[F.col(n).alias(k) for k, n in names.items()]).pivot("_name", list(points)).agg(F.sum("_part"))
