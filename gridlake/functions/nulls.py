"""Null and NaN rules: missing tests, NaN-skipping extremes, stable sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def missing(column: Column, floating: bool) -> Column:
    """True for null and, in floating columns, for NaN."""
    return column.isNull() | F.isnan(column) if floating else column.isNull()


def missing_in(df: DataFrame, name: str) -> Column:
    return missing(F.col(f"`{name}`"), is_float(df.schema[name].dataType))


def total(df: DataFrame, name: str) -> Column:
    """Sum that skips nulls, lets NaN through and counts true booleans."""
    column = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        column = column.cast("bigint")
    return F.sum(column)


def average(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        column = column.cast("bigint")
    return F.avg(column)


def _extreme(df: DataFrame, name: str, pick) -> Column:
    column = F.col(f"`{name}`")
    if not is_float(df.schema[name].dataType):
        return pick(column)
    # NaN counts only when nothing else is there
    return F.coalesce(pick(F.when(~F.isnan(column), column)), pick(column))


def smallest(df: DataFrame, name: str) -> Column:
    return _extreme(df, name, F.min)


def largest(df: DataFrame, name: str) -> Column:
    return _extreme(df, name, F.max)


def sort_keys(df: DataFrame, name: str, ascending: bool = True) -> list[Column]:
    """Sort keys that put nulls last and NaN just before them in both directions."""
    column = F.col(f"`{name}`")
    keys = []
    if is_float(df.schema[name].dataType):
        keys.append(F.coalesce(F.isnan(column), F.lit(False)).asc())
    keys.insert(0, column.isNull().asc())
    keys.append(column.asc() if ascending else column.desc())
    return keys
