"""Reshaping verbs: flatten, concatenate, pivot, melt, fill and drop missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions import nulls


def flatten_structs(df: DataFrame) -> DataFrame:
    """One level of struct columns becomes ``parent.child`` columns."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            for child in field.dataType.fieldNames():
                inner = F.col(f"`{field.name}`.`{child}`")
                columns.append(inner.alias(f"{field.name}.{child}"))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return df.select(*columns)


def concat_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in both; duplicates go before the shuffle, so repeated rows are no skew."""
    return a.distinct().intersect(b.distinct())


def subtract_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first that the second lacks."""
    return a.distinct().subtract(b.distinct())


def aggregate_column(df: DataFrame, column: str, how: str) -> Column:
    """An aggregate by name with the missing-value rules of the frame verbs."""
    present = F.when(~nulls.missing_in(df, column), F.col(f"`{column}`"))
    rules = {
        "sum": lambda: nulls.total(df, column),
        "mean": lambda: nulls.average(df, column),
        "avg": lambda: nulls.average(df, column),
        "min": lambda: nulls.smallest(df, column),
        "max": lambda: nulls.largest(df, column),
        "count": lambda: F.count(present),
        "std": lambda: F.stddev_samp(present),
        "var": lambda: F.var_samp(present),
        "nunique": lambda: F.count_distinct(present),
    }
    if how not in rules:
        raise ValueError(f"unknown aggregate: {how}")
    return rules[how]()


def pivot_wide(df, index: list[str], columns: str, values: str, categories: list, how: str) -> DataFrame:
    """Long to wide; the categories are given, so no extra job looks them up."""
    return df.groupBy(*index).pivot(columns, categories).agg(aggregate_column(df, values, how))


def melt_long(df, id_vars: list[str], value_vars: list[str], var_name: str, value_name: str) -> DataFrame:
    return df.unpivot(id_vars, value_vars, var_name, value_name)


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    filled = {
        c: F.when(nulls.missing_in(df, c), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
        for c, v in values.items()
    }
    return df.withColumns(filled)


def drop_missing(df: DataFrame, subset: list[str], how: str = "any") -> DataFrame:
    tests = [nulls.missing_in(df, c) for c in subset]
    hit = reduce(lambda a, b: a | b if how == "any" else a & b, tests)
    return df.where(~hit)
