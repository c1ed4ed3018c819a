"""Python functions over one column, shipped in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

INFER_ROWS = 100


def infer_return_type(df: DataFrame, column: str, func: Callable) -> T.DataType:
    """The Arrow type of ``func`` over the first rows; any later mismatch fails the job."""
    values = [r[0] for r in df.select(F.col(f"`{column}`")).limit(INFER_ROWS).collect()]
    inferred = pa.array([func(v) for v in values]).type
    if pa.types.is_null(inferred):
        raise ValueError("cannot tell the result type from the first rows; pass return_type")
    return from_arrow_type(inferred, prefer_timestamp_ntz=True)


def checked(func: Callable, result: T.DataType) -> Callable:
    """``func``, raising where a value would change when it is put into the inferred type."""
    classes = {"bigint": (int,), "double": (float, int), "string": (str,), "boolean": (bool,)}
    allowed = classes.get(result.simpleString())
    arrow = to_arrow_type(result)

    def fits(found) -> bool:
        if allowed is not None:
            return isinstance(found, allowed) and (bool in allowed or not isinstance(found, bool))
        try:  # lists, structs, times: what comes back must be what was put in
            own = pa.scalar(found)
            return own.type == arrow or pa.scalar(found, arrow).as_py() == own.as_py()
        except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError):
            return False

    def call(value):
        found = func(value)
        if found is not None and not fits(found):
            raise TypeError(f"{found!r} does not fit the type found from the first rows; pass return_type")
        return found

    return call


def map_values(df: DataFrame, column: str, func: Callable, new_name: str | None, return_type) -> DataFrame:
    """One call per value (``None`` for null); adds ``new_name`` or replaces the column."""
    result = return_type or infer_return_type(df, column, func)
    mapped = F.udf(func if return_type else checked(func, result), returnType=result, useArrow=True)(F.col(f"`{column}`"))
    if new_name:
        return df.withColumn(new_name, mapped)
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, mapped.alias(column))


def apply_series(df: DataFrame, column: str, func: Callable, return_type, new_name: str | None) -> DataFrame:
    """One call per Arrow batch: pandas series in, pandas series of equal length out."""
    vectorised = F.pandas_udf(func, returnType=return_type)
    return df.withColumn(new_name or column, vectorised(F.col(f"`{column}`")))
