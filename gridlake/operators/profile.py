"""Frame profile, sample summary, preview and round-trip comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.nulls import is_float
from gridlake.operators.rowindex import ROW

# Bytes per value of the fixed-width types.
WIDTHS = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def value_bytes(column, kind: T.DataType):
    """Bytes of one value; nulls inside nested values and null nested values have none."""
    name = kind.simpleString()
    if name in WIDTHS:
        size = F.lit(WIDTHS[name])
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.BooleanType):
        size = F.lit(1)
    elif isinstance(kind, T.DecimalType):
        size = F.lit(16)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + value_bytes(
            F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [value_bytes(column[f.name], f.dataType) for f in kind.fields], F.lit(0))
    else:
        raise TypeError(f"no size is known for values of type {name}")
    return F.when(column.isNull(), F.lit(0)).otherwise(size).cast("bigint")


def frame_profile(df: DataFrame) -> DataFrame:
    """One row: row count, column count and data bytes (values only, no buffers).

    Booleans take one bit each, text and binary their own length, nested values that of their parts.
    """
    per_row = 0
    varying = []
    bits = 0
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.coalesce(F.sum(F.octet_length(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, T.BooleanType):
            bits += 1
        else:
            if kind in WIDTHS:
                per_row += WIDTHS[kind]
            else:
                varying.append(F.coalesce(F.sum(value_bytes(F.col(f"`{field.name}`"), field.dataType)), F.lit(0)))
    rows = F.count(F.lit(1))
    size = reduce(lambda a, b: a + b, varying, rows * F.lit(per_row))
    size = size + bits * F.ceil(rows / 8)
    return df.agg(
        rows.alias("num_rows"), F.lit(len(df.columns)).cast("bigint").alias("num_cols"),
        size.cast("bigint").alias("total_bytes"),
    )


def sample_summary(frame, rows: int = 10, total: DataFrame | None = None) -> DataFrame:
    """Per column: type, the first ``rows`` values as text (NaN as ``NaN``) and the row count.

    ``total`` is a one-row, one-column count to show instead of the frame's own.
    """
    first = frame.limit(rows).indexed()
    names = frame.column_names
    as_text = []
    for name in names:
        column = F.col(f"`{name}`")
        if is_float(first.df.schema[name].dataType):
            column = F.when(F.isnan(column), "NaN").otherwise(column.cast("string"))
        as_text.append(column.cast("string").alias(name))
    long = first.df.select(ROW, *as_text).unpivot([ROW], names, "column", "value")
    # at most ``rows`` values per column, so the lists stay short
    lists = long.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(ROW, "value"))), lambda x: x["value"]).alias("values")
    )
    types = F.create_map(*[
        F.lit(x) for f in frame.schema.fields for x in (f.name, f.dataType.simpleString())
    ])
    if total is None:
        total = frame.df.agg(F.count(F.lit(1)).alias("total_count"))
    typed = lists.select("column", types[F.col("column")].alias("type"), "values")
    return typed.withColumn("total_count", total.scalar())


def preview_rows(frame, head_rows: int = 5, tail_rows: int = 5) -> DataFrame:
    """Head and tail rows with their position; the tail only when rows remain after the head."""
    dense = frame.indexed()
    if dense.scan is not None:
        # both ends by position: files in between are not opened
        n = dense.df.agg(F.count(F.lit(1))).first()[0]
        low = max(n - tail_rows, min(head_rows, n))
        head, tail = dense.slice(0, head_rows), dense.slice(low)
        ends = head.df.unionByName(tail.df.withColumn(ROW, F.col(ROW) + low))
        return ends.withColumn("_total", F.lit(n).cast("bigint"))
    total = dense.df.agg(F.count(F.lit(1)).alias("_total"))
    marked = dense.df.withColumn("_total", total.scalar())
    return marked.where((F.col(ROW) < head_rows) | (F.col(ROW) >= F.col("_total") - tail_rows))


def shown_columns(names: list[str], first_cols: int, last_cols: int) -> list[str]:
    if len(names) <= first_cols + last_cols:
        return names
    return names[:first_cols] + (names[-last_cols:] if last_cols else [])


def preview_text(frame, head_rows, tail_rows, first_cols, last_cols, display_all=False) -> str:
    """The preview as plain text; ``display_all`` brings every row to the driver."""
    if display_all:
        return frame.to_pandas().to_string()
    names = frame.column_names
    shown = shown_columns(names, first_cols, last_cols)
    rows = preview_rows(frame, head_rows, tail_rows).select(ROW, "_total", *[F.col(f"`{c}`") for c in shown])
    pdf = rows.orderBy(ROW).toPandas()
    total = int(pdf["_total"].iloc[0]) if len(pdf) else 0
    lines = pdf.drop(columns=["_total"]).set_index(ROW).rename_axis(None).to_string().splitlines()
    if total > head_rows + tail_rows:
        lines.insert(head_rows + 1, "...")
    return "\n".join(lines) + f"\n\n[{total} rows x {len(names)} columns]"


def roundtrip_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Compare two tables by key: rows only on one side, rows with other values, equal rows.

    Equality is null-safe and treats NaN as equal to NaN.
    """
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full")
    status = (
        F.when(F.col("_b").isNull(), "left_only")
        .when(F.col("_a").isNull(), "right_only")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "equal")
        .otherwise("changed")
    )
    return both.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
