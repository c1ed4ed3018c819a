"""``Frame``: a Spark DataFrame that remembers its row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions import nulls
from gridlake.functions.expressions import predicate
from gridlake.operators import joins, profile, reshape, udf
from gridlake.operators.pruning import ScanFiles
from gridlake.operators.rowindex import ROW, densify, sort_index
from gridlake.session import stage

SHORT = 1000  # slices up to this length stop reading when they are full
SMALL_LIMIT = 100_000  # above this, limits use row positions instead of one merging task


class Frame:
    """Verbs over a DataFrame with an explicit row order.

    ``df`` holds the visible columns plus hidden ones (names starting with ``_row`` or
    ``_sort``).  ``order`` lists the sort keys that define "first row, second row";
    an empty list means no order is known.  ``dense`` is true while ``_row`` counts
    0, 1, 2 ... in exactly that order.  ``scan`` are the files of a scan and ``steps`` what was
    done to its rows since, one by one, so that a slice can open the files it needs alone.
    """

    def __init__(
        self, df: DataFrame, order: list[Column] | None = None, dense: bool = False, scan: ScanFiles | None = None, steps: tuple = (),
    ):
        self.df = df
        self.dense = dense
        self.scan, self.steps = scan, steps
        self.unsettled = False
        if order is None:
            order = [F.col(ROW)] if ROW in df.columns else []
        self.order = order

    # -- shape and schema ------------------------------------------------------
    @staticmethod
    def _hidden(name: str) -> bool:
        return name == ROW or name.startswith("_sort")

    @property
    def column_names(self) -> list[str]:
        return [c for c in self.df.columns if not self._hidden(c)]

    def has_columns(self, *names: str) -> bool:
        """Whether all these columns are there, in whatever order and among whatever others."""
        return set(names) <= set(self.column_names)

    @property
    def data(self) -> DataFrame:
        """The visible columns as a plain DataFrame, in no particular order."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.column_names])

    @property
    def ordered(self) -> DataFrame:
        """The visible columns, sorted into row order."""
        self._settle()
        df = self.df.orderBy(*self.order) if self.order else self.df
        return df.select(*[F.col(f"`{c}`") for c in self.column_names])

    @property
    def schema(self) -> T.StructType:
        return self.data.schema

    @property
    def num_rows(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.num_rows

    @property
    def num_cols(self) -> int:
        return len(self.column_names)

    num_columns = num_cols

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows, self.num_cols

    @property
    def total_bytes(self) -> int:
        return profile.frame_profile(self.data).first()["total_bytes"]

    nbytes = total_bytes

    def _with(self, df: DataFrame, dense: bool | None = None) -> "Frame":
        return Frame(df, self.order, self.dense if dense is None else dense)

    def _by_row(self, step: Callable[[DataFrame], DataFrame], dense: bool | None = None) -> "Frame":
        """As ``_with``, for a step that looks at each row alone."""
        return Frame(step(self.df), self.order, self.dense if dense is None else dense, self.scan, (*self.steps, step))

    def _narrowed(self, offset: int, length: int | None) -> "Frame":
        """This frame over the files alone that hold the given positions, where that is fewer."""
        if self.scan is None:
            return self
        if self.dense:
            df = None
            if length is not None:
                df = self.scan.head(offset + length)
            df = df if df is not None else self.scan.covering(offset, length)
        else:
            df = None if length is None or offset + length > SMALL_LIMIT else self.scan.leading(self.steps, offset + length)
        if df is None:
            return self
        for step in self.steps:
            df = step(df)
        return Frame(df, self.order, self.dense)

    def _hidden_columns(self) -> list[Column]:
        return [F.col(c) for c in self.df.columns if self._hidden(c)]

    def _require(self, *names: str) -> None:
        unknown = [n for n in names if n not in self.column_names]
        if unknown:
            raise KeyError(f"no such column: {', '.join(unknown)}")

    # -- row positions ---------------------------------------------------------
    def indexed(self) -> "Frame":
        """The same rows with a dense ``_row`` column."""
        self._settle()
        if self.dense:
            return self
        if not self.order:
            # rows of a query or group have the order of their values
            plain = [f.name for f in self.schema.fields if "map<" not in f.dataType.simpleString()]
            order = [F.col(f"`{c}`").asc_nulls_last() for c in plain]
            return Frame(sort_index(self.df, order or [F.lit(0)]), dense=True)
        sort_columns = [c for c in self.df.columns if c.startswith("_sort")]
        if sort_columns or ROW not in self.df.columns:
            return Frame(sort_index(self.df, self.order).drop(*sort_columns), dense=True)
        return Frame(densify(self.df), dense=True)

    # -- projection ------------------------------------------------------------
    def select(self, *columns: str) -> "Frame":
        self._require(*columns)
        if len(set(columns)) < len(columns):
            raise ValueError("select needs distinct column names")
        kept = [*[F.col(f"`{c}`") for c in columns], *self._hidden_columns()]
        return self._by_row(lambda df: df.select(*kept))

    def drop(self, *columns: str) -> "Frame":
        self._require(*columns)
        return self._by_row(lambda df: df.drop(*columns))

    drop_columns = drop

    def assign(self, **columns: Column) -> "Frame":
        return self._with(self.df.withColumns(columns))

    def astype(self, types: dict[str, str], errors: str = "raise") -> "Frame":
        """Cast columns; with ``errors='coerce'`` values that do not fit become null."""
        self._require(*types)
        cast = "cast" if errors == "raise" else "try_cast"
        changed = {c: getattr(F.col(f"`{c}`"), cast)(t) for c, t in types.items()}
        return self._by_row(lambda df: df.withColumns(changed))

    def append_column(self, name: str, column: Column | "Frame") -> "Frame":
        """Append a computed column, or the one column of a frame with the same row order."""
        if isinstance(column, Column):
            return self._with(self.df.withColumn(name, column))
        left, right = self.indexed(), column.indexed()
        (value,) = right.column_names
        other = right.df.select(ROW, F.col(f"`{value}`").alias(name))
        return Frame(left.df.join(other, ROW, "left"), dense=True)

    def flatten(self) -> "Frame":
        """Replace every struct column by its fields, named ``parent.child``."""
        return self._by_row(reshape.flatten_structs)

    # -- filters ---------------------------------------------------------------
    def filter(self, condition: str | Column | "Frame") -> "Frame":
        """Keep rows by an expression text, a boolean column or a positional mask frame."""
        if isinstance(condition, str):
            kept = predicate(self.data, condition)
            return self._by_row(lambda df: df.where(kept), dense=False)
        if isinstance(condition, Column):
            return self._with(self.df.where(condition), dense=False)
        left, mask = self.indexed(), condition.indexed()
        (flag,) = mask.column_names
        kept = mask.df.where(F.col(f"`{flag}`")).select(ROW)
        return Frame(left.df.join(kept, ROW, "left_semi"), dense=False)

    # -- order -----------------------------------------------------------------
    def sort(self, column: str, order: str = "ascending") -> "Frame":
        """Stable sort: nulls last, NaN just before them, ties in the present order."""
        self._require(column)
        ascending = order == "ascending"
        level = sum(c.startswith("_sort") for c in self.df.columns)
        name = f"_sort{level:03d}_{'up' if ascending else 'down'}"
        df = self.df.withColumn(name, F.col(f"`{column}`"))
        return Frame(df, nulls.sort_keys(df, name, ascending) + self.order, dense=False)

    order_by = sort

    def limit(self, n: int) -> "Frame":
        return self.slice(0, n)

    def slice(self, offset: int = 0, length: int | None = None) -> "Frame":
        if offset < 0 or (length is not None and length < 0):
            raise IndexError("offset and length must not be negative")
        self._settle()
        narrow = self._narrowed(offset, length)
        if narrow is not self:
            return narrow.slice(offset, length)
        if self.dense:
            inside = F.col(ROW) >= offset
            if length is not None:
                inside &= F.col(ROW) < offset + length
            moved = self.df.where(inside).withColumn(ROW, F.col(ROW) - offset)
            # there are no more; a limit lets tasks stop reading once they have them
            return Frame(moved.limit(length) if length is not None and length <= SHORT else moved, dense=True)
        if length is not None and (offset + length <= SMALL_LIMIT or not self.order):
            df = self.df.orderBy(*self.order) if self.order else self.df
            return self._with(df.offset(offset).limit(length) if offset else df.limit(length))
        return self.indexed().slice(offset, length)

    # -- access ----------------------------------------------------------------
    def __getitem__(self, index):
        if isinstance(index, int):
            return self.row(index)
        if isinstance(index, str):
            return self.column(index)
        raise TypeError(f"a frame is indexed by a row number or a column name, not by {type(index).__name__}")

    def row(self, position: int) -> dict:
        rows = self.slice(position, 1).data.collect()
        if not rows:
            raise IndexError(f"row {position} is out of range")
        values = rows[0].asDict()
        if "blob" in values and values["blob"] is None:
            values["blob"] = b""
        return values

    def column(self, name: str) -> list:
        """All values of one column in row order: an export to the driver, size it first."""
        self._require(name)
        return [v for batch in self.select(name).get_stream() for v in batch.column(0).to_pylist()]

    def get_stream(self, max_chunksize: int = 1000) -> Iterator[pa.RecordBatch]:
        from gridlake.streaming.chunks import stream_batches

        return stream_batches(self, max_chunksize)

    def to_string(self, head_rows=5, tail_rows=5, first_cols=3, last_cols=3, display_all=False) -> str:
        return profile.preview_text(self, head_rows, tail_rows, first_cols, last_cols, display_all)

    def __str__(self) -> str:
        return self.to_string()

    def to_pandas(self):
        return self.ordered.toPandas()

    def to_pydict(self) -> dict[str, list]:
        return self.ordered.toArrow().to_pydict()

    def collect(self) -> "Frame":
        """Compute the pending work once and keep the result on the executors."""
        kept = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return self._with(kept)

    def collect_blob(self, root: str = "") -> "Frame":
        from gridlake.sources.blobs import load_blobs

        return self._with(load_blobs(self.df, root))

    # -- aggregates ------------------------------------------------------------
    def _scalar(self, aggregate: Column):
        return self.df.agg(aggregate.alias("result")).first()["result"]

    def sum(self, column: str):
        self._require(column)
        return self._scalar(nulls.total(self.df, column))

    def mean(self, column: str):
        self._require(column)
        return self._scalar(nulls.average(self.df, column))

    def min(self, column: str):
        self._require(column)
        return self._scalar(nulls.smallest(self.df, column))

    def max(self, column: str):
        self._require(column)
        return self._scalar(nulls.largest(self.df, column))

    def count(self, column: str) -> int:
        self._require(column)
        return self.df.where(~nulls.missing_in(self.df, column)).count()

    def std(self, column: str):
        return self._present(column).agg(F.stddev_samp(f"`{column}`")).first()[0]

    def var(self, column: str):
        return self._present(column).agg(F.var_samp(f"`{column}`")).first()[0]

    def _present(self, column: str) -> DataFrame:
        self._require(column)
        return self.df.where(~nulls.missing_in(self.df, column))

    def unique(self, column: str) -> DataFrame:
        self._require(column)
        return self.df.select(F.col(f"`{column}`")).distinct()

    def nunique(self, column: str) -> int:
        return self._present(column).agg(F.count_distinct(F.col(f"`{column}`"))).first()[0]

    def groupby(self, *keys: str) -> "GroupedFrame":
        self._require(*keys)
        return GroupedFrame(self, keys)

    group_by = groupby

    # -- columns from Python ---------------------------------------------------
    def map(self, column: str, func: Callable, new_column_name: str | None = None, return_type=None):
        """Apply a Python function to each value of a column.

        Adds ``new_column_name``, or replaces the column when no name is given.
        """
        self._require(column)
        return self._with(udf.map_values(self.df, column, func, new_column_name, return_type))

    def apply(self, column: str, func: Callable, return_type, new_column_name: str | None = None):
        """Apply a vectorised function (pandas series in, series out) to a column."""
        self._require(column)
        return self._with(udf.apply_series(self.df, column, func, return_type, new_column_name))

    transform = apply

    # -- SQL and combination ---------------------------------------------------
    def sql(self, text: str) -> "Frame":
        """Run SQL over this frame under the name ``dataframe``; the result is a new frame."""
        from gridlake.operators.sqlaction import is_ordered, run_sql

        found = run_sql(self.data, text)
        if not is_ordered(found):
            return Frame(found, order=[])
        # the rows have an order of their own; it is fixed when a position is first asked for
        placed = Frame(found.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), [F.col(ROW)])
        placed.unsettled = True
        return placed

    def _settle(self) -> None:
        """Stage the rows of an ordered query, so that ties have one place in all later calls."""
        if self.unsettled:
            self.df, self.unsettled = stage(self.df, "sql-order"), False

    def merge(self, other: "Frame", on: str | list[str], how: str = "inner") -> "Frame":
        return Frame(joins.merge(self.data, other.data, on, how), order=[])

    join = merge

    def concat(self, *others: "Frame") -> "Frame":
        """Rows of this frame, then of the others; missing columns become null."""
        if not all(f.order for f in (self, *others)):
            return Frame(reshape.concat_rows([f.data for f in (self, *others)]), order=[])
        # positions need not be dense, only ascending within a part
        parts = []
        for i, f in enumerate((self, *others)):
            placed = f.indexed() if len(f.order) > 1 else f
            parts.append(placed.df.withColumn("_sort_part", F.lit(i)))
        return Frame(reshape.concat_rows(parts), [F.col("_sort_part"), F.col(ROW)])

    append = concat

    def pivot(self, index: list[str], columns: str, values: str, categories: list, how: str = "sum"):
        return Frame(reshape.pivot_wide(self.data, index, columns, values, categories, how), order=[])

    def melt(self, id_vars: list[str], value_vars: list[str], var_name="variable", value_name="value"):
        return Frame(reshape.melt_long(self.data, id_vars, value_vars, var_name, value_name), order=[])

    def fillna(self, values: dict) -> "Frame":
        return self._with(reshape.fill_missing(self.df, values))

    def dropna(self, subset: list[str] | None = None, how: str = "any") -> "Frame":
        return self._with(reshape.drop_missing(self.df, subset or self.column_names, how), dense=False)

    # -- output ----------------------------------------------------------------
    def write(self, output_path: str, format: str | None = None) -> None:
        from gridlake.sources.writers import write_frame

        write_frame(self, output_path, format)

    def to_nc(self, output_path: str) -> None:
        self.write(output_path, "netcdf")


class GroupedFrame:
    """Result of ``Frame.groupby``."""

    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        self.frame = frame
        self.keys = keys

    def aggregate(self, by_column: dict[str, str] | None = None, **aggregates: tuple[str, str]) -> Frame:
        """``aggregate(total=("value", "sum"))``, or ``aggregate({"value": "sum"})``."""
        df = self.frame.df
        columns = []
        aggregates = {**{c: (c, how) for c, how in (by_column or {}).items()}, **aggregates}
        for name, (column, how) in aggregates.items():
            self.frame._require(column)
            columns.append(reshape.aggregate_column(df, column, how).alias(name))
        return Frame(df.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(*columns), order=[])

    agg = aggregate
