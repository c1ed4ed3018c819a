"""Classic NetCDF files as cell tables, and tables as classic NetCDF files.

Reading is planned as a table: headers give one row per variable, variables give one
row per byte range, and tasks read only their ranges.  A variable of any size is
spread over many tasks and no file is read whole.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.frame import Frame
from gridlake.operators import arrays
from gridlake.operators.rowindex import ROW
from gridlake.sources.files import list_files, open_input, open_output, rename, spread

# Fixed values of the file format: type codes, list tags, padding.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {"tinyint": 1, "smallint": 3, "int": 4, "float": 5, "double": 6, "bigint": 10}
TAG_DIMENSION, TAG_VARIABLE, TAG_ATTRIBUTE = 10, 11, 12
STREAMING = 0xFFFFFFFF

RANGE_BYTES = 8 * 1024 * 1024
BATCH_CELLS = 1 << 16

VAR_META = (
    "file string, var string, dtype string, dims array<string>, shape array<bigint>, "
    "attrs map<string,string>, fill double, global_attrs map<string,string>, "
    "begin bigint, row_bytes bigint, stride bigint"
)
CELL = "file string, var string, pos bigint, value double, text string"


def _padded(n: int) -> int:
    return (n + 3) // 4 * 4


class _Header:
    """Sequential reader of a file header."""

    def __init__(self, source):
        self.source = source
        magic = source.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.version = magic[3]

    def number(self) -> int:
        return struct.unpack(">q", self.source.read(8))[0] if self.version == 5 else self.int4()

    def int4(self) -> int:
        return struct.unpack(">I", self.source.read(4))[0]

    def offset(self) -> int:
        return self.int4() if self.version == 1 else struct.unpack(">q", self.source.read(8))[0]

    def name(self) -> str:
        n = self.number()
        return self.source.read(_padded(n))[:n].decode()

    def items(self, read) -> list:
        tag, n = self.int4(), self.number()
        return [read() for _ in range(n)] if tag else []

    def attribute(self) -> tuple:
        name, kind, n = self.name(), TYPES[self.int4()], self.number()
        raw = self.source.read(_padded(n * np.dtype(kind).itemsize))
        if kind == "S1":
            return name, raw[:n].decode(errors="replace")
        values = np.frombuffer(raw, kind, n).tolist()
        return name, values[0] if n == 1 else values


def read_header(source, size: int) -> list[dict]:
    """The variables of a file with their place in it."""
    head = _Header(source)
    records = head.number()
    dims = head.items(lambda: (head.name(), head.number()))
    global_attrs = dict(head.items(head.attribute))

    def variable():
        name, rank = head.name(), head.number()
        ids = [head.number() for _ in range(rank)]
        attrs = dict(head.items(head.attribute))
        kind = TYPES[head.int4()]
        head.number()  # the stored size may be capped; it follows from the shape
        return name, ids, attrs, kind, head.offset()

    variables = head.items(variable)
    found = []
    for name, ids, attrs, kind, begin in variables:
        lengths = [dims[i][1] for i in ids]
        is_record = bool(ids) and lengths[0] == 0
        inner = lengths[1:] if ids else []
        row_bytes = int(np.prod(inner, dtype=np.int64)) * np.dtype(kind).itemsize
        found.append([name, [dims[i][0] for i in ids], lengths, attrs, kind, begin, row_bytes, is_record])
    in_record = [v for v in found if v[7]]
    # a lone record variable is not padded
    record_bytes = sum(_padded(v[6]) for v in in_record) if len(in_record) > 1 else sum(v[6] for v in in_record)
    if in_record and records in (STREAMING, -1):
        records = (size - min(v[5] for v in in_record)) // record_bytes
    out = []
    for name, dim_names, lengths, attrs, kind, begin, row_bytes, is_record in found:
        if not lengths:
            continue
        shape = [records, *lengths[1:]] if is_record else lengths
        fill = next((v for k, v in attrs.items() if k.lower() in ("_fillvalue", "missing_value")), None)
        out.append({
            "var": name, "dtype": np.dtype(kind).name if kind != "S1" else "char", "dims": dim_names,
            "shape": shape, "attrs": {k: str(v) for k, v in attrs.items()},
            "fill": float(fill) if isinstance(fill, (int, float)) else None,
            "global_attrs": {k: str(v) for k, v in global_attrs.items()},
            "begin": begin, "row_bytes": row_bytes, "stride": record_bytes if is_record else row_bytes,
        })
    return out


def var_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per variable of every ``.nc`` file at or below ``path``; headers only."""
    files = spread(list_files(spark, path, "*.nc").select("path", "length"), "path")
    names = [f.name for f in T._parse_datatype_string(VAR_META).fields]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as source:
                    variables = read_header(source, row["length"])
                for v in variables:
                    v["attrs"], v["global_attrs"] = list(v["attrs"].items()), list(v["global_attrs"].items())
                    v["file"] = row["path"]
                yield pa.RecordBatch.from_pylist([{n: v[n] for n in names} for v in variables], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(VAR_META))
    return files.mapInArrow(read, VAR_META)


def range_plan(meta: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges: some whole slices along the first axis, or a part of one slice."""
    slices = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(range_bytes) / F.greatest("row_bytes", F.lit(1))))
    rows = F.element_at("shape", 1)
    sized = meta.where((rows > 0) & (F.col("row_bytes") > 0)).withColumn("_slices", slices)
    starts = sized.withColumn(
        "row0", F.explode(F.sequence(F.lit(0).cast("bigint"), rows - 1, F.col("_slices")))
    ).withColumn("n_rows", F.least(F.col("_slices"), rows - F.col("row0")))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("row_bytes") - 1, F.lit(range_bytes).cast("bigint")))
    return starts.withColumn("byte0", part).select(
        "file", "var", "dtype", "begin", "row_bytes", "stride", "row0", "n_rows", "byte0",
        F.least(F.lit(range_bytes).cast("bigint"), F.col("row_bytes") - F.col("byte0")).alias("n_bytes"),
    )


def _read_range(source, r: dict) -> np.ndarray:
    """The cells of one range, in C order."""
    kind = "S1" if r["dtype"] == "char" else np.dtype(r["dtype"]).newbyteorder(">")
    if r["stride"] == r["row_bytes"] == r["n_bytes"]:
        source.seek(r["begin"] + r["row0"] * r["stride"])
        return np.frombuffer(source.read(r["n_rows"] * r["row_bytes"]), kind)
    if r["n_bytes"] == r["row_bytes"]:
        # interleaved records: one read over all of them, then the variable's share
        source.seek(r["begin"] + r["row0"] * r["stride"])
        raw = source.read((r["n_rows"] - 1) * r["stride"] + r["row_bytes"])
        whole = np.zeros(r["n_rows"] * r["stride"], np.uint8)
        whole[: len(raw)] = np.frombuffer(raw, np.uint8)
        share = whole.reshape(r["n_rows"], r["stride"])[:, : r["row_bytes"]]
        return np.ascontiguousarray(share).reshape(-1).view(kind)
    source.seek(r["begin"] + r["row0"] * r["stride"] + r["byte0"])
    return np.frombuffer(source.read(r["n_bytes"]), kind)


def _cell_batches(r: dict):
    with open_input(r["file"]) as source:
        cells = _read_range(source, r)
    item = 1 if r["dtype"] == "char" else np.dtype(r["dtype"]).itemsize
    first = (r["row0"] * r["row_bytes"] + r["byte0"]) // item
    for at in range(0, len(cells), BATCH_CELLS):
        part = cells[at : at + BATCH_CELLS]
        n = len(part)
        if r["dtype"] == "char":
            value, text = pa.nulls(n, pa.float64()), pa.array([c.decode("latin-1") for c in part], pa.string())
        else:
            value, text = pa.array(part.astype("f8")), pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([
            pa.array([r["file"]] * n, pa.string()), pa.array([r["var"]] * n, pa.string()),
            pa.array(np.arange(first + at, first + at + n)), value, text,
        ], ["file", "var", "pos", "value", "text"])


def read_cells(spark: SparkSession, path: str, variables: list[str] | None = None,
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, var, pos, value, text`` of every cell; fill values stay as stored."""
    meta = var_meta(spark, path)
    if variables is not None:
        meta = meta.where(F.col("var").isin(variables))

    return _read_plan(spread(range_plan(meta, range_bytes), "file", "var", "row0", "byte0"))


def _read_plan(plan: DataFrame) -> DataFrame:
    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _cell_batches(r)

    return plan.mapInArrow(read, CELL)


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the flattened files, from their headers."""
    counts = arrays.row_counts(var_meta(spark, path), "file")
    return counts.agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"))


def sample_frame(spark: SparkSession, path: str) -> Frame:
    """The first twenty values of each variable as columns, read as a few bytes each.

    At most ten slices along the first axis count; shorter variables are padded with
    their fill value, or NaN.
    """
    meta = var_meta(spark, path).where("dtype <> 'char'").withColumn("_inner", arrays.inner_cells(F.col("shape")))
    item = F.expr("row_bytes div _inner")
    rows = F.least(
        F.lit(arrays.SAMPLE_SLICES), F.element_at("shape", 1), F.ceil(F.lit(arrays.SAMPLE_VALUES) / F.col("_inner"))
    )
    head = meta.where((F.col("_inner") > 0) & (F.element_at("shape", 1) > 0)).select(
        "file", "var", "dtype", "begin", "row_bytes", "stride", F.lit(0).cast("bigint").alias("row0"),
        rows.cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("byte0"),
        F.when(rows > 1, F.col("row_bytes"))
        .otherwise(F.least(F.col("row_bytes"), item * arrays.SAMPLE_VALUES)).alias("n_bytes"),
    )
    cells = _read_plan(head).where(F.col("pos") < arrays.SAMPLE_VALUES)
    # one row per variable of one file
    pads = meta.select("var", F.coalesce("fill", F.lit(float("nan"))).alias("pad"))
    first, last = (F.lit(i).cast("bigint") for i in (0, arrays.SAMPLE_VALUES - 1))
    places = pads.withColumn("pos", F.explode(F.sequence(first, last)))
    padded = places.join(cells.select("var", "pos", "value"), ["var", "pos"], "left").select(
        "var", "pos", F.coalesce("value", "pad").alias("value")
    )
    names = sorted(r[0] for r in meta.select("var").distinct().collect())
    wide = arrays.columns_wide(padded, [], "var", names)
    return Frame(wide.withColumnRenamed("pos", ROW), dense=True)


def open_cells(spark: SparkSession, path: str, variables: list[str] | None = None) -> Frame:
    """Files as a frame: a column per variable, a row per position, short ones null.

    The rows of a folder's files follow one another by file name.
    """
    meta = var_meta(spark, path)
    names = variables or sorted(r[0] for r in meta.select("var").distinct().collect())
    cells = arrays.one_after_another(read_cells(spark, path, names), arrays.row_counts(meta, "file"))
    wide = arrays.columns_wide(cells, [], "var", names)
    return Frame(wide.withColumnRenamed("pos", ROW), dense=True)


# -- writing -------------------------------------------------------------------
def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack(">q", len(raw)) + raw.ljust(_padded(len(raw)), b"\0")


def _attributes(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">iq", 0, 0)
    out = struct.pack(">iq", TAG_ATTRIBUTE, len(attrs))
    for name, value in attrs.items():
        if isinstance(value, str):
            raw = value.encode()
            out += _text(name) + struct.pack(">iq", 2, len(raw)) + raw.ljust(_padded(len(raw)), b"\0")
        else:
            out += _text(name) + struct.pack(">iqd", 6, 1, float(value))
    return out


def _file_header(columns: list[tuple], attrs: dict, global_attrs: dict) -> bytes:
    """Header with an open record count, so that records can be appended as they come."""
    dims = [("record", 0)]
    bodies, sizes = [], []
    for name, code, shape in columns:
        ids = [0]
        for axis, length in enumerate(shape):
            dims.append((f"{name}_dim{axis + 1}", length))
            ids.append(len(dims) - 1)
        bodies.append(
            _text(name) + struct.pack(">q", len(ids)) + b"".join(struct.pack(">q", i) for i in ids)
            + _attributes(attrs.get(name, {}))
        )
        sizes.append(_record_part(code, shape, len(columns)))
    top = b"CDF\x05" + struct.pack(">q", -1)
    top += struct.pack(">iq", TAG_DIMENSION, len(dims))
    top += b"".join(_text(n) + struct.pack(">q", size) for n, size in dims)
    top += _attributes(global_attrs) + struct.pack(">iq", TAG_VARIABLE, len(columns))
    begin = len(top) + sum(len(b) + 20 for b in bodies)
    out = top
    for (_, code, _), body, size in zip(columns, bodies, sizes):
        out += body + struct.pack(">iqq", code, size, begin)
        begin += size
    return out


def _record_part(code: int, shape: tuple, n_columns: int) -> int:
    size = int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[code]).itemsize
    return _padded(size) if n_columns > 1 else size


def write_records(df: DataFrame, folder: str, shapes: dict[str, tuple] | None = None,
                  attrs: dict | None = None, global_attrs: dict | None = None) -> int:
    """Write numeric columns as record variables, one ``.nc`` file per task.

    Array columns take the record shape given in ``shapes``.  Nulls become the column's
    ``_FillValue`` attribute (NaN for floating columns without one).  Returns the number
    of records.
    """
    shapes, attrs = shapes or {}, attrs or {}
    columns = []
    for field in df.schema.fields:
        inner = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
        code = CODES.get(inner.simpleString())
        if code is None:
            raise TypeError(f"column {field.name} of type {inner.simpleString()} has no array type")
        if isinstance(field.dataType, T.ArrayType) and field.name not in shapes:
            raise ValueError(f"array column {field.name} needs a shape")
        columns.append((field.name, code, tuple(shapes.get(field.name, ()))))
    header = _file_header(columns, attrs, global_attrs or {})
    layout = []
    for name, code, shape in columns:
        size = int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[code]).itemsize
        layout.append((name, TYPES[code], shape))
        if _record_part(code, shape, len(columns)) > size:
            layout.append((f"_pad_{name}", "u1", (_record_part(code, shape, len(columns)) - size,)))
    record = np.dtype(layout)

    def filled(column, name, kind):
        flat = column.flatten() if pa.types.is_list(column.type) else column
        if flat.null_count:
            default = float("nan") if kind.startswith(">f") else None
            fill = attrs.get(name, {}).get("_FillValue", default)
            if fill is None:
                raise ValueError(f"column {name} holds nulls but has no _FillValue")
            flat = flat.fill_null(pa.scalar(fill).cast(flat.type))
        return flat.to_numpy(zero_copy_only=False)

    def write(batches):
        part = TaskContext.get().partitionId()
        done = f"{folder}/part-{part:06d}.nc"
        trying = f"{folder}/.trying-{part:06d}-{uuid.uuid4().hex}"
        rows = 0
        with open_output(trying) as sink:
            sink.write(header)
            for batch in batches:
                block = np.zeros(batch.num_rows, record)
                for name, code, shape in columns:
                    values = filled(batch.column(name), name, TYPES[code])
                    block[name] = values.reshape(batch.num_rows, *shape)
                sink.write(block.tobytes())
                rows += batch.num_rows
        rename(trying, done)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(write, "rows bigint").agg({"rows": "sum"}).first()[0] or 0


def write_columns(frame: Frame, folder: str) -> int:
    """A frame's columns as one-dimensional variables, in row order."""
    return write_records(frame.ordered, folder)
