"""Uncompressed baseline TIFF files as cell tables, and arrays as raster pages.

As with arrays, reading is planned as a table: one row per strip, read by its task.
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
from pyspark.sql.pandas.types import to_arrow_schema

from gridlake.frame import Frame
from gridlake.operators import arrays
from gridlake.operators.rowindex import ROW
from gridlake.sources.files import list_files, open_input, open_output, rename, spread

# Fixed values of the file format: tags, and value sizes and codes by field type.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES = 256, 257, 258, 259, 273, 277
ROWS_PER_STRIP, STRIP_BYTES, PLANAR, TILE_WIDTH, SAMPLE_FORMAT = 278, 279, 284, 322, 339
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f"}

BATCH_CELLS = 1 << 16
ROLL_BYTES = 1 << 30
RANGE_BYTES = 8 * 1024 * 1024

STRIP = (
    "file string, page bigint, height bigint, width bigint, samples bigint, planar int, dtype string, "
    "offset bigint, n_bytes bigint, first bigint"
)
CELL = "file string, page bigint, band bigint, pos bigint, value double"


def _directory(source, order: str, at: int) -> tuple[dict, int]:
    """The tags of one image directory and the place of the next."""
    source.seek(at)
    (n,) = struct.unpack(order + "H", source.read(2))
    raw = source.read(12 * n)
    (following,) = struct.unpack(order + "I", source.read(4))
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[12 * i : 12 * i + 8])
        if kind not in FIELD_TYPES:
            continue
        form = order + FIELD_TYPES[kind] * count if kind != 2 else f"{count}s"
        size = struct.calcsize(form)
        inline = raw[12 * i + 8 : 12 * i + 12]
        if size > 4:
            source.seek(struct.unpack(order + "I", inline)[0])
            inline = source.read(size)
        tags[tag] = struct.unpack(form, inline[:size])
    return tags, following


def read_strips(source) -> list[dict]:
    """The strips of all pages of one file, long ones in several ranges."""
    mark = source.read(8)
    order = {b"II": "<", b"MM": ">"}.get(mark[:2])
    if order is None or struct.unpack(order + "H", mark[2:4])[0] != 42:
        raise ValueError("not a baseline TIFF file")
    (at,) = struct.unpack(order + "I", mark[4:8])
    strips, page = [], 0
    while at:
        tags, at = _directory(source, order, at)
        page += 1
        if tags.get(COMPRESSION, (1,))[0] != 1 or TILE_WIDTH in tags:
            raise ValueError("compressed and tiled rasters are not supported")
        samples = tags.get(SAMPLES, (1,))[0]
        bits = tags.get(BITS, (1,))[0]
        kind = SAMPLE_KINDS[tags.get(SAMPLE_FORMAT, (1,))[0]]
        dtype = np.dtype(f"{order}{kind}{bits // 8}")
        first = 0
        for offset, size in zip(tags[OFFSETS], tags[STRIP_BYTES]):
            for part in range(0, size, RANGE_BYTES):
                n_bytes = min(RANGE_BYTES, size - part)
                strips.append({
                    "page": page, "height": tags[HEIGHT][0], "width": tags[WIDTH][0], "samples": samples,
                    "planar": tags.get(PLANAR, (1,))[0], "dtype": dtype.str,
                    "offset": offset + part, "n_bytes": n_bytes, "first": first,
                })
                first += n_bytes // dtype.itemsize
    return strips


def strip_plan(spark: SparkSession, path: str) -> DataFrame:
    """One row per strip of every TIFF file at or below ``path``; directories only."""
    files = spread(list_files(spark, path, "*.tif|*.tiff").select("path"), "path")
    arrow = to_arrow_schema(T._parse_datatype_string(STRIP))

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as source:
                    strips = read_strips(source)
                for at in range(0, len(strips), BATCH_CELLS):
                    rows = [{"file": path, **s} for s in strips[at : at + BATCH_CELLS]]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(read, STRIP)


def page_meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: shape, type and bands."""
    bands_last = F.array("height", "width", "samples")
    bands_first = F.array("samples", "height", "width")
    shape = (
        F.when(F.col("samples") == 1, F.array("height", "width"))
        .when(F.col("planar") == 2, bands_first).otherwise(bands_last)
    )
    return strip_plan(spark, path).where("first = 0").select(
        "file", "page", shape.alias("shape"), "dtype", F.col("samples").alias("bands"), "height", "width"
    )


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the largest band of each file, added up, from their directories."""
    return _file_rows(page_meta(spark, path)).agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"))


def _file_rows(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file").agg(F.max(F.col("height") * F.col("width")).alias("total_rows"))


def sample_frame(spark: SparkSession, path: str) -> Frame:
    """The first twenty pixels of each band of the first page, padded with NaN."""
    plan = strip_plan(spark, path).where("page = 1")
    near = (F.col("planar") == 2) | (F.col("first") < F.col("samples") * arrays.SAMPLE_VALUES)
    cells = _read_plan(plan.where(near))
    bands = plan.agg(F.max("samples")).first()[0]
    names = [f"page1_band{b + 1}" for b in range(bands)]
    sample = arrays.sample(cells, ["band"], F.lit(arrays.SAMPLE_VALUES), F.lit(float("nan")))
    named = sample.withColumn("column", F.concat(F.lit("page1_band"), F.col("band").cast("string")))
    wide = arrays.columns_wide(named, [], "column", names)
    return Frame(wide.withColumnRenamed("pos", ROW), dense=True)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``file, page, band, pos, value`` of every pixel; pages and bands count from 1."""
    return _read_plan(spread(strip_plan(spark, path), "file", "page", "first"))


def _read_plan(plan: DataFrame) -> DataFrame:

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                with open_input(s["file"]) as source:
                    source.seek(s["offset"])
                    data = np.frombuffer(source.read(s["n_bytes"]), s["dtype"])
                index = np.arange(s["first"], s["first"] + len(data))
                if s["planar"] == 2:
                    plane = s["height"] * s["width"]
                    band, pos = index // plane + 1, index % plane
                else:
                    band, pos = index % s["samples"] + 1, index // s["samples"]
                for at in range(0, len(data), BATCH_CELLS):
                    cut = slice(at, at + BATCH_CELLS)
                    n = len(data[cut])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s["file"]] * n, pa.string()), pa.array(np.full(n, s["page"], "i8")),
                        pa.array(band[cut].astype("i8")), pa.array(pos[cut].astype("i8")),
                        pa.array(data[cut].astype("f8")),
                    ], ["file", "page", "band", "pos", "value"])

    return plan.mapInArrow(read, CELL)


def open_cells(spark: SparkSession, path: str) -> Frame:
    """Files as a frame: a ``pageN_bandM`` column per band, a row per pixel, short ones null.

    The pixels of a folder's files follow one another by file name.
    """
    meta = page_meta(spark, path)
    pages = meta.groupBy("page").agg(F.max("bands").alias("bands")).orderBy("page").collect()
    names = [f"page{p['page']}_band{b + 1}" for p in pages for b in range(p["bands"])]
    named = arrays.one_after_another(read_cells(spark, path), _file_rows(meta)).withColumn(
        "column", F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_band"), F.col("band").cast("string"))
    )
    wide = arrays.columns_wide(named, [], "column", names)
    return Frame(wide.withColumnRenamed("pos", ROW), dense=True)


# -- writing -------------------------------------------------------------------
def _page(at: int, height: int, width: int, dtype: np.dtype, last: bool) -> bytes:
    """The directory of a one-strip page that starts at ``at``; its pixels follow."""
    n_bytes = height * width * dtype.itemsize
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    entries = [
        (WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, dtype.itemsize * 8), (COMPRESSION, 3, 1),
        (262, 3, 1), (OFFSETS, 4, 0), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, height), (STRIP_BYTES, 4, n_bytes),
        (SAMPLE_FORMAT, 3, kind),
    ]
    size = 2 + 12 * len(entries) + 4
    out = struct.pack("<H", len(entries))
    for tag, code, value in entries:
        value = at + size if tag == OFFSETS else value
        out += struct.pack("<HHI", tag, code, 1) + (struct.pack("<HH", value, 0) if code == 3 else struct.pack("<I", value))
    return out + struct.pack("<I", 0 if last else at + size + n_bytes)


def write_pages(df: DataFrame, folder: str, height: int, width: int, dtype: str = "f4") -> int:
    """Each array of the only column as one page, in files per task; returns the pages."""
    kind = np.dtype("<" + dtype)
    (column,) = df.columns
    span = len(_page(0, height, width, kind, True)) + height * width * kind.itemsize

    def write(batches):
        part = TaskContext.get().partitionId()
        pages, files, sink, at, waiting, trying = 0, 0, None, 8, None, ""

        def flush(last):
            sink.write(_page(at, height, width, kind, last) + waiting)

        for batch in batches:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind)
            for image in flat.reshape(batch.num_rows, height * width):
                if waiting is not None:
                    full = at + 2 * span > ROLL_BYTES
                    flush(full)
                    at += span
                    if full:
                        sink.close()
                        rename(trying, f"{folder}/part-{part:06d}-{files:04d}.tif")
                        files, sink, at = files + 1, None, 8
                if sink is None:
                    trying = f"{folder}/.trying-{part:06d}-{uuid.uuid4().hex}"
                    sink = open_output(trying)
                    sink.write(struct.pack("<2sHI", b"II", 42, 8))
                waiting = image.tobytes()
                pages += 1
        if waiting is not None:
            flush(True)
            sink.close()
            rename(trying, f"{folder}/part-{part:06d}-{files:04d}.tif")
        yield pa.RecordBatch.from_pydict({"pages": pa.array([pages], pa.int64())})

    return df.mapInArrow(write, "pages bigint").agg({"pages": "sum"}).first()[0] or 0
