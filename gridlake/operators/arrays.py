"""N-dimensional arrays as cell tables.

A cell table holds one row per array element: grouping columns, ``pos`` (0-based
position in C order) and ``value``.  ``var_meta`` tables hold one row per variable:
``shape`` (array of long), ``dtype``, ``dims``, ``fill``.  No operator gathers a
whole variable: work is grouped by fixed-size chunks of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chunk target in bytes, least rows per chunk, sample lengths, band counts.
CHUNK_BYTES = 10 * 1024 * 1024
MIN_CHUNK_ROWS = 10
SAMPLE_SLICES = 10
SAMPLE_VALUES = 20
BAND_COUNTS = [1, 3, 4]


def flatten(df: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """One row per element, in C order."""
    return df.select(*keys, F.posexplode(array).alias("pos", "value"))


def cells_of_shape(shape: Column) -> Column:
    """Number of cells of a shape."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def inner_cells(shape: Column) -> Column:
    """Cells in one slice along the first axis."""
    return cells_of_shape(F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0))))


def row_counts(var_meta: DataFrame, *keys: str) -> DataFrame:
    """Rows a flattened file has: the cells of its largest variable. No data is read."""
    return var_meta.groupBy(*keys).agg(F.max(cells_of_shape(F.col("shape"))).alias("total_rows"))


def one_after_another(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells of several files with positions that run on from file to file, by file name.

    ``counts`` has ``file, total_rows``, so the window is as small as the list of files.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", F.coalesce(F.sum("total_rows").over(before), F.lit(0)).alias("_base"))
    return cells.join(bases, "file").withColumn("pos", F.col("pos") + F.col("_base")).drop("_base")


def chunk_rows(shape: Column, item_bytes: int = 8, target_bytes: int = CHUNK_BYTES) -> Column:
    """Slices along the first axis that make up one chunk."""
    fitting = F.floor(F.lit(target_bytes) / (inner_cells(shape) * item_bytes))
    return F.greatest(F.lit(MIN_CHUNK_ROWS).cast("bigint"), fitting)


def chunk_plan(var_meta: DataFrame, item_bytes: int = 8, target_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: ``chunk_no, row_start, row_count`` along the first axis."""
    length = F.element_at("shape", 1)
    sized = var_meta.withColumn("_step", chunk_rows(F.col("shape"), item_bytes, target_bytes))
    last = F.floor((length - 1) / F.col("_step")).cast("bigint")
    spread = sized.where(length > 0).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    start = F.col("chunk_no") * F.col("_step")
    return spread.withColumn("row_start", start).withColumn(
        "row_count", F.least(F.col("_step"), length - start)
    ).drop("_step")


def coordinates(cells: DataFrame, shape: list[int], names: list[str]) -> DataFrame:
    """The index along each axis of every cell."""
    out = {}
    stride = 1
    for size, name in reversed(list(zip(shape, names))):
        out[name] = F.expr(f"pos div {stride}") % size if stride > 1 else F.col("pos") % size
        stride *= size
    return cells.withColumns({name: out[name].cast("bigint") for name in names})


def with_coordinate_values(cells: DataFrame, axis: str, values: DataFrame, name: str) -> DataFrame:
    """Attach a coordinate variable (``pos, value``) along one axis of a cell table."""
    lookup = values.select(F.col("pos").cast("bigint").alias(axis), F.col("value").alias(name))
    return cells.join(lookup, axis, "left")


def sample(cells: DataFrame, keys: list[str], inner: Column, pad: Column) -> DataFrame:
    """The first values of each variable, padded to the sample length.

    ``inner`` is the number of cells in one slice along the first axis, ``pad`` the
    value for places past the end.
    """
    head = cells.where((F.col("pos") < inner * SAMPLE_SLICES) & (F.col("pos") < SAMPLE_VALUES))
    # at most SAMPLE_VALUES places per variable
    places = cells.select(*keys).distinct().withColumn(
        "pos", F.explode(F.sequence(F.lit(0), F.lit(SAMPLE_VALUES - 1)))
    )
    joined = places.join(head.select(*keys, "pos", F.col("value").cast("double").alias("value"),
                                     F.lit(True).alias("_there")), [*keys, "pos"], "left")
    return joined.select(*keys, "pos", F.when(F.col("_there"), F.col("value")).otherwise(pad).alias("value"))


def columns_wide(cells: DataFrame, keys: list[str], by: str, categories: list, pad=None, prefix="") -> DataFrame:
    """One column per variable or band, one row per position; short ones padded.

    ``pad`` fills the places past a column's end (null when not given).
    """
    wide = cells.groupBy(*keys, "pos").pivot(by, categories).agg(
        F.first("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    columns = []
    for c in categories:
        value = F.col(f"`{c}_v`")
        if pad is not None:
            value = F.when(F.coalesce(F.col(f"`{c}_n`"), F.lit(0)) > 0, value).otherwise(F.lit(pad))
        columns.append(value.alias(f"{prefix}{c}"))
    return wide.select(*keys, "pos", *columns)


def band_layout(shape: Column) -> Column:
    """How a raster of this shape splits: bands first, bands last, pages or flat."""
    def side(i: int) -> Column:
        return F.try_element_at(shape, F.lit(i))

    first = side(1).isin(BAND_COUNTS) & (side(1) < side(2)) & (side(1) < side(3))
    last = side(3).isin(BAND_COUNTS) & (side(3) < side(1)) & (side(3) < side(2))
    return (
        F.when(F.size(shape) == 2, "single")
        .when((F.size(shape) == 3) & first, "bands_first")
        .when((F.size(shape) == 3) & last, "bands_last")
        .when(F.size(shape).isin(3, 4), "pages")
        .otherwise("flat")
    )


def band_plan(rasters: DataFrame, shape: str = "shape") -> DataFrame:
    """Add to a table with one row per raster what :func:`split_bands` needs per cell.

    ``page_cells`` (cells of one page), ``layout`` of a page, and ``plane``: cells of one
    band when bands come first, number of bands when they come last.  Pages of a stack
    follow the same rule as single images; a page without a band axis is flat.
    """
    planned = rasters.withColumn("_layout", band_layout(F.col(shape)))
    page = F.when(F.col("_layout") == "pages", F.slice(shape, F.lit(2), F.size(shape) - 1)).otherwise(F.col(shape))
    planned = planned.withColumn("_page", page).withColumn("_inner", band_layout(F.col("_page")))
    planned = planned.withColumn("layout", F.when(F.col("_inner") == "pages", "flat").otherwise(F.col("_inner")))
    last_two = F.try_element_at("_page", F.lit(2)) * F.try_element_at("_page", F.lit(3))
    return planned.withColumns({
        "page_cells": cells_of_shape(F.col("_page")),
        "plane": F.when(F.col("layout") == "bands_first", last_two)
        .when(F.col("layout") == "bands_last", F.element_at("_page", -1)).otherwise(F.lit(1)),
    }).drop("_layout", "_page", "_inner")


def split_bands(cells: DataFrame) -> DataFrame:
    """``page, band, band_pos`` of every cell of a planned raster.

    Pages and bands count from 1; a page that is one flat column has band 0.  Only
    integer arithmetic happens per cell, the layout was decided per raster.
    """
    within = F.expr("CAST(pos % page_cells AS BIGINT)")
    placed = cells.withColumns({"page": F.expr("CAST(pos div page_cells AS BIGINT) + 1"), "_within": within})
    return placed.withColumns({
        "band": F.expr("""CASE layout WHEN 'single' THEN 1L WHEN 'bands_first' THEN _within div plane + 1
            WHEN 'bands_last' THEN _within % plane + 1 ELSE 0L END"""),
        "band_pos": F.expr("""CASE layout WHEN 'bands_first' THEN _within % plane
            WHEN 'bands_last' THEN _within div plane ELSE _within END"""),
    }).drop("_within")


def fill_value(attrs: Column) -> Column:
    """The fill value among a variable's attributes, whatever the letter case of its name."""
    named = F.map_filter(attrs, lambda k, _: F.lower(k).isin("_fillvalue", "missing_value"))
    return F.element_at(F.map_values(named), 1)


def mask_fill(value: Column, fill: Column) -> Column:
    """Fill values as null."""
    return F.when(value.eqNullSafe(fill), F.lit(None)).otherwise(value)


def restore_fill(value: Column, fill: Column) -> Column:
    """Null and NaN as the fill value."""
    return F.when(value.isNull() | F.isnan(value), fill).otherwise(value)


def rebuild_chunks(cells: DataFrame, keys: list[str], cells_per_chunk: int, length: Column | None = None) -> DataFrame:
    """Ordered arrays of at most ``cells_per_chunk`` cells: ``chunk_no, values``.

    Cells at or past ``length`` are padding and dropped.  A group is one chunk, so its
    size is fixed however large the variable is.
    """
    real = cells if length is None else cells.where(F.col("pos") < length)
    numbered = real.withColumn("chunk_no", F.floor(F.col("pos") / cells_per_chunk))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return numbered.groupBy(*keys, "chunk_no").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def to_rows(values: Column, width: int) -> Column:
    """A flat chunk as rows of ``width`` values."""
    count = F.ceil(F.size(values) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))


def stack_bands(chunks: DataFrame, keys: list[str], bands: list[int]) -> DataFrame:
    """Chunks of several bands side by side: one array per position with all bands."""
    wide = chunks.groupBy(*keys, "chunk_no").pivot("band", bands).agg(F.first("values"))
    zipped = F.arrays_zip(*[F.col(f"`{b}`") for b in bands])
    pixels = F.transform(zipped, lambda z: F.array(*[z[str(b)] for b in bands]))
    return wide.select(*keys, "chunk_no", pixels.alias("pixels"))


def encode(df: DataFrame, array: str, keys: list[str], shape: list[int], dtype: str) -> DataFrame:
    """One row per cell that also carries shape and dtype, as a self-describing table."""
    cells = flatten(df, array, keys)
    return cells.select(
        *keys, "pos", F.col("value").alias("data"),
        F.array(*[F.lit(s).cast("bigint") for s in shape]).alias("shape"), F.lit(dtype).alias("dtype"),
    )


def attribute_report(var_meta: DataFrame, variables: list[str], attributes: list[str]) -> DataFrame:
    """Attributes as rows, variables as columns."""
    texts = var_meta.select("var", *[F.col(a).cast("string").alias(a) for a in attributes])
    long = texts.unpivot(["var"], attributes, "attribute", "text")
    return long.groupBy("attribute").pivot("var", variables).agg(F.first("text"))
