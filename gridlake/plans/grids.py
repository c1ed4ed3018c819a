"""Arrays and rasters as cell tables; every embedding stands for an 8 x 8 grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import arrays, profile
from gridlake.plans.inputs import CELLS_SQL, cells, table

FILL = -9999.0

# grid shapes by label; cells past the product of a shape are left out
SHAPES = {0: [8, 8], 1: [3, 4, 4], 2: [4, 4, 3], 3: [4, 4, 4], 4: [2, 4, 4, 2], 5: [1, 3, 4, 5]}
FLAT_SHAPE = [64]


def array_flatten(spark, sf_dir):
    return arrays.flatten(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


def _ragged(spark, sf_dir):
    return cells(spark, sf_dir).where(F.col("pos") < 1 + F.col("vec_id") % 40)


_RAGGED_SQL = f"(SELECT * FROM {CELLS_SQL} WHERE pos < 1 + vec_id % 40)"


def array_sample(spark, sf_dir):
    """The first values of every grid; even labels are vectors, odd ones have slices of eight."""
    inner = F.when(F.col("label") % 2 == 0, 1).otherwise(8)
    sample = arrays.sample(_ragged(spark, sf_dir), ["vec_id", "label"], inner, F.lit(FILL))
    return sample.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def _var_meta(spark, sf_dir):
    counted = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    eight = F.lit(8).cast("bigint")
    return counted.select(
        F.concat(F.lit("file"), (F.col("label") % 3).cast("string")).alias("file"),
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("var"),
        F.array("n", eight, eight).alias("shape"),
        F.lit("float32").alias("dtype"), F.lit(-9999).alias("fill"),
    )


_VAR_META_SQL = """(SELECT 'file' || (label % 3) AS file, 'v' || label AS var, count(*) AS n
  FROM embeddings GROUP BY label)"""


def array_count(spark, sf_dir):
    return arrays.row_counts(_var_meta(spark, sf_dir), "file")


def array_chunk_plan(spark, sf_dir):
    plan = arrays.chunk_plan(_var_meta(spark, sf_dir), target_bytes=8 * 1024)
    return plan.select("file", "var", "chunk_no", "row_start", "row_count")


def var_meta_report(spark, sf_dir):
    meta = _var_meta(spark, sf_dir).withColumn("shape", F.array_join("shape", "x"))
    names = sorted(r["var"] for r in meta.select("var").distinct().collect())  # one per label
    return arrays.attribute_report(meta, names, ["shape", "dtype", "fill"])


def array_pad(spark, sf_dir):
    """Four interleaved bands of uneven length as columns, padded at the end."""
    ragged = cells(spark, sf_dir).where(F.col("pos") < 64 - F.col("vec_id") % 5)
    banded = ragged.select(
        "vec_id", F.concat(F.lit("b"), (F.col("pos") % 4).cast("string")).alias("band"),
        F.expr("CAST(pos div 4 AS BIGINT)").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"),
    )
    return arrays.columns_wide(banded, ["vec_id"], "band", ["b0", "b1", "b2", "b3"], pad=FILL)


def _shaped(spark, sf_dir):
    shape = F.array(*[F.lit(s).cast("bigint") for s in FLAT_SHAPE])
    for label, sides in SHAPES.items():
        literal = F.array(*[F.lit(s).cast("bigint") for s in sides])
        shape = F.when(F.col("label") == label, literal).otherwise(shape)
    rasters = table(spark, sf_dir, "embeddings").withColumn("shape", shape)
    planned = arrays.band_plan(rasters).withColumn("n", arrays.cells_of_shape(F.col("shape")))
    spread = planned.select(
        "vec_id", "label", "page_cells", "layout", "plane", "n", F.posexplode("embedding").alias("pos", "value")
    )
    return spread.where(F.col("pos") < F.col("n"))


def raster_bands(spark, sf_dir):
    split = arrays.split_bands(_shaped(spark, sf_dir))
    return split.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "page", "band", "band_pos")


def raster_count(spark, sf_dir):
    split = arrays.split_bands(_shaped(spark, sf_dir))
    sizes = split.groupBy("vec_id", "page", "band").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("vec_id").agg(F.max("n").alias("total_rows"))


def raster_sample(spark, sf_dir):
    """First page, first values of each band, padded."""
    split = arrays.split_bands(_shaped(spark, sf_dir)).where("page = 1")
    banded = split.select("vec_id", "band", F.col("band_pos").alias("pos"), "value")
    sample = arrays.sample(banded, ["vec_id", "band"], F.lit(1_000_000), F.lit(FILL))
    return sample.select("vec_id", "band", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


# (label test, cells, page, band, position in band) of each shape, written out by hand
_LAYOUTS = [
    ("label = 0", 64, "1", "1", "pos"),
    ("label = 1", 48, "1", "pos // 16 + 1", "pos % 16"),
    ("label = 2", 48, "1", "pos % 3 + 1", "pos // 3"),
    ("label = 3", 64, "pos // 16 + 1", "1", "pos % 16"),
    ("label = 4", 64, "pos // 32 + 1", "0", "pos % 32"),
    ("label = 5", 60, "1", "pos // 20 + 1", "pos % 20"),
    ("label > 5", 64, "1", "0", "pos"),
]
_BANDS_SQL = "(" + " UNION ALL ".join(
    f"""SELECT vec_id, pos, value, ({page})::BIGINT AS page, ({band})::BIGINT AS band, ({at})::BIGINT AS band_pos
    FROM {CELLS_SQL} WHERE {test} AND pos < {n}""" for test, n, page, band, at in _LAYOUTS
) + ")"


def array_coords(spark, sf_dir):
    """Row and column of each cell, with the coordinate value of its row attached."""
    placed = arrays.coordinates(cells(spark, sf_dir), [8, 8], ["y", "x"])
    means = placed.groupBy("y").agg(F.round(F.avg("value"), 6).alias("value"))
    axis = means.select(F.col("y").alias("pos"), "value")
    joined = arrays.with_coordinate_values(placed, "y", axis, "y_value")
    return joined.select("vec_id", "y", "x", "y_value", F.round(F.col("value").cast("double"), 6).alias("value"))


def _filled(spark, sf_dir):
    value = F.when(F.col("pos") % 16 == 0, F.lit(FILL)).otherwise(F.col("value").cast("double"))
    return cells(spark, sf_dir).withColumn("value", value)


def array_fill(spark, sf_dir):
    """Fill values masked, and put back after nulls and NaN came in."""
    filled = _filled(spark, sf_dir)
    attrs = F.create_map(F.lit("units"), F.lit(1.0), F.lit("MISSING_VALUE"), F.lit(FILL))
    fill = arrays.fill_value(attrs)
    masked = arrays.mask_fill(F.col("value"), fill)
    spoilt = F.when(F.col("pos") % 16 == 1, F.lit(float("nan"))).otherwise(masked)
    return filled.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(masked, 6).alias("masked"),
        F.round(arrays.restore_fill(spoilt, fill), 6).alias("restored"),
    )


def _whole(value):
    return F.round(value.cast("double") * 1000).cast("int")


def array_rebuild(spark, sf_dir):
    """Padding trimmed, cells ordered into chunks, chunks cut into rows of eight."""
    padded = cells(spark, sf_dir).withColumn("value", _whole(F.col("value")))
    chunks = arrays.rebuild_chunks(padded, ["vec_id"], 16, F.lit(60))
    rows = chunks.withColumn("rows", arrays.to_rows(F.col("values"), 8))
    text = F.transform("rows", lambda r: F.array_join(r, ","))
    return rows.select("vec_id", "chunk_no", F.array_join(text, ";").alias("rows"))


def raster_rebuild(spark, sf_dir):
    """Interleaved bands rebuilt as chunks and stacked back into pixels."""
    banded = cells(spark, sf_dir).select(
        "vec_id", (F.col("pos") % 4).alias("band"), F.expr("pos div 4").alias("pos"), _whole(F.col("value")).alias("value")
    )
    chunks = arrays.rebuild_chunks(banded, ["vec_id", "band"], 8)
    stacked = arrays.stack_bands(chunks, ["vec_id"], [0, 1, 2, 3])
    text = F.transform("pixels", lambda p: F.array_join(p, ","))
    return stacked.select("vec_id", "chunk_no", F.array_join(text, ";").alias("pixels"))


def array_encode(spark, sf_dir):
    encoded = arrays.encode(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], [8, 8], "float32")
    return encoded.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), _whole(F.col("data")).alias("data"),
        F.array_join("shape", "x").alias("shape"), "dtype",
    )


def roundtrip_diff(spark, sf_dir):
    """Cells against a copy rebuilt from chunks, in which some are lost and some filled."""
    original = cells(spark, sf_dir).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))
    chunks = arrays.rebuild_chunks(original, ["vec_id"], 16, F.lit(60))
    back = chunks.select(
        "vec_id", "chunk_no", F.posexplode("values").alias("at", "value")
    ).select("vec_id", (F.col("chunk_no") * 16 + F.col("at")).alias("pos"), "value")
    spoilt = back.withColumn("value", F.when(F.col("pos") % 16 == 0, F.lit(FILL)).otherwise(F.col("value")))
    return profile.roundtrip_diff(original, spoilt, ["vec_id", "pos"], ["value"])


_PLACES = "(SELECT unnest(range(20)) AS p)"

QUERIES = {
    "array_flatten": (array_flatten, """SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos,
      unnest(embedding) AS value FROM embeddings"""),
    "array_sample": (array_sample, f"""SELECT v.vec_id, p AS pos, coalesce(round(c.value::DOUBLE, 6), {FILL}) AS value
      FROM (SELECT vec_id, label FROM embeddings) v CROSS JOIN {_PLACES}
      LEFT JOIN {_RAGGED_SQL} c ON c.vec_id = v.vec_id AND c.pos = p AND (v.label % 2 = 1 OR p < 10)"""),
    "array_count": (array_count, f"SELECT file, (max(n) * 64)::BIGINT AS total_rows FROM {_VAR_META_SQL} GROUP BY file"),
    "array_chunk_plan": (array_chunk_plan, f"""SELECT file, var, k AS chunk_no, k * 16 AS row_start,
      least(16, n - k * 16) AS row_count
      FROM (SELECT *, unnest(range((n + 15) // 16)) AS k FROM {_VAR_META_SQL})"""),
    "var_meta_report": (var_meta_report, "WITH m AS " + _VAR_META_SQL + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS attribute, " + ", ".join(
            f"max({value}) FILTER (WHERE var = 'v{i}') AS v{i}" for i in range(10)) + " FROM m"
        for name, value in [("shape", "n || 'x8x8'"), ("dtype", "'float32'"), ("fill", "'-9999'")])),
    "array_pad": (array_pad, "SELECT vec_id, pos // 4 AS pos, " + ", ".join(
        f"coalesce(max(round(value::DOUBLE, 6)) FILTER (WHERE pos % 4 = {b}), {FILL}) AS b{b}" for b in range(4)
    ) + f" FROM {CELLS_SQL} WHERE pos < 64 - vec_id % 5 GROUP BY 1, 2"),
    "raster_bands": (raster_bands, f"SELECT vec_id, pos, page, band, band_pos FROM {_BANDS_SQL}"),
    "raster_count": (raster_count, f"""SELECT vec_id, max(n) AS total_rows FROM (
      SELECT vec_id, page, band, count(*) AS n FROM {_BANDS_SQL} GROUP BY 1, 2, 3) GROUP BY 1"""),
    "raster_sample": (raster_sample, f"""WITH b AS (SELECT * FROM {_BANDS_SQL} WHERE page = 1)
      SELECT v.vec_id, v.band, p AS pos, coalesce(round(b.value::DOUBLE, 6), {FILL}) AS value
      FROM (SELECT DISTINCT vec_id, band FROM b) v CROSS JOIN {_PLACES}
      LEFT JOIN b ON b.vec_id = v.vec_id AND b.band = v.band AND b.band_pos = p"""),
    "array_coords": (array_coords, f"""WITH c AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, value FROM {CELLS_SQL})
      SELECT vec_id, c.y, x, y_value, round(value::DOUBLE, 6) AS value
      FROM c JOIN (SELECT y, round(avg(value::DOUBLE), 6) AS y_value FROM c GROUP BY y) m ON c.y = m.y"""),
    "array_fill": (array_fill, f"""SELECT vec_id, pos,
      CASE WHEN pos % 16 <> 0 THEN round(value::DOUBLE, 6) END AS masked,
      CASE WHEN pos % 16 < 2 THEN {FILL} ELSE round(value::DOUBLE, 6) END AS restored FROM {CELLS_SQL}"""),
    "array_rebuild": (array_rebuild, f"""SELECT vec_id, pos // 16 AS chunk_no,
      string_agg(line, ';' ORDER BY pos) AS rows FROM (
        SELECT vec_id, min(pos) AS pos, string_agg(round(value::DOUBLE * 1000)::INTEGER::VARCHAR, ',' ORDER BY pos) AS line
        FROM {CELLS_SQL} WHERE pos < 60 GROUP BY vec_id, pos // 8) GROUP BY 1, 2"""),
    "raster_rebuild": (raster_rebuild, f"""SELECT vec_id, pos // 32 AS chunk_no,
      string_agg(line, ';' ORDER BY pos) AS pixels FROM (
        SELECT vec_id, min(pos) AS pos, string_agg(round(value::DOUBLE * 1000)::INTEGER::VARCHAR, ',' ORDER BY pos) AS line
        FROM {CELLS_SQL} GROUP BY vec_id, pos // 4) GROUP BY 1, 2"""),
    "array_encode": (array_encode, f"""SELECT vec_id, pos, round(value::DOUBLE * 1000)::INTEGER AS data,
      '8x8' AS shape, 'float32' AS dtype FROM {CELLS_SQL}"""),
    "roundtrip_diff": (roundtrip_diff, f"""SELECT CASE WHEN pos >= 60 THEN 'left_only' WHEN pos % 16 = 0 THEN 'changed'
      ELSE 'equal' END AS status, count(*) AS n FROM {CELLS_SQL} GROUP BY 1"""),
}
