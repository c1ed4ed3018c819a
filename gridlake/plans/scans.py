"""Scans, sinks, previews and transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.operators import profile
from gridlake.operators.rowindex import ROW
from gridlake.plans.inputs import DATASET_FILE_SQL, GAPS_SQL, dataset_file, frame, gap_frame, table
from gridlake.session import staging_path
from gridlake.sources import blobs, cache, files, netcdf, tables, tiff
from gridlake.streaming import chunks

EVENT_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _csv(spark, sf_dir) -> Frame:
    path = staging_path(spark, "events") + ".csv"
    gap_frame(spark, sf_dir).select("event_id", "ts", "user_id", "note", "value", "props").write(path)
    ddl = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, note STRING, value DOUBLE, props STRING"
    return tables.read_csv(spark, path, ddl)


CSV_SQL = f"""SELECT event_id, ts, user_id, coalesce(note, '') AS note,
  CASE WHEN isnan(value) THEN NULL ELSE value END AS value, props, event_id AS row_no FROM {GAPS_SQL}"""


def scan_csv(spark, sf_dir):
    return _csv(spark, sf_dir).df.withColumnRenamed(ROW, "row_no")


def sample_csv(spark, sf_dir):
    return _csv(spark, sf_dir).limit(10).df.withColumnRenamed(ROW, "row_no")


def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _event_copy(spark, sf_dir, suffix: str) -> tuple[Frame, str]:
    path = staging_path(spark, "events") + suffix
    source = frame(spark, sf_dir, "events")
    source.write(path)
    return source, path


def _same(source: Frame, copy):
    columns = [c for c in source.column_names if c != "event_id"]
    return profile.roundtrip_diff(source.data, copy, ["event_id"], columns)


def scan_json(spark, sf_dir):
    _, path = _event_copy(spark, sf_dir, ".json")
    return tables.read_json(spark, path, EVENT_DDL).df.withColumnRenamed(ROW, "row_no")


def roundtrip_json(spark, sf_dir):
    source, path = _event_copy(spark, sf_dir, ".json")
    return _same(source, tables.read_json(spark, path, EVENT_DDL).data)


def roundtrip_csv(spark, sf_dir):
    source, path = _event_copy(spark, sf_dir, ".csv")
    return _same(source, tables.read_csv(spark, path, EVENT_DDL).data)


def roundtrip_parquet(spark, sf_dir):
    source, path = _event_copy(spark, sf_dir, ".parquet")
    return _same(source, tables.read_parquet(spark, path).data)


def roundtrip_arrow(spark, sf_dir):
    source, path = _event_copy(spark, sf_dir, ".arrow")
    return _same(source, tables.read_arrow(spark, path).data)


ROUNDTRIP_SQL = "SELECT 'equal' AS status, count(*) AS n FROM events"


def dir_frame(spark, sf_dir):
    return files.directory_frame(dataset_file(spark, sf_dir))


def dir_sample(spark, sf_dir):
    return files.directory_samples(dataset_file(spark, sf_dir), "datasetId")


def _document_folder(spark, sf_dir) -> str:
    """Document texts as files, one folder per source."""
    folder = staging_path(spark, "documents")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(folder)
    return folder


def folder_listing(spark, sf_dir):
    listed = files.folder_listing(spark, _document_folder(spark, sf_dir))
    return listed.groupBy(F.regexp_replace("dataset", "^source=", "").alias("dataset")).agg(
        F.sum("length").alias("n_bytes")
    )


def blob_load(spark, sf_dir):
    entries = files.directory_from_disk(spark, _document_folder(spark, sf_dir))
    loaded = blobs.load_blobs(entries)
    dataset = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return loaded.groupBy(dataset.alias("dataset")).agg(F.sum(F.octet_length("blob")).alias("n_bytes"))


def blob_chunks(spark, sf_dir):
    entries = files.directory_from_disk(spark, _document_folder(spark, sf_dir))
    parts = blobs.load_chunks(entries, chunk_bytes=64 * 1024)
    dataset = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return parts.groupBy(dataset.alias("dataset")).agg(F.sum(F.octet_length("bytes")).alias("n_bytes"))


# every text line ends with one newline byte
DOCUMENT_BYTES_SQL = """SELECT source AS dataset, (sum(octet_length(encode(text))) + count(*))::BIGINT AS n_bytes
  FROM documents GROUP BY source"""


def blob_chunk_plan(spark, sf_dir):
    plan = chunks.chunk_plan(dataset_file(spark, sf_dir).select("path", "size"), chunk_bytes=1000)
    return plan.select("path", "chunk_no", "chunk_offset", "chunk_length")


def sample_summary(spark, sf_dir):
    summary = profile.sample_summary(frame(spark, sf_dir, "part"))
    return summary.select("column", "type", F.array_join("values", "|").alias("values"), "total_count")


def _summary_sql() -> str:
    kinds = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
             "p_size": "int", "p_retailprice": "double"}
    parts = [
        f"""SELECT '{c}' AS "column", '{k}' AS type,
  (SELECT string_agg({c}::VARCHAR, '|' ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)) AS "values",
  (SELECT count(*) FROM part) AS total_count"""
        for c, k in kinds.items()
    ]
    return " UNION ALL ".join(parts)


def materialize(spark, sf_dir):
    path = staging_path(spark, "events") + ".csv"
    frame(spark, sf_dir, "events").write(path)

    def read(session, source):
        return tables.read_csv(session, source, EVENT_DDL).data

    cache.materialize(spark, path, read)
    again = cache.materialize(spark, path, read)
    return again.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


def chunk_sizes(spark, sf_dir):
    return chunks.chunk_sizes(frame(spark, sf_dir, "events").filter("value > 10"))


def chunk_rows(spark, sf_dir):
    """Which chunk of the transfer each remaining row travels in."""
    filtered = frame(spark, sf_dir, "events").filter("value > 10").select("event_id")
    return chunks.with_chunk(filtered).select("event_id", "chunk")


def preview_rows(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    shown = profile.shown_columns(events.column_names, 2, 2)
    rows = profile.preview_rows(events)
    return rows.select(F.col(ROW).alias("row_no"), *shown, F.col("_total").alias("total_rows"),
                       F.lit(events.num_cols).cast("bigint").alias("total_cols"))


def collect_chain(spark, sf_dir):
    first = frame(spark, sf_dir, "events").filter("value > 50").collect()
    return first.select("event_id", "value").sort("value", "descending").limit(100).data


def scan_netcdf(spark, sf_dir):
    """Embeddings written as gridded files, scanned back into cells."""
    folder = staging_path(spark, "grids")
    source = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    netcdf.write_records(source, folder, shapes={"embedding": (8, 8)})
    cells = netcdf.read_cells(spark, folder)
    # the record number of a file joins its vec_id to its grid
    data = cells.where("var = 'embedding'").withColumn("record", F.expr("pos div 64"))
    ids = cells.where("var = 'vec_id'").select("file", F.col("pos").alias("record"), F.col("value").alias("id"))
    return data.join(ids, ["file", "record"]).select(
        F.col("id").cast("bigint").alias("vec_id"), (F.col("pos") % 64).alias("pos"),
        F.round("value", 6).alias("value"),
    )


def scan_tiff(spark, sf_dir):
    """Embeddings written as 8 x 8 raster pages, scanned back into cells."""
    folder = staging_path(spark, "rasters")
    tiff.write_pages(table(spark, sf_dir, "embeddings").select("embedding"), folder, 8, 8)
    cells = tiff.read_cells(spark, folder)
    pages = cells.groupBy("file", "page").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(F.col("value") * (F.col("pos") + 1)), 3).alias("moment")
    )
    return pages.groupBy("moment", "n_cells").agg(F.count(F.lit(1)).alias("n_pages"))


CELL_SQL = """SELECT vec_id, unnest(range(len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 6) AS value
  FROM embeddings"""

QUERIES = {
    "scan_csv": (scan_csv, CSV_SQL),
    "sample_csv": (sample_csv, CSV_SQL + " ORDER BY event_id LIMIT 10"),
    "count_rows": (count_rows, "SELECT count(*) AS n FROM lineitem"),
    "scan_parquet": (scan_parquet, "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"),
    "scan_json": (scan_json, "SELECT event_id, ts, user_id, event_type, value, props, event_id AS row_no FROM events"),
    "roundtrip_csv": (roundtrip_csv, ROUNDTRIP_SQL),
    "roundtrip_json": (roundtrip_json, ROUNDTRIP_SQL),
    "roundtrip_parquet": (roundtrip_parquet, ROUNDTRIP_SQL),
    "roundtrip_arrow": (roundtrip_arrow, ROUNDTRIP_SQL),
    "dir_frame": (dir_frame, f"""SELECT name, path, suffix, type, size, NULL::VARCHAR AS time, NULL::BLOB AS blob
      FROM {DATASET_FILE_SQL} WHERE type <> 'dir'"""),
    "dir_sample": (dir_sample, f"""SELECT name, path, suffix, type, size, "datasetId" FROM (
      SELECT *, row_number() OVER (PARTITION BY "datasetId" ORDER BY path) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY "datasetId" ORDER BY path) AS rn FROM {DATASET_FILE_SQL})
      WHERE rn <= 11 AND type <> 'dir') WHERE k <= 10"""),
    "folder_listing": (folder_listing, DOCUMENT_BYTES_SQL),
    "blob_load": (blob_load, DOCUMENT_BYTES_SQL),
    "blob_chunks": (blob_chunks, DOCUMENT_BYTES_SQL),
    "blob_chunk_plan": (blob_chunk_plan, f"""SELECT path, k AS chunk_no, k * 1000 AS chunk_offset,
      least(1000, size - k * 1000) AS chunk_length
      FROM (SELECT path, size, unnest(range((size + 999) // 1000)) AS k FROM {DATASET_FILE_SQL})"""),
    "sample_summary": (sample_summary, _summary_sql()),
    "materialize": (materialize, """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total
      FROM events GROUP BY event_type"""),
    "chunk_rows": (chunk_rows, """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS chunk
      FROM events WHERE value > 10"""),
    "chunk_sizes": (chunk_sizes, """SELECT rn // 1000 AS chunk, count(*) AS n_rows FROM (
      SELECT row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events WHERE value > 10) GROUP BY 1"""),
    "preview_rows": (preview_rows, """SELECT rn AS row_no, event_id, ts, value, props, n AS total_rows,
      6::BIGINT AS total_cols FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn,
      count(*) OVER () AS n FROM events) WHERE rn < 5 OR rn >= n - 5"""),
    "collect_chain": (collect_chain, """SELECT event_id, value FROM events WHERE value > 50
      ORDER BY value DESC, event_id LIMIT 100"""),
    "scan_netcdf": (scan_netcdf, CELL_SQL),
    "scan_tiff": (scan_tiff, """SELECT moment, n_cells, count(*) AS n_pages FROM (
      SELECT vec_id, count(*) AS n_cells, round(sum(value::DOUBLE * (pos + 1)), 3) AS moment FROM (
        SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value FROM embeddings)
      GROUP BY vec_id) GROUP BY moment, n_cells"""),
}
