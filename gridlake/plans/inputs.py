"""Input tables and the tables derived from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.frame import Frame
from gridlake.functions.text import ratio
from gridlake.sources.tables import read_parquet

ROOT = "/storage/dataset"
URI = "data://store.example.org:3101/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


# -- events with gaps ----------------------------------------------------------
def with_gaps(df: DataFrame) -> DataFrame:
    """``value`` null or NaN, ``note`` null and ``flag`` null on fixed events."""
    i = F.col("event_id")
    gap = F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return df.withColumns({
        "value": gap,
        "note": F.when(i % 8 != 0, F.col("event_type")),
        "flag": F.when(i % 7 != 0, i % 3 == 0),
    })


GAPS_SQL = """(SELECT event_id, ts, user_id, event_type, props,
    CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'NaN'::DOUBLE ELSE value END AS value,
    CASE WHEN event_id % 8 <> 0 THEN event_type END AS note,
    CASE WHEN event_id % 7 <> 0 THEN event_id % 3 = 0 END AS flag
  FROM events)"""


def gap_frame(spark, sf_dir) -> Frame:
    events = frame(spark, sf_dir, "events")
    return Frame(with_gaps(events.df), dense=True)


# -- catalogue -------------------------------------------------------------------
def dataset_file(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("datasetId"),
        name.alias("name"),
        F.col("lang").alias("suffix"),
        F.concat(F.lit(ROOT + "/"), F.col("source"), F.lit("/"), name).alias("path"),
        F.when(F.col("doc_id") % 50 == 0, "dir").otherwise("no").alias("type"),
        (F.col("doc_id") % 7 != 0).alias("isFile"),
        F.col("n_chars").alias("size"),
    )


_PATH_SQL = f"'{ROOT}/' || source || '/doc_' || doc_id || '.' || lang"

DATASET_FILE_SQL = f"""(SELECT source AS "datasetId", 'doc_' || doc_id || '.' || lang AS name,
    lang AS suffix, {_PATH_SQL} AS path,
    CASE WHEN doc_id % 50 = 0 THEN 'dir' ELSE 'no' END AS type,
    (doc_id % 7 <> 0) AS "isFile", n_chars AS size
  FROM documents)"""


def _labelled_paths(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(ROOT + "/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), "lang")
        .alias("path"),
    )
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def user_file(spark, sf_dir) -> DataFrame:
    """Direct grants: each good document to one of eleven users."""
    return _labelled_paths(spark, sf_dir).where("quality = 1").select(
        F.concat(F.lit("u"), (F.col("doc_id") % 11).cast("string")).alias("username"), "path"
    )


def role_user(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "labels").select((F.col("doc_id") % 11).alias("k")).distinct()
    return users.select(
        F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("role"),
        F.concat(F.lit("u"), F.col("k").cast("string")).alias("username"),
    )


def role_file(spark, sf_dir) -> DataFrame:
    """Role grants: each harmless document to one of three roles."""
    return _labelled_paths(spark, sf_dir).where("toxic = 0").select(
        F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("role"), "path"
    )


_LABELLED_SQL = f"(SELECT doc_id, quality, toxic, {_PATH_SQL} AS path FROM labels l JOIN documents USING (doc_id))"
USER_FILE_SQL = f"(SELECT 'u' || (doc_id % 11) AS username, path FROM {_LABELLED_SQL} WHERE quality = 1)"
ROLE_USER_SQL = "(SELECT DISTINCT 'r' || ((doc_id % 11) % 3) AS role, 'u' || (doc_id % 11) AS username FROM labels)"
ROLE_FILE_SQL = f"(SELECT 'r' || (doc_id % 3) AS role, path FROM {_LABELLED_SQL} WHERE toxic = 0)"
GRANTS_SQL = f"""(SELECT username, path FROM {USER_FILE_SQL}
  UNION SELECT ru.username, rf.path FROM {ROLE_USER_SQL} ru JOIN {ROLE_FILE_SQL} rf ON ru.role = rf.role)"""


# -- cells -----------------------------------------------------------------------
def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "value")
    )


# list_position-free: unnest both a range and the list of one row, in step
CELLS_SQL = """(SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value
  FROM embeddings)"""


# -- benchmark runs --------------------------------------------------------------
def bench_runs(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("dataset_name"),
        F.col("l_linestatus").alias("protocol"),
        F.col("l_tax").alias("connect_time"),
        F.col("l_quantity").alias("total_time"),
        F.col("l_extendedprice").alias("throughput_mbps"),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("rows_per_sec"),
        F.col("l_discount").alias("memory_change_mb"),
        F.col("l_linenumber").cast("double").alias("file_size_mb"),
    )


BENCH_RUNS_SQL = """(SELECT l_returnflag AS dataset_name, l_linestatus AS protocol, l_tax AS connect_time,
    l_quantity AS total_time, l_extendedprice AS throughput_mbps,
    l_extendedprice / l_quantity AS rows_per_sec, l_discount AS memory_change_mb,
    l_linenumber::DOUBLE AS file_size_mb FROM lineitem)"""
