"""Catalogue listings, metadata and grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import catalog
from gridlake.plans.inputs import (
    DATASET_FILE_SQL, GRANTS_SQL, ROOT, URI, dataset_file, role_file, role_user, table, user_file,
)

FILES_PER_PAGE = 20


def cat_list_files(spark, sf_dir):
    listed = catalog.list_files(dataset_file(spark, sf_dir), ROOT, URI, FILES_PER_PAGE)
    return listed.select("datasetId", "name", "suffix", "type", "path", "size", "dataframeName", "page")


def cat_file_count(spark, sf_dir):
    return catalog.file_counts(dataset_file(spark, sf_dir), FILES_PER_PAGE)


def _datasets(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select(F.md5("source").alias("id"), F.col("source").alias("name"))


def cat_list_datasets(spark, sf_dir):
    return catalog.list_datasets(_datasets(spark, sf_dir), URI, 10)


def cat_dataset_name(spark, sf_dir):
    """File sizes by dataset name; datasets unknown to the catalogue stay nameless."""
    files = dataset_file(spark, sf_dir).withColumn(
        "datasetId", F.when(F.col("suffix") != "es", F.md5("datasetId")).otherwise(F.lit("unknown"))
    )
    named = catalog.dataset_names(files, _datasets(spark, sf_dir))
    return named.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def cat_user_files(spark, sf_dir):
    files = catalog.user_files(
        dataset_file(spark, sf_dir), user_file(spark, sf_dir), role_user(spark, sf_dir), role_file(spark, sf_dir)
    )
    return files.select("username", "datasetId", "name", "path", "size")


def cat_permission(spark, sf_dir):
    files = dataset_file(spark, sf_dir)
    # every user asks for every dataset of the files granted to users of the same role
    asked = role_file(spark, sf_dir).join(files, "path").select("role", "datasetId").distinct()
    asked = role_user(spark, sf_dir).join(asked, "role")
    direct = user_file(spark, sf_dir).join(files, "path").select("username", "datasetId")
    pairs = asked.select("username", "datasetId").unionByName(direct).distinct()
    swapped = pairs.withColumn("username", F.concat(F.lit("x"), "username"))
    return catalog.permissions(
        pairs.unionByName(swapped), files, user_file(spark, sf_dir), role_user(spark, sf_dir), role_file(spark, sf_dir)
    )


def _records(spark, sf_dir):
    """One JSON metadata record per document: some with a bad date, some with a bad email."""
    i = F.col("doc_id")
    day = F.when(i % 5 == 0, "2024/01/01").otherwise("2024-01-01")
    mail = F.when(i % 4 == 0, "nobody").otherwise(F.concat(F.lit("info.é-"), i.cast("string"), F.lit("@data.example.org")))
    basic = F.struct(
        F.col("source").alias("name"), F.concat("lang", F.lit(";"), "source").alias("keywords"),
        day.alias("dateCreated"),
        F.array(F.struct(
            F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("id"),
            F.when(i % 11 == 0, "ISBN").otherwise("DOI").alias("type"),
        )).alias("identifier"),
    )
    rights = F.struct(F.array(mail).alias("email"))
    shared = F.struct(F.col("n_chars").cast("double").alias("byteSize"))
    record = F.to_json(F.struct(basic.alias("basic"), shared.alias("distribution"), rights.alias("rights")))
    return table(spark, sf_dir, "documents").select("doc_id", record.alias("record"))


def meta_validate(spark, sf_dir):
    parsed = catalog.parse_metadata(_records(spark, sf_dir), "record")
    return parsed.select(
        "doc_id", "accepted", "dateCreated", "name", F.element_at("keywords", 1).alias("first_keyword"),
        F.element_at("email", 1).alias("first_email"),
    )


_LISTABLE = f"""(SELECT * FROM {DATASET_FILE_SQL} WHERE "isFile" OR type = 'dir')"""
_CUT = len(ROOT) + 1

QUERIES = {
    "cat_list_files": (cat_list_files, f"""SELECT "datasetId", name, suffix, type, substr(path, {_CUT}) AS path, size,
      '{URI}' || "datasetId" || substr(path, {_CUT}) AS "dataframeName",
      (row_number() OVER (PARTITION BY "datasetId" ORDER BY path) - 1) // {FILES_PER_PAGE} + 1 AS page FROM {_LISTABLE}"""),
    "cat_file_count": (cat_file_count, f"""SELECT "datasetId", count(*) AS total_count,
      ceil(count(*) / {FILES_PER_PAGE}.0)::BIGINT AS pages FROM {_LISTABLE} GROUP BY 1"""),
    "cat_list_datasets": (cat_list_datasets, f"""SELECT md5(source) AS id, '{URI}' || source AS name,
      (row_number() OVER (ORDER BY source) - 1) // 10 + 1 AS page, count(*) OVER () AS total
      FROM (SELECT DISTINCT source FROM documents)"""),
    "cat_dataset_name": (cat_dataset_name, """SELECT CASE WHEN lang <> 'es' THEN source END AS dataset_name,
      count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1"""),
    "cat_user_files": (cat_user_files, f"""SELECT username, "datasetId", name, f.path, size
      FROM {GRANTS_SQL} g JOIN {_LISTABLE} f ON g.path = f.path"""),
    "cat_permission": (cat_permission, f"""WITH pairs AS (SELECT DISTINCT username, "datasetId"
          FROM {GRANTS_SQL} g JOIN {DATASET_FILE_SQL} f ON g.path = f.path),
        granted AS (SELECT DISTINCT username, "datasetId" FROM {GRANTS_SQL} g JOIN {_LISTABLE} f ON g.path = f.path)
      SELECT p.username, p."datasetId", g.username IS NOT NULL AS allowed
      FROM (SELECT * FROM pairs UNION ALL SELECT 'x' || username, "datasetId" FROM pairs) p
      LEFT JOIN granted g ON p.username = g.username AND p."datasetId" = g."datasetId" """),
    "meta_validate": (meta_validate, """SELECT doc_id,
      doc_id % 5 <> 0 AND doc_id % 4 <> 0 AND doc_id % 11 <> 0 AS accepted,
      CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' END AS "dateCreated", source AS name, lang AS first_keyword,
      CASE WHEN doc_id % 4 = 0 THEN 'nobody' ELSE 'info.é-' || doc_id || '@data.example.org' END AS first_email
      FROM documents"""),
}
