"""Catalogue of datasets, files and grants as joins over tables.

``dataset_file``: datasetId, name, path, size, suffix, type, isFile (and time).
``user_file``: username, path.  ``role_user``: role, username.  ``role_file``: role, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions import text
from gridlake.operators.rowindex import ROW, sort_index
from gridlake.operators.windows import row_numbers
from gridlake.sources.files import relative_to

FILES_PER_PAGE = 50_000
DATASETS_PER_PAGE = 10


def listable(df: DataFrame) -> DataFrame:
    """Entries a listing shows: files and folders, nothing else."""
    return df.where((F.col("isFile") == F.lit(True)) | (F.col("type") == "dir"))


def with_uri(files: DataFrame, root: str, dataset_uri: Column) -> DataFrame:
    """Paths relative to the storage root, and the URI that opens each file."""
    moved = files.withColumn("path", relative_to(F.col("path"), root))
    return moved.withColumn("dataframeName", F.concat(dataset_uri, F.col("path")))


def list_files(dataset_file, root: str, uri_prefix: str, limit: int = FILES_PER_PAGE) -> DataFrame:
    """All datasets' listable files with the page of the dataset listing they are on.

    Pages follow the path order.
    """
    files = with_uri(listable(dataset_file), root, F.concat(F.lit(uri_prefix), F.col("datasetId")))
    numbered = row_numbers(files, ["datasetId"], ["path"], "_at")
    return numbered.withColumn("page", F.floor((F.col("_at") - 1) / limit) + 1).drop("_at")


def file_counts(dataset_file: DataFrame, limit: int = FILES_PER_PAGE) -> DataFrame:
    """Listable files and listing pages of each dataset."""
    counted = listable(dataset_file).groupBy("datasetId").agg(F.count(F.lit(1)).alias("total_count"))
    return counted.withColumn("pages", F.ceil(F.col("total_count") / limit))


def list_datasets(datasets: DataFrame, uri_prefix: str, limit: int = DATASETS_PER_PAGE) -> DataFrame:
    """Dataset names as URIs with their page and the total number of datasets."""
    numbered = sort_index(datasets.select("id", "name"), [F.col("name"), F.col("id")])
    return numbered.select(
        "id", F.concat(F.lit(uri_prefix), F.col("name")).alias("name"),
        (F.floor(F.col(ROW) / limit) + 1).alias("page"),
        datasets.agg(F.count(F.lit(1)).alias("count")).scalar().alias("total"),
    )


def user_files(dataset_file, user_file, role_user, role_file) -> DataFrame:
    """Distinct (username, file) pairs granted directly or through a role.

    Grants are reduced to distinct paths before the wide file rows are joined in.
    """
    direct = user_file.select("username", "path")
    by_role = role_user.join(role_file, "role").select("username", "path")
    grants = direct.unionByName(by_role).distinct()
    return grants.join(listable(dataset_file), "path")


def permissions(pairs, dataset_file, user_file, role_user, role_file) -> DataFrame:
    """``(username, datasetId)`` pairs with whether the user may read any of its files."""
    # grants shrink to datasets before users come in, so no (user, file) pair is made
    files = listable(dataset_file.select("datasetId", "path", "type", "isFile")).select("path", "datasetId")
    direct = user_file.join(files, "path").select("username", "datasetId")
    by_role = role_file.join(files, "path").select("role", "datasetId").distinct()
    by_role = role_user.join(by_role, "role").select("username", "datasetId")
    granted = direct.unionByName(by_role).distinct().withColumn("_hit", F.lit(True))
    joined = pairs.join(granted, ["username", "datasetId"], "left")
    return joined.withColumn("allowed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def dataset_names(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """Files with the name of their dataset; unknown datasets give null."""
    names = datasets.select(F.col("id").alias("datasetId"), F.col("name").alias("dataset_name"))
    return files.join(names, "datasetId", "left")


_IDENTIFIER = T.StructType().add("id", "string").add("type", "string")
_ACCESS = T.StructType().add("type", "string").add("openDate", "string").add("condition", "string")
_TEXTS = T.ArrayType(T.StringType())

METADATA_SCHEMA = (
    T.StructType()
    .add("basic", T.StructType()
         .add("name", "string").add("identifier", T.ArrayType(_IDENTIFIER)).add("description", "string")
         .add("keywords", "string").add("url", "string").add("dateCreated", "string")
         .add("subject", _TEXTS).add("format", _TEXTS).add("image", "string"))
    .add("distribution", T.StructType()
         .add("accessRights", _ACCESS).add("license", "string").add("byteSize", "double")
         .add("fileNumber", "long").add("downloadURL", "string"))
    .add("rights", T.StructType()
         .add("creator", _TEXTS).add("publisher", "string").add("contactPoint", _TEXTS)
         .add("email", _TEXTS).add("copyrightHolder", _TEXTS).add("references", _TEXTS))
)


def parse_metadata(records: DataFrame, column: str) -> DataFrame:
    """JSON metadata records as typed columns plus ``accepted``.

    A record is rejected when one of its three parts is missing, its date is not an ISO
    date, an email, URL or identifier is malformed, or the access rights have no type.
    """
    parsed = records.withColumn("meta", F.from_json(column, METADATA_SCHEMA))
    basic, rights, shared = (F.col(f"meta.{p}") for p in ("basic", "rights", "distribution"))

    def each(items: Column, test) -> Column:
        return items.isNull() | F.forall(items, lambda x: F.coalesce(test(x), F.lit(False)))

    def optional_url(item: Column) -> Column:
        return item.isNull() | text.valid_url(item)

    created = text.iso_date(basic["dateCreated"])
    accepted = (
        basic.isNotNull() & rights.isNotNull() & shared.isNotNull()
        & (basic["dateCreated"].isNull() | created.isNotNull())
        & each(rights["email"], text.valid_email)
        & each(rights["references"], text.valid_url)
        & each(basic["identifier"], lambda i: text.valid_identifier(i["type"]) & text.valid_url(i["id"]))
        & optional_url(basic["url"]) & optional_url(basic["image"]) & optional_url(shared["downloadURL"])
        & (shared["accessRights"].isNull() | shared["accessRights"]["type"].isNotNull())
    )
    return parsed.select(
        *records.columns,
        basic["name"].alias("name"),
        text.keywords(basic["keywords"]).alias("keywords"),
        created.alias("dateCreated"),
        rights["email"].alias("email"),
        "meta",
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )
