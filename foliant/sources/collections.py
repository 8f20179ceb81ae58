"""Collections as input: JSON scans, discovery, binding of files.

A collection is one row: (collection, challenge_info, documents, persona,
job_to_be_done, errors).  A broken or incomplete input is a row with errors, not
the end of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT_SCHEMA = (
    "challenge_info struct<challenge_id:string,test_case_name:string,description:string>, "
    "documents array<struct<filename:string,title:string>>, "
    "persona struct<role:string,persona:string,description:string,language:string>, "
    "job_to_be_done struct<task:string,job:string,description:string,language:string>"
)
REQUIRED = ("challenge_info", "documents", "persona", "job_to_be_done")
#: A collection's input file, by the end of its name.
INPUT_NAME = "*input.json"


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections under ``path`` (a file, a folder or a glob), named by their folder."""
    rows = (
        spark.read.schema(f"{INPUT_SCHEMA}, _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing key: {c}")) for c in REQUIRED]))
    errors = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("not valid JSON"))).otherwise(missing)
    name = F.url_decode(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1))
    return rows.select(name.alias("collection"), *REQUIRED, errors.alias("errors"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Collections in child folders of ``folder`` whose name begins with ``collection``."""
    found = read_collections(spark, f"{folder}/*/{INPUT_NAME}")
    return found.where(F.lower("collection").startswith("collection"))


def persona_text():
    return F.coalesce(F.nullif(F.col("persona.role"), F.lit("")), F.col("persona.persona"), F.lit(""))


def job_text():
    return F.coalesce(F.nullif(F.col("job_to_be_done.task"), F.lit("")), F.col("job_to_be_done.job"), F.lit(""))


def wanted_files(collections: DataFrame) -> DataFrame:
    """(collection, doc_ord, filename, title)."""
    return collections.select("collection", F.posexplode("documents").alias("doc_ord", "d")).select("collection", "doc_ord", "d.filename", "d.title")


def bound_files(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found with path, missing); a file in the collection's ``PDFs`` folder goes before one beside it."""
    own = files.select(
        "path",
        F.url_decode(F.regexp_extract("path", r"([^/]+)/(?:PDFs/)?[^/]+$", 1)).alias("collection"),
        F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("filename"),
        F.col("path").contains("/PDFs/").alias("in_folder"),
    )
    best = own.groupBy("collection", "filename").agg(F.max_by("path", "in_folder").alias("path"))
    return wanted.join(best, ["collection", "filename"]), wanted.join(best, ["collection", "filename"], "left_anti")


def first_documents(collections: DataFrame, n: int = 3) -> DataFrame:
    return collections.withColumn("documents", F.slice("documents", 1, n))
