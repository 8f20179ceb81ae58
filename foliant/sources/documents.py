"""Files and parsed documents: reads, predicates, envelopes, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import ordered_join


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files; unreadable ones are skipped."""
    return spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def is_file_of_type(path: Column, kind: str) -> Column:
    return F.lower(path).endswith(f".{kind.lower()}")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def envelope(blocks: DataFrame) -> DataFrame:
    """(doc_id, text_content, content_length, has_text, page_count) of each document, and ``parser_used`` where the blocks tell it."""
    used = [F.first("parser_used").alias("parser_used")] if "parser_used" in blocks.columns else []
    own = blocks.groupBy("doc_id").agg(
        ordered_join(F.col("block_no"), F.col("text"), "\n").alias("text_content"), F.max("page_number").alias("page_count"), *used
    )
    return own.select(
        "doc_id", "text_content", F.length("text_content").alias("content_length"), (F.trim("text_content") != "").alias("has_text"), "page_count",
        *(["parser_used"] if used else []),
    )


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, text)."""
    return blocks.groupBy("doc_id", "page_number").agg(ordered_join(F.col("block_no"), F.col("text"), "\n").alias("text"))


def validated(blocks: DataFrame) -> DataFrame:
    """(doc_id, is_valid): has readable text."""
    return blocks.groupBy("doc_id").agg((F.max(F.length(F.trim("text"))) > 0).alias("is_valid"))


def pdf_date(value: Column) -> Column:
    """``D:YYYYMMDD...`` as YYYY-MM-DD by position; null if too short."""
    bare = F.regexp_replace(value, "^D:", "")
    return F.when(F.length(bare) >= 8, F.concat_ws("-", F.substring(bare, 1, 4), F.substring(bare, 5, 2), F.substring(bare, 7, 2)))


def clean_field(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def title_or_name(title: Column, filename: Column) -> Column:
    """The title, else the file's name in words."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.coalesce(clean_field(title), F.initcap(F.translate(stem, "_-", "  ")))
