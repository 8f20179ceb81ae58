"""Positioned text blocks from text documents and HTML pages.

A block is (doc_id, source, block_no, page_number, text, x, y, width, height,
font_name, font_size, font_flags); ``block_no`` makes the order explicit.
Both adapters are narrow: one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import stripped

#: Lines on a page, and the geometry of a line.
PAGE_LINES = 8
LINE_STEP = 24
TOP = 72
LEFT = 72.0
LINE_HEIGHT = 12.0
CHARACTER_WIDTH = 6
MAX_WIDTH = 468
HEADING_CHARACTERS = 60

COLUMNS = ("doc_id", "source", "block_no", "page_number", "text", "x", "y", "width", "height", "font_name", "font_size", "font_flags")


def _laid_out(lines: DataFrame, size, flags, name) -> DataFrame:
    n = F.col("block_no")
    return lines.select(
        "doc_id",
        "source",
        "block_no",
        (F.floor(n / PAGE_LINES) + 1).cast("int").alias("page_number"),
        "text",
        F.lit(LEFT).alias("x"),
        ((n % PAGE_LINES) * LINE_STEP + TOP).cast("double").alias("y"),
        F.least(F.length("text") * CHARACTER_WIDTH, F.lit(MAX_WIDTH)).cast("double").alias("width"),
        F.lit(LINE_HEIGHT).alias("height"),
        name.alias("font_name"),
        size.cast("double").alias("font_size"),
        flags.cast("int").alias("font_flags"),
    )


def blocks_from_documents(documents: DataFrame) -> DataFrame:
    """A block per non-blank line; short lines are set like headings."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    lines = lines.where(F.col("line").rlike(r"\S")).select("doc_id", "source", "block_no", stripped("line").alias("text"))
    short = F.length("text") < HEADING_CHARACTERS
    return _laid_out(
        lines, F.when(short, 18).otherwise(11), F.when(short, 20).otherwise(0), F.when(short, F.lit("Head")).otherwise(F.lit("Body"))
    )


def blocks_from_pages(pages: DataFrame) -> DataFrame:
    """A block per h1, p and li element of a page, scripts and styles apart."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    pattern = r"<(h1|p|li)[^>]*>([^<]+)"
    found = pages.select(
        F.col("page_id").alias("doc_id"),
        F.lit("pages").alias("source"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("text")
            )
        ).alias("block_no", "found"),
    )
    lines = found.select("doc_id", "source", "block_no", F.col("found.tag").alias("tag"), stripped("found.text").alias("text")).where("text <> ''")
    tag = F.col("tag")
    size = F.when(tag == "h1", 24).when(tag == "p", 12).otherwise(10)
    return _laid_out(lines.select("doc_id", "source", "block_no", "text", "tag"), size, F.when(tag == "h1", 20).otherwise(0), tag)
