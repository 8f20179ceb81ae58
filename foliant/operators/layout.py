"""Layout operators on blocks: grouping, merging, statistics, languages by script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.config import DEFAULT, EngineConfig
from foliant.functions.text import is_title, ordered_join

READING_ORDER = ("page_number", "y", "x", "block_no")


def group_blocks(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Blocks with ``group_no``: gaps and islands over the reading order; groups of one block go.

    A group begins where the font jumps, a line gap opens or a short
    title-case line stands; the page's end alone does not begin one.
    """
    order = Window.partitionBy("doc_id").orderBy(*READING_ORDER)
    last_font, last_bottom = F.lag("font_size").over(order), F.lag(F.col("y") + F.col("height")).over(order)
    gap = F.col("y") - last_bottom
    jump = F.when(last_font != 0, F.col("font_size") / last_font).otherwise(1.0)
    heading_like = (F.length("text") < 60) & is_title("text") & ~F.col("text").endswith(".")
    begins = (
        last_font.isNull()
        | (jump >= config.font_jump)
        | (F.col("font_flags") >= config.heading_weight)
        | (gap > config.line_gap)
        | heading_like
        | (gap > config.block_distance)
    )
    numbered = blocks.withColumn("begins", begins.cast("int")).withColumn("group_no", F.sum("begins").over(order).cast("int"))
    size = F.count("*").over(Window.partitionBy("doc_id", "group_no"))
    return numbered.withColumn("group_size", size).where(F.col("group_size") >= config.min_group_blocks).drop("begins")


def merge_groups(grouped: DataFrame) -> DataFrame:
    """A merged block per group: joined text, bounding box, most common font (the smallest of equals)."""
    first = F.struct(*READING_ORDER)
    return (
        grouped.groupBy("doc_id", "group_no")
        .agg(
            ordered_join(first, F.col("text"), " ").alias("text"),
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            F.max(F.col("x") + F.col("width")).alias("right"),
            F.max(F.col("y") + F.col("height")).alias("bottom"),
            F.mode("font_name", True).alias("font_name"),
            F.mode("font_size", True).alias("font_size"),
            F.mode("font_flags", True).alias("font_flags"),
            F.min_by("page_number", first).alias("page_number"),
            F.count("*").alias("n_blocks"),
        )
        .select(
            "doc_id", "group_no", "text", "x", "y", (F.col("right") - F.col("x")).alias("width"),
            (F.col("bottom") - F.col("y")).alias("height"), "font_name", "font_size", "font_flags", "page_number", "n_blocks",
        )
    )


def font_histogram(blocks: DataFrame) -> DataFrame:
    """(doc_id, font_size, n) by size rounded half to even."""
    return blocks.groupBy("doc_id", F.bround("font_size", 1).alias("font_size")).agg(F.count("*").alias("n"))


def font_analysis(blocks: DataFrame) -> DataFrame:
    """Per document: most common and largest size, number of sizes, maps of sizes and names."""
    sizes = font_histogram(blocks).groupBy("doc_id").agg(
        F.max_by("font_size", F.struct("n", -F.col("font_size"))).alias("most_common_size"),
        F.max("font_size").alias("largest_size"),
        F.count("*").alias("size_variety"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("font_size", "n")))).alias("font_sizes"),
    )
    names = (
        blocks.groupBy("doc_id", "font_name").agg(F.count("*").alias("n"))
        .groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("font_name", "n")))).alias("font_names"))
    )
    return sizes.join(names, "doc_id")


def structure_statistics(blocks: DataFrame) -> DataFrame:
    """Per document: blocks, pages with text, blocks a page, share of pages with text."""
    own = blocks.groupBy("doc_id").agg(
        F.count("*").alias("total_blocks"), F.countDistinct("page_number").alias("pages_with_text"), F.max("page_number").alias("page_count")
    )
    return own.select(
        "doc_id",
        "total_blocks",
        "pages_with_text",
        (F.col("total_blocks") / F.col("pages_with_text")).alias("avg_blocks_per_page"),
        (F.col("pages_with_text") / F.col("page_count")).alias("text_coverage"),
    )


def scanned_documents(blocks: DataFrame, least_per_page: float = 5, most_tiny: float = 0.5, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, is_scanned): few blocks a page, or mostly tiny ones; of ``documents`` those without blocks are scanned too."""
    own = blocks.groupBy("doc_id").agg(
        (F.count("*") / F.max("page_number")).alias("per_page"), F.avg((F.length("text") < 3).cast("int")).alias("tiny")
    )
    found = own.select("doc_id", ((F.col("per_page") < least_per_page) | (F.col("tiny") > most_tiny)).alias("is_scanned"))
    if documents is None:
        return found
    return documents.select("doc_id").distinct().join(found, "doc_id", "left").withColumn("is_scanned", F.coalesce("is_scanned", F.lit(True)))


def script_language(blocks: DataFrame, first: int = 50) -> DataFrame:
    """(doc_id, language) by script of the first blocks of more than five characters: ja, ar, else en."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    head = blocks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first).where(F.length("text") > 5)
    # The first block with a script decides.
    script = F.when(F.col("text").rlike(r"[぀-ヿ一-龯]"), "ja").when(F.col("text").rlike(r"[؀-ۿ]"), "ar")
    return head.withColumn("script", script).groupBy("doc_id").agg(
        F.coalesce(F.min_by("script", F.when(F.col("script").isNotNull(), F.col("rn"))), F.lit("en")).alias("language")
    )


def font_flags_of(font_name: Column) -> Column:
    """Flags from a font's name: 16 for bold, 64 for italic or oblique."""
    low = F.lower(font_name)
    return F.when(low.contains("bold"), 16).otherwise(0).bitwiseOR(F.when(low.rlike("italic|oblique"), 64).otherwise(0))


def character_runs(characters: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Blocks from characters (doc_id, line_no, char_no, text, font_name, x, y, width, height): runs of one font and height."""
    order = Window.partitionBy("doc_id", "line_no").orderBy("char_no")
    font, height = F.lag("font_name").over(order), F.lag("height").over(order)
    begins = font.isNull() | (font != F.col("font_name")) | (F.abs(height - F.col("height")) >= tolerance)
    runs = characters.withColumn("run_no", F.sum(begins.cast("int")).over(order))
    merged = runs.groupBy("doc_id", "line_no", "run_no").agg(
        ordered_join(F.col("char_no"), F.col("text"), "").alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.min_by("font_name", "char_no").alias("font_name"),
        F.min_by("height", "char_no").alias("font_size"),
    )
    return merged.withColumn("font_flags", font_flags_of(F.col("font_name"))).where(F.trim("text") != "")
