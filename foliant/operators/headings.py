"""Heading detection on blocks: filters, three detectors, deduplication, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import count_of, is_title, is_upper, stripped, word_count

# Patterns that no heading has. Their ``.``, ``\s`` and anchors mean one line.
NO_HEADING = (
    r"^i\s+(declare|certify|undertake|hereby|confirm|acknowledge)",
    r"^this\s+is\s+to\s+certify",
    r"^the\s+undersigned",
    r"signature\s+of\s+(applicant|government|officer)",
    r"copyright\s*©?\s*\d{4}",
    r"all\s+rights\s+reserved",
    r"©|®|™",
    r"^version\s+\d+",
    r"^v\d+\.\d+",
    r"last\s+updated|created\s+on|revision\s+\d+",
    r"\.{3,}",
    r"^\s*\d+\s*$",
    r"\s+\d+\s*$",
    r"^page\s+\d+",
    r"^\d+\s+of\s+\d+$",
    r"^(confidential|internal|draft|preliminary)$",
    r"https?://",
    r"www\.",
    r"@[a-zA-Z0-9.-]+\.",
    r"[a-zA-Z]:\\",
    r"^.{150,}$",
    r"^(the|this|these|those|a|an)\s+\w+",
    r"^(in|on|at|for|with|by|from|to)\s+\w+",
    r"^(please|kindly|note|ensure)",
    r"^(by|author|written\s+by)",
    r"^[a-zA-Z]+\s+[a-zA-Z]+\s*,",
)
NUMBERED = (
    r"^\d+\.\s*[a-zA-Z]",
    r"^\d+\.\d+\s*[a-zA-Z]",
    r"^\d+\.\d+\.\d+\s*[a-zA-Z]",
    r"^[IVX]+\.\s*[a-zA-Z]",
    r"^[A-Z]\.\s*[a-zA-Z]",
)
NAMED = (
    r"^(chapter|section|part|appendix)\s+\d+",
    r"^(introduction|overview|summary|conclusion)$",
    r"^(background|methodology|results|discussion)$",
    r"^(abstract|references|bibliography|acknowledgments)$",
    r"^(name|address|date|phone|email|designation)$",
    r"^(department|office|ministry|directorate)$",
)
STRUCTURE_WORDS = ("chapter", "section", "part", "introduction", "overview")
STRICT_NO_HEADING = (
    r"^i\s+(declare|certify|undertake|hereby|confirm)",
    r"^the\s+undersigned\s+declares?",
    r"^this\s+is\s+to\s+certify",
    r"copyright\s+©?\s*\d{4}",
    r"all\s+rights\s+reserved",
    r"®|™|©",
    r"terms\s+and\s+conditions",
    r"privacy\s+policy",
    r"^version\s+\d+\.\d+",
    r"^v\d+\.\d+",
    r"^revision\s+\d+",
    r"^draft\s+\d+",
    r"last\s+updated",
    r"created\s+on",
    r"^page\s+\d+",
    r"^\d+\s+of\s+\d+$",
    r"^(confidential|internal|draft)$",
    r"\.{3,}",
    r"\s+\d+$",
    r"https?://",
    r"www\.",
    r"@[a-zA-Z0-9.-]+\.",
    r"[a-zA-Z]:\\",
    r"/[a-zA-Z0-9_.-]+/",
    r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}",
    r"^(the|this|these|those|a|an)\s+",
    r"^(in|on|at|for|with|by|from|to)\s+",
    r"^(please|kindly|note)",
    r"^.{150,}$",
)
STRICT_HEADING = (
    r"^\d+\.\s*[a-zA-Z]",
    r"^[a-zA-Z]\.\s*[a-zA-Z]",
    r"^[ivx]+\.\s*[a-zA-Z]",
    r"^(section|chapter|part|appendix)\s+\d+",
    r"^(introduction|overview|summary|conclusion)",
    r"^(background|methodology|results|discussion)",
    r"^(name|address|date|phone|email)",
    r"^(designation|department|office)",
    r"(required|mandatory|optional)$",
)
SECTION_WORDS = ("section", "chapter", "part", "item", "point", "step")
CONTENT_PHRASES = ("i declare", "i certify", "the undersigned", "signature of")


def any_of(patterns, flags: str = "(?i)") -> str:
    """One expression for all patterns: a single pass over the text."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def may_be_heading(text: Column) -> Column:
    own = stripped(text)
    return F.length(own).between(2, 150) & ~own.rlike(any_of(NO_HEADING))


def valid_candidate(text: Column) -> Column:
    own = stripped(text)
    size = F.length(own)
    alnum = F.length(F.regexp_replace(own, r"[^\p{L}\p{N}]", ""))
    special = size - F.length(F.regexp_replace(own, r"[^\p{L}\p{N} .\-]", ""))
    return (
        ~((size > 3) & (alnum < size * 0.3))
        & ((size >= 3) | F.lower(own).rlike("name|date|page"))
        & ~((count_of(own, " ") > 10) & own.endswith("."))
        & (special <= size * 0.6)
    )


def looks_like_content(text: Column) -> Column:
    return (word_count(text) > 8) | F.lower(text).rlike("|".join(CONTENT_PHRASES))


def final_heading(text: Column) -> Column:
    own = stripped(text)
    return ((F.length(own) > 2) | own.rlike(r"^\p{L}+$")) & ~looks_like_content(own)


def page_geometry(blocks: DataFrame) -> DataFrame:
    """Blocks with is_left, is_centered, unusual_spacing: windows over the page."""
    page = Window.partitionBy("doc_id", "page_number")
    low, high = F.min("x").over(page), F.max("x").over(page)
    order = page.orderBy(F.desc("y"), "block_no")
    above, below = F.lag("y").over(order), F.lead("y").over(order)
    tolerance = F.col("tolerance")
    spread = high - low
    return blocks.select(
        "*",
        (F.abs(F.col("x") - low) < 10).alias("is_left"),
        ((spread > 100) & (F.abs(F.col("x") - (low + high) / 2) < spread * 0.3)).alias("is_centered"),
        F.coalesce((above - F.col("y") > tolerance) | (F.col("y") - below > tolerance), F.lit(False)).alias("unusual_spacing"),
    )


def _thresholds() -> list[Column]:
    """Title font, ladder of heading fonts and spatial tolerance from ``first_page`` and ``ladder``."""
    title = F.coalesce("first_page", F.element_at("ladder", 1)) * 0.85
    step = lambda n: F.coalesce(F.try_element_at("ladder", F.lit(n)), F.lit(10.0))
    return [title.alias("title_font"), step(1).alias("h1_font"), step(2).alias("h2_font"), step(3).alias("h3_font"), (title * 2).alias("tolerance")]


def adaptive_thresholds(blocks: DataFrame) -> DataFrame:
    """Per document: title font, ladder of heading fonts, spatial tolerance (this engine's own definition)."""
    sizes = blocks.groupBy("doc_id").agg(
        F.max(F.when(F.col("page_number") == 1, F.col("font_size"))).alias("first_page"),
        F.reverse(F.array_sort(F.collect_set("font_size"))).alias("ladder"),
    )
    return sizes.select("doc_id", *_thresholds())


def font_statistics(blocks: DataFrame) -> DataFrame:
    """Per document: mean, extremes and quantiles of font size by index, without interpolation."""
    listed = blocks.groupBy("doc_id").agg(F.avg("font_size").alias("mean"), F.array_sort(F.collect_list("font_size")).alias("s"))
    at = lambda q: F.element_at("s", (F.floor(F.size("s") * q) + 1).cast("int"))
    return listed.select(
        "doc_id", "mean", at(0.5).alias("median"), F.element_at("s", -1).alias("max"), F.element_at("s", 1).alias("min"), at(0.75).alias("q75"), at(0.25).alias("q25")
    )


def aligned_neighbours(blocks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, block_no, n_aligned): blocks of the page whose left edge is closer than the tolerance.

    Edges are put into bins of the tolerance; the join meets only bins that
    can be close, and counts of equal edges stand for the blocks.
    """
    edges = blocks.groupBy("doc_id", "page_number", "x").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("x") / tolerance))
    other = edges.select("doc_id", "page_number", F.col("x").alias("x2"), F.col("n").alias("n2"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = edges.join(other, ["doc_id", "page_number", "bin"]).where(F.abs(F.col("x") - F.col("x2")) < tolerance)
    sums = near.groupBy("doc_id", "page_number", "x").agg(F.sum("n2").alias("n_aligned"))
    return blocks.join(sums, ["doc_id", "page_number", "x"]).select("doc_id", "block_no", "n_aligned")


def isolated_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, n_near, is_isolated): at most one block of the page (itself) within 1.5 font sizes."""
    page = blocks.groupBy("doc_id", "page_number").agg(F.collect_list("y").alias("ys"))
    near = F.size(F.filter("ys", lambda y: F.abs(y - F.col("y")) < F.col("font_size") * 1.5))
    return (
        blocks.join(page, ["doc_id", "page_number"])
        .select("doc_id", "block_no", near.alias("n_near"))
        .withColumn("is_isolated", F.col("n_near") <= 1)
    )


def measured_blocks(blocks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Blocks with all that the detectors look at: thresholds, geometry, isolation and alignment.

    Everything is a window inside the document, so blocks are shuffled once.
    ``n_aligned`` counts the blocks of the page whose left edge is closer than
    the tolerance; a block is isolated if both neighbours by height are at least
    one and a half font sizes away.
    """
    document, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_number")
    size = F.col("font_size")
    ladder = F.reverse(F.array_sort(F.collect_set(size).over(document)))
    first_page = F.max(F.when(F.col("page_number") == 1, size)).over(document)
    rows = blocks.withColumn("ladder", ladder).withColumn("first_page", first_page)
    rows = rows.select("*", *_thresholds()).drop("ladder", "first_page")
    by_height = page.orderBy("y", "block_no")
    gap = lambda other: F.coalesce(F.abs(F.col("y") - other) >= size * 1.5, F.lit(True))
    # Frames of fractional width exist in SQL text only; a negative bound lies before the row.
    bound = lambda n: f"{abs(n)}D {'preceding' if n < 0 else 'following'}"
    at = lambda low, high: F.expr(f"count(*) over (partition by doc_id, page_number order by x range between {bound(low)} and {bound(high)})")
    rows = page_geometry(rows).withColumn("is_isolated", gap(F.lag("y").over(by_height)) & gap(F.lead("y").over(by_height)))
    return rows.withColumn("n_aligned", at(-tolerance, tolerance) - at(-tolerance, -tolerance) - at(tolerance, tolerance))


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """Candidates of the font, position and pattern detectors with confidence in hundredths and ``src_ord``."""
    rows = measured_blocks(blocks).where(may_be_heading(F.col("text"))).withColumn("heading", stripped("text"))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    flags = F.col("font_flags")
    by_font = (
        F.when(F.col("font_size") >= F.col("title_font"), 70).when(F.col("font_size") >= F.col("h3_font"), 40).otherwise(0)
        + points(flags.bitwiseAND(1) != 0, 30)
        + points(flags.bitwiseAND(2) != 0, 10)
        + points(F.col("is_left"), 20)
        + points(F.col("is_isolated"), 30)
    )
    by_position = (
        points(F.col("is_centered"), 50)
        + points(F.col("n_aligned") >= 2, 30)
        + points(F.col("unusual_spacing"), 40)
        + points((F.length("heading") < 50) & F.col("is_isolated"), 30)
    )
    numbered = F.col("heading").rlike(any_of(NUMBERED, ""))
    size = F.length("heading")
    by_pattern = (
        points(numbered | F.col("heading").rlike(any_of(NAMED)), 60)
        + points(F.lower("heading").rlike("|".join(STRUCTURE_WORDS)), 40)
        + F.when(size.between(5, 80), 20).when(size > 150, -50).otherwise(0)
    )
    detector = F.explode(
        F.array(
            F.struct(F.lit(1).alias("src_ord"), F.lit("font").alias("pattern_type"), by_font.alias("confidence"), F.lit(50).alias("least")),
            F.struct(
                F.lit(2).alias("src_ord"), F.when(F.col("is_centered"), "centered").otherwise("position").alias("pattern_type"),
                by_position.alias("confidence"), F.lit(40).alias("least"),
            ),
            F.struct(F.lit(3).alias("src_ord"), F.lit("pattern").alias("pattern_type"), by_pattern.alias("confidence"), F.lit(40).alias("least")),
        )
    )
    found = rows.withColumn("is_numbered", numbered).withColumn("d", detector).where("d.confidence >= d.least")
    return found.select(
        "doc_id", "block_no", "page_number", "x", "y", "font_size", "font_name", F.col("heading").alias("text"),
        "d.src_ord", "d.pattern_type", "d.confidence", (F.col("is_numbered") & (F.col("d.src_ord") == 3)).alias("is_numbered"),
    )


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """The first candidate of each text in a document, in the detectors' order, if confident and valid."""
    first = Window.partitionBy("doc_id", F.lower("text")).orderBy("src_ord", "block_no")
    kept = candidates.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return kept.where((F.col("confidence") >= 40) & valid_candidate(F.col("text")))


def with_levels(headings: DataFrame) -> DataFrame:
    """Headings with level by number, word or place in the document's font ladder."""
    ladder = F.reverse(F.array_sort(F.collect_set("font_size").over(Window.partitionBy("doc_id"))))
    size, n = F.col("font_size"), F.size("ladder")
    top, second = F.element_at("ladder", 1), F.try_element_at("ladder", F.lit(2))
    level = (
        F.when(F.col("text").rlike(r"^\d+\.\s") | F.lower("text").rlike("chapter|part|section"), "H1")
        .when(F.col("text").rlike(r"^\d+\.\d+"), "H2")
        .when((n < 2) | (size >= top), "H1")
        .when((n == 2) | (size >= second), "H2")
        .otherwise("H3")
    )
    return headings.withColumn("ladder", ladder).withColumn("level", level).drop("ladder")


def detected_headings(blocks: DataFrame) -> DataFrame:
    """The whole chain: candidates, deduplication, levels, final validation."""
    return with_levels(distinct_candidates(heading_candidates(blocks))).where(final_heading(F.col("text")))


def by_confidence(headings: DataFrame) -> DataFrame:
    """Headings with their ``place`` in the document, the most confident first, then in reading order."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "page_number", "y", "block_no")
    return headings.withColumn("place", F.row_number().over(order))


# The strict variant.


def strict_heading(text: Column, font_size: Column, y: Column, page_height: float = 792.0) -> Column:
    own = stripped(text)
    size, n = F.length(own), word_count(own)
    heading_like = (
        size.between(5, 80)
        & n.between(1, 12)
        & (is_title(own) | (is_upper(own) & (size > 3)) | own.rlike(r"^\d+\.") | F.lower(own).rlike("|".join(SECTION_WORDS)))
    )
    return (
        size.between(2, 150)
        & ~own.rlike(any_of(STRICT_NO_HEADING, "(?im)"))
        & ~own.rlike(r"^\d+$")
        & ~own.rlike(r"^\W*$")
        & (n <= 20)
        & (font_size > 10)
        & (font_size < 72)
        & (y > 50)
        & (y < page_height - 50)
        & (own.rlike(any_of(STRICT_HEADING)) | heading_like)
    )


def strict_level(text: Column, font_size: Column, y: Column, large: float = 14.0) -> Column:
    low = F.lower(stripped(text))
    yes = lambda c: c.cast("int")
    first = yes(text.rlike(r"^\d+\.\s+")) + yes(low.rlike("application|form|overview|summary")) + yes(font_size >= large) + yes(y < 200)
    second = text.rlike(r"^[a-z]\.\s+") | text.rlike(r"^[ivx]+\.\s+") | low.rlike("name|designation|date|address") | ((font_size >= 10) & (font_size < large))
    return F.when(first >= 2, "H1").when(second, "H2").otherwise("H3")


def outline_report(headings: DataFrame) -> DataFrame:
    """Per document (title is its first heading): issues, counts and the share of fragmented headings."""
    fragmented = (F.length("text") < 5) | F.col("text").rlike("(and|or|the|of|in)$") | F.col("text").rlike("^(and|or|the|of)")
    own = headings.groupBy("doc_id").agg(
        F.min_by("text", F.struct("page_number", "y", "block_no")).alias("title"),
        F.count("*").alias("heading_count"),
        F.sum(fragmented.cast("int")).alias("fragments"),
        F.max((F.col("level") == "H1").cast("int")).alias("has_h1"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.length(F.trim("title")) < 3, "Title is missing or too short").when(
                F.col("title").rlike(any_of(STRICT_NO_HEADING, "(?im)")), "Title appears to be metadata or non-content"
            ),
            F.when(F.col("heading_count") > 100, "Too many headings detected (possible false positives)"),
            F.when(F.col("fragments") > F.col("heading_count") * 0.3, "High proportion of fragmented headings"),
            F.when((F.col("has_h1") == 0) & (F.col("heading_count") > 5), "No H1 headings found in substantial document"),
        )
    )
    return own.select(
        "doc_id", "title", "heading_count", issues.alias("issues"), (F.size(issues) == 0).alias("is_valid"), F.length("title").alias("title_length"),
        (F.col("fragments") / F.col("heading_count")).alias("fragmented_ratio"),
    )
