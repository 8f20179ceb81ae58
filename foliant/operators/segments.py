"""Text classification, segmentation, document kinds and texts between headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_title, is_upper, ordered_join, stripped, word_count

# Patterns of document kinds, in the order in which ties are decided.
DOCUMENT_KINDS = {
    "form": (
        r"application\s+form",
        r"registration\s+form",
        r"claim\s+form",
        r"please\s+fill",
        r"signature\s+of\s+applicant",
        r"office\s+use\s+only",
        r"for\s+office\s+use",
    ),
    "academic_paper": (
        r"^abstract$",
        r"^introduction$",
        r"^methodology$",
        r"^references$",
        r"^bibliography$",
        r"et\s+al\.",
        r"\[\d+\]",
    ),
    "report": (
        r"^executive\s+summary",
        r"^table\s+of\s+contents",
        r"^appendix\s+[a-z]",
        r"figure\s+\d+",
        r"table\s+\d+",
    ),
    "manual": (
        r"user\s+manual",
        r"installation\s+guide",
        r"step\s+\d+",
        r"getting\s+started",
        r"troubleshooting",
    ),
}


def block_class(text: Column) -> Column:
    """struct(label, confidence) of a block."""
    own = stripped(F.coalesce(text, F.lit("")))
    of = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    return (
        F.when(own == "", of("other", 0.0))
        .when(F.length(own) < 5, of("other", 0.1))
        .when(is_upper(own) | is_title(own), of("heading", 0.8))
        .when(own.rlike(r"\d") & F.lower(own).rlike("table|figure"), of("table", 0.7))
        .when(word_count(own) > 20, of("body", 0.9))
        .otherwise(of("body", 0.5))
    )


def segments(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, type, text): paragraphs between blank lines with their type."""
    parts = F.filter(F.transform(F.split(text_col, r"\n\n"), stripped), lambda p: p != "")
    found = rows.select(F.col(id_col), F.posexplode(parts).alias("position", "text"))
    kind = (
        F.when(F.col("text").rlike(r"(?i)\b(table|column|row)\b"), "table")
        .when(F.col("text").rlike("(?s)```.*```"), "code")
        .when(F.col("text").rlike(r"(?i)\b(figure|image|diagram)\b"), "figure")
        .when((word_count("text") < 10) & is_upper("text"), "heading")
        .otherwise("paragraph")
    )
    return found.select(id_col, "position", kind.alias("type"), "text")


def document_kinds(blocks: DataFrame, kinds=DOCUMENT_KINDS, first: int = 20) -> DataFrame:
    """(doc_id, kind, votes): patterns found in the first blocks; most votes, the first of equals, none is unknown."""
    order = Window.partitionBy("doc_id").orderBy("block_no")
    head = blocks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= first)
    whole = head.groupBy("doc_id").agg(ordered_join(F.col("block_no"), F.lower("text"), " ").alias("whole"))
    votes = F.array(
        *[
            F.struct(sum((F.col("whole").rlike(p).cast("int") for p in patterns), F.lit(0)).alias("votes"), F.lit(-i).alias("o"), F.lit(kind).alias("kind"))
            for i, (kind, patterns) in enumerate(kinds.items())
        ]
    )
    best = F.array_max(votes)
    return whole.select("doc_id", F.when(best["votes"] > 0, best["kind"]).otherwise("unknown").alias("kind"), best["votes"].alias("votes"))


def texts_between_headings(pages: DataFrame, headings: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, heading_no, heading, start_page, end_page, content).

    ``pages`` is (doc_id, page_idx, text), ``headings`` (doc_id, heading_no,
    page_idx, position, text) with positions from 0.  A section reaches to the
    next heading.  With ``compat`` the next heading's page is left out and the
    page before it is cut at that heading's position.
    """
    order = Window.partitionBy("doc_id").orderBy("page_idx", "position", "heading_no")
    spans = headings.select(
        "doc_id", "heading_no", F.col("text").alias("heading"), F.col("page_idx").alias("start_page"), F.col("position").alias("start_at"),
        F.lead("page_idx").over(order).alias("end_page"), F.lead("position").over(order).alias("end_at"),
    )
    page, last = F.col("page_idx"), F.col("end_page") - (1 if compat else 0)
    inside = (page >= F.col("start_page")) & (F.col("end_page").isNull() | (page <= last))
    joined = spans.join(pages, "doc_id").where(inside)
    begin = F.when(page == F.col("start_page"), F.col("start_at")).otherwise(0)
    end = F.when(page == last, F.col("end_at")).otherwise(F.length("text"))
    part = F.substring(F.col("text"), begin + 1, F.greatest(end - begin, F.lit(0)))
    contents = joined.groupBy("doc_id", "heading_no").agg(ordered_join(page, part, "\n").alias("content"))
    return spans.join(contents, ["doc_id", "heading_no"], "left").select(
        "doc_id", "heading_no", "heading", "start_page", "end_page", F.coalesce("content", F.lit("")).alias("content")
    )
