"""The engine's run: blocks of collections to ranked sections, passages and nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.config import DEFAULT, EngineConfig
from foliant.operators import output, passages, ranking, sections
from foliant.sources.work import written


def page_sections_of(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Page sections as (collection, doc_ord, section_no, document, ...) rows; the source is the collection."""
    return _as_input(sections.page_sections(blocks, config, "source").withColumn("section_no", F.col("importance_rank") - 1))


def standard_sections_of(blocks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return _as_input(sections.standard_sections(blocks, config, "source"))


def _as_input(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("source").alias("collection"),
        F.col("doc_id").alias("doc_ord"),
        F.col("section_no").cast("int").alias("section_no"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document"),
        "title",
        F.col("page_number").cast("int").alias("page_number"),
        "content",
    )


def run(
    blocks: DataFrame,
    persona: str,
    job: str,
    config: EngineConfig = DEFAULT,
    persona_description: str | None = None,
    job_description: str | None = None,
) -> DataFrame:
    """One nested result per collection; descriptions, where given, are what the profiles embed."""
    profiles = (persona_description, job_description)
    # At most config.ranked_sections rows a collection, read by the passages and by the output.
    ranked = written(ranking.ranked(standard_sections_of(blocks, config), persona, job, config, profiles), "ranked-sections")
    best = passages.passages_of(ranked, persona, job, config, profiles)
    collections = blocks.groupBy(F.col("source").alias("collection")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))).alias("input_documents")
    )
    collections = collections.withColumns({"persona": F.lit(persona), "job_to_be_done": F.lit(job)})
    return output.assembled(collections, ranked, best)
