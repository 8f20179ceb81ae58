"""Section ranking for a persona and a job, per collection.

Sections are (collection, doc_ord, section_no, document, title, page_number,
content).  Caps, filters and title deduplication keep this order: first input
cap, dietary filter, second cap, titles, score.  Rank filters on row numbers let
Spark keep only the first rows of a collection before the shuffle, so a
collection that holds most documents does not fill one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.config import DEFAULT, EngineConfig
from foliant.functions.score import keyword_boost, min_max, section_quality, title_penalty
from foliant.functions.text import contains_any, stripped
from foliant.operators.embed import buckets, similarity

INPUT_ORDER = ("doc_ord", "section_no")


def first_per(df: DataFrame, group: str, order: tuple, n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.where(F.col("_n") <= n).drop("_n")


def profile_text(kind: str, value: str, description: str | None = None) -> str:
    """What of a profile is embedded: its description, else its fields as written."""
    return description or "{'%s': '%s'}" % (kind, value.replace("'", "\\'"))


def wants(text: str, terms) -> bool:
    return any(t in text.lower() for t in terms)


def dietary_filter(sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT, terms=C.NON_VEGETARIAN) -> DataFrame:
    """Before ranking: where persona or job is vegetarian, sections that name meat or fish go."""
    if not ("vegetarian" in persona.lower() or "vegetarian" in job.lower()):
        return sections
    return sections.where(~contains_any(F.concat_ws(" ", "title", "content"), terms))


def dietary_filter_passages(sections: DataFrame, job: str, terms=C.NON_VEGETARIAN) -> DataFrame:
    """Before passages: where the job is vegetarian in any wording, such sections go."""
    if not wants(job, C.VEGETARIAN):
        return sections
    return sections.where(~(contains_any("title", terms) | contains_any("content", terms)))


def distinct_collection_titles(sections: DataFrame) -> DataFrame:
    """The first section of each title in a collection, across its documents."""
    return first_per(sections.withColumn("_t", F.concat_ws("\u0001", F.col("collection").cast("string"), F.lower(stripped("title")))), "_t", INPUT_ORDER, 1).drop("_t")


#: Descriptions of persona and job, or None.
Profiles = tuple[str | None, str | None]


def scored(sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT, profiles: Profiles = (None, None)) -> DataFrame:
    """Sections with base similarity, quality, penalty, boost and score."""
    title, content = F.col("title"), F.col("content")
    sections = sections.withColumn("buckets", buckets(F.concat_ws(" ", "title", "content"), config))
    similar = lambda text: similarity(F.col("buckets"), text, config)
    base = similar(profile_text("role", persona, profiles[0])) * config.persona_weight + similar(profile_text("task", job, profiles[1])) * config.job_weight
    parts = sections.select(
        *[c for c in sections.columns if c != "buckets"],
        base.alias("base_similarity"),
        section_quality(title, content, config).alias("quality_score"),
        title_penalty(title, config).alias("penalty"),
        keyword_boost(title, content, config).alias("boost"),
    )
    # Rounded, so that equal scores are equal whatever the order of the sum.
    return parts.withColumn("score", F.round(F.col("base_similarity") + F.col("quality_score") + F.col("penalty") + F.col("boost"), 9))


def capped(sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT) -> DataFrame:
    first = first_per(sections, "collection", INPUT_ORDER, config.input_sections)
    return first_per(dietary_filter(first, persona, job, config), "collection", INPUT_ORDER, config.ranked_sections)


def ranked(sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT, profiles: Profiles = (None, None)) -> DataFrame:
    """Ranked sections of each collection with ``importance_rank``."""
    kept = scored(distinct_collection_titles(capped(sections, persona, job, config)), persona, job, config, profiles)
    order = Window.partitionBy("collection").orderBy(F.desc("score"), *INPUT_ORDER)
    return kept.withColumn("importance_rank", F.row_number().over(order))


def relevance(ranked_sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Ranked sections with ``relevance_score``: similarity scaled to 0..1 within the collection."""
    whole = Window.partitionBy("collection")
    base = F.round("base_similarity", 9)
    return ranked_sections.withColumn("relevance_score", min_max(base, F.min(base).over(whole), F.max(base).over(whole)))


def passage_allowed(passage: Column, job: str) -> Column:
    """Persona and job filter on passages: vegetarian, gluten-free and corporate jobs each exclude terms."""
    allowed = F.lit(True)
    if wants(job, C.VEGETARIAN):
        allowed = allowed & ~contains_any(passage, C.NON_VEGETARIAN)
    if wants(job, C.GLUTEN_FREE):
        allowed = allowed & (~contains_any(passage, C.GLUTEN) | contains_any(passage, C.GLUTEN_FREE))
    if wants(job, C.CORPORATE_CONTEXT):
        allowed = allowed & ~contains_any(passage, C.CORPORATE_INAPPROPRIATE)
    return allowed
