"""Scores as column expressions: similarity, section quality, passage bonus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config as C
from foliant.config import DEFAULT, EngineConfig
from foliant.functions.text import contains_any, count_of, hits, word_count


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, unequal or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def steps(value: Column, *levels: tuple[int, float]) -> Column:
    """The value of the first level (falling) that is reached, else 0."""
    found = F.lit(0.0)
    for least, worth in reversed(levels):
        found = F.when(value >= least, F.lit(worth)).otherwise(found)
    return found


def informativeness(content: Column, config: EngineConfig = DEFAULT) -> Column:
    size = F.length(content)
    bonus = steps(hits(content, config.informative), (5, 0.3), (3, 0.2), (1, 0.1)) + F.when(size > 500, 0.2).when(size > 300, 0.1).otherwise(0.0)
    return bonus * config.informativeness_weight


def covered_topics(content: Column, config: EngineConfig = DEFAULT) -> Column:
    return sum((contains_any(content, terms).cast("int") for terms in config.topics.values()), F.lit(0))


def diversity(content: Column, config: EngineConfig = DEFAULT) -> Column:
    return steps(covered_topics(content, config), (4, 0.4), (3, 0.3), (2, 0.2)) * config.diversity_weight


def section_quality(title: Column, content: Column, config: EngineConfig = DEFAULT) -> Column:
    return (
        F.when(contains_any(title, C.GENERIC_TITLES), config.generic_title_penalty).otherwise(0.0)
        + F.when(F.length(content) < config.min_section_length, config.short_content_penalty).otherwise(0.0)
        + F.when(word_count(content) < config.min_section_words, config.fragment_penalty).otherwise(0.0)
        + informativeness(content, config)
        + diversity(content, config)
    )


def title_penalty(title: Column, config: EngineConfig = DEFAULT) -> Column:
    return F.when((word_count(title) < 3) | contains_any(title, config.trivial_titles), config.title_penalty).otherwise(0.0)


def keyword_boost(title: Column, content: Column, config: EngineConfig = DEFAULT) -> Column:
    return hits(F.concat_ws("\n", title, content), config.persona_keywords) * config.keyword_boost


def passage_bonus(passage: Column, is_recipe: bool, config: EngineConfig = DEFAULT) -> Column:
    if is_recipe:
        both = contains_any(passage, C.BONUS_INGREDIENT_CUES) & contains_any(passage, C.BONUS_INSTRUCTION_CUES)
        bonus = (
            F.when(both, 0.4).otherwise(0.0)
            + steps(hits(passage, C.COOKING_DETAILS), (3, 0.3), (2, 0.2), (1, 0.1))
            + F.when(F.length(passage) > config.recipe_target_length, 0.2).otherwise(0.0)
        )
    else:
        bonus = (
            F.when(F.length(passage) > config.target_passage_length, 0.2).otherwise(0.0)
            + steps(count_of(passage, ",", ";", ":", "("), (8, 0.3), (5, 0.2), (3, 0.1))
            + steps(hits(passage, C.ADVICE), (2, 0.2), (1, 0.1))
        )
    return F.least(bonus, F.lit(1.0))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; where all are equal, 1 for positive scores and 0 otherwise."""
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.when(score > 0, 1.0).otherwise(0.0))
