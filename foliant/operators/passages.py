"""Passages from ranked sections: splitting, filters, duplicates, scores, top lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.config import DEFAULT, EngineConfig
from foliant.functions.score import cosine, passage_bonus
from foliant.functions.text import best_topic, contains_any, count_of, distinct_words, stripped, words
from foliant.operators.embed import buckets, hashing, similarity
from foliant.operators.ranking import Profiles, dietary_filter_passages, first_per, passage_allowed, profile_text


def flattened(text: Column) -> Column:
    """Line breaks become spaces and pairs of spaces one, once, then trimmed."""
    return stripped(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def _splitter(delimiter: str):
    return lambda part: F.split(part, "\\Q" + delimiter + "\\E")


def semantic_passages(title: Column, text: Column, ingredient_cues=C.PASSAGE_INGREDIENT_CUES, instruction_cues=C.PASSAGE_INSTRUCTION_CUES) -> Column:
    """Array of passages: pieces between sentence ends, cut where both kinds of cue were seen.

    The fold's state is the passages so far, the open pieces and the cues seen.
    """
    parts = F.array(flattened(text))
    for delimiter in C.PASSAGE_DELIMITERS:
        parts = F.flatten(F.transform(parts, _splitter(delimiter)))
    pieces = F.filter(F.transform(parts, stripped), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(False).alias("a"), F.lit(False).alias("b"))

    def joined(open_pieces: Column) -> Column:
        whole = F.array_join(open_pieces, " ")
        return stripped(F.when(title != "", F.concat(title, F.lit(": "), whole)).otherwise(whole))

    def step(state: Column, piece: Column) -> Column:
        a, b = state["a"] | contains_any(piece, ingredient_cues), state["b"] | contains_any(piece, instruction_cues)
        taken = F.concat(state["open"], F.array(piece))
        return F.when(
            a & b, F.struct(F.concat(state["done"], F.array(joined(taken))).alias("done"), empty.alias("open"), F.lit(False).alias("a"), F.lit(False).alias("b"))
        ).otherwise(F.struct(state["done"].alias("done"), taken.alias("open"), a.alias("a"), b.alias("b")))

    end = F.aggregate(pieces, start, step)
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(
        F.when(F.size(end["open"]) > 0, F.concat(end["done"], F.array(joined(end["open"])))).otherwise(end["done"])
    )


def exploded_passages(sections: DataFrame) -> DataFrame:
    """(collection, doc_ord, section_no, passage_no, passage) and the section's columns."""
    return sections.select("*", F.posexplode(semantic_passages(F.col("title"), F.col("content"))).alias("passage_no", "passage"))


def recipe_name(title: Column) -> Column:
    bare = stripped(F.replace(F.replace(title, F.lit(" - Ingredients & Instructions"), F.lit("")), F.lit(" Recipe"), F.lit("")))
    return F.when(F.lower(bare).isin("recipe", "ingredients", "instructions") | bare.startswith("Recipe "), "").otherwise(bare)


def recipe_passage(
    title: Column, text: Column, ingredient_cues=C.PASSAGE_INGREDIENT_CUES, instruction_cues=C.PASSAGE_INSTRUCTION_CUES, config: EngineConfig = DEFAULT
) -> Column:
    """One passage with a recipe's ingredients and instructions, else the whole text if long enough, else null."""
    flat = flattened(text)
    low = F.lower(flat)
    first = F.coalesce(*[F.when(F.instr(low, c) > 0, F.instr(low, c)) for c in ingredient_cues])
    # The first cue (in the list's order) behind the ingredients' beginning ends them.
    tail = F.substring(low, first + 1, F.length(low))
    behind = F.coalesce(*[F.when(F.instr(tail, c) > 0, F.instr(tail, c) + first) for c in instruction_cues], F.length(flat) + 1)
    ingredients = stripped(F.substring(flat, first, behind - first))
    begins = F.coalesce(*[F.when(F.instr(low, c) > 0, F.instr(low, c)) for c in instruction_cues])
    instructions = stripped(F.substring(flat, begins, F.length(flat)))
    name = recipe_name(F.coalesce(title, F.lit("")))
    whole = F.concat_ws(" ", F.when(name != "", F.concat(F.lit("Recipe: "), name)), ingredients, instructions)
    cut = F.when(F.length(whole) > config.recipe_max_length, F.concat(F.substring(whole, 1, config.recipe_max_length), F.lit("..."))).otherwise(whole)
    complete = first.isNotNull() & begins.isNotNull() & (ingredients != "") & (F.length(whole) >= config.recipe_min_length)
    return F.when(complete, cut).when(F.length(flat) >= 100, flat)


def is_recipe_section(title: Column, content: Column) -> Column:
    return contains_any(title, C.RECIPE_TITLES) | (
        contains_any(content, C.DOCUMENT_INGREDIENT_CUES) & contains_any(content, C.DOCUMENT_INSTRUCTION_CUES)
    )


def recipe_context(sections: DataFrame, persona: str, job: str, keywords=C.RECIPE_KEYWORDS, config: EngineConfig = DEFAULT) -> DataFrame:
    """(collection, is_recipe): food in persona or job, and recipe words or titles in the sections."""
    sums = sections.groupBy("collection").agg(*_recipe_sums(keywords))
    return sums.select("collection", _is_recipe(persona, job, config).alias("is_recipe"))


def _recipe_sums(keywords, over=lambda c: c) -> list[Column]:
    own = words(F.lower("content"))
    with_word = F.size(F.filter(own, lambda w: w.rlike("|".join(keywords))))
    titles = contains_any("title", C.RECIPE_SECTION_TITLES).cast("int")
    return [over(F.sum(c)).alias(name) for name, c in (("n", F.size(own)), ("hits", with_word), ("titles", titles))]


def _is_recipe(persona: str, job: str, config: EngineConfig) -> Column:
    food = any(t in f"{job} {persona}".lower() for t in C.FOOD_CONTEXT)
    share = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    return F.lit(food) & ((share >= config.recipe_ratio) | (F.col("titles") >= 2))


def with_recipe_context(sections: DataFrame, persona: str, job: str, keywords=C.RECIPE_KEYWORDS, config: EngineConfig = DEFAULT) -> DataFrame:
    """``sections`` with ``is_recipe`` of their collection, by a window."""
    whole = Window.partitionBy("collection")
    summed = sections.select("*", *_recipe_sums(keywords, lambda c: c.over(whole)))
    return summed.withColumn("is_recipe", _is_recipe(persona, job, config)).drop("n", "hits", "titles")


def well_shaped(passage: Column, config: EngineConfig = DEFAULT) -> Column:
    return (
        (F.length(stripped(passage)) >= config.min_passage_length)
        & (distinct_words(passage) >= config.min_unique_tokens)
        & (count_of(passage, ".", "!", "?") >= config.min_sentence_count)
    )


def of_quality(passage: Column, is_recipe: bool = False, value_terms=None, config: EngineConfig = DEFAULT) -> Column:
    terms = value_terms or ((*C.RECIPE_VALUE, *C.COOKING_TERMS) if is_recipe else config.value_terms)
    least = config.recipe_min_length if is_recipe else config.min_passage_length
    return (
        (F.length(passage) >= least)
        & (count_of(passage, ",", ";", ":") >= config.min_information_density)
        & contains_any(passage, terms)
        & ~contains_any(passage, C.GENERIC_FRAGMENTS)
    )


def without_near_duplicates(rows: DataFrame, group: list[str], order: str, vector: str, threshold: float = DEFAULT.duplicate_threshold) -> DataFrame:
    """Per group, greedily in order: a row whose vector is similar to one kept before goes.

    A group is a section, so the sorted list folded here is short; its rows
    travel in the list and are read once.
    """
    others = [c for c in rows.columns if c not in group]
    item = F.struct(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"), F.struct(*others).alias("row"))
    listed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("items"))
    none = F.slice("items", 1, 0)
    kept = F.aggregate(
        "items",
        none,
        lambda kept, x: F.when(F.exists(kept, lambda k: cosine(k["v"], x["v"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return listed.select(*group, F.explode(F.transform(kept, lambda x: x["row"])).alias("row")).select(*group, "row.*").select(*rows.columns)


def scored_passages(
    passages: DataFrame, persona: str, job: str, is_recipe: bool | Column = False, config: EngineConfig = DEFAULT, profiles: Profiles = (None, None)
) -> DataFrame:
    passages = passages.withColumn("buckets", buckets(F.col("passage"), config))
    similar = lambda text: similarity(F.col("buckets"), text, config)
    base = similar(profile_text("role", persona, profiles[0])) * config.passage_persona_weight + similar(profile_text("task", job, profiles[1])) * config.passage_job_weight
    bonus = lambda kind: passage_bonus(F.col("passage"), kind, config)
    own = bonus(is_recipe) if isinstance(is_recipe, bool) else F.when(is_recipe, bonus(True)).otherwise(bonus(False))
    with_parts = passages.withColumn("base_similarity", base).withColumn("quality_bonus", own)
    return with_parts.withColumn("score", F.round(F.col("base_similarity") + F.col("quality_bonus"), 9)).drop("buckets")


def best_passages(passages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The best of each section, then the best of the collection, with ``passage_rank``."""
    section = F.concat_ws("\u0001", F.col("collection").cast("string"), F.col("importance_rank").cast("string"))
    top = first_per(passages.withColumn("_s", section), "_s", (F.desc("score"), "passage_no"), config.passages_per_section).drop("_s")
    order = Window.partitionBy("collection").orderBy(F.desc("score"), "importance_rank", "passage_no")
    return top.withColumn("passage_rank", F.row_number().over(order)).where(F.col("passage_rank") <= config.passages_per_collection)


def passages_of(ranked_sections: DataFrame, persona: str, job: str, config: EngineConfig = DEFAULT, profiles: Profiles = (None, None)) -> DataFrame:
    """Passages of the first ranked sections: filtered, split, shaped, deduplicated, filtered, scored, best."""
    first = dietary_filter_passages(ranked_sections.where(F.col("importance_rank") <= config.passage_sections), job)
    with_context = with_recipe_context(first, persona, job, config=config)
    as_recipe = F.col("is_recipe") & is_recipe_section(F.col("title"), F.col("content"))
    whole = recipe_passage(F.col("title"), F.col("content"), config=config)
    split = F.when(as_recipe, F.filter(F.array(whole), lambda p: p.isNotNull())).otherwise(semantic_passages(F.col("title"), F.col("content")))
    rows = with_context.select("*", F.posexplode(split).alias("passage_no", "passage")).where(well_shaped(F.col("passage"), config))
    rows = rows.withColumn("passage_embedding", hashing(F.col("passage"), config))
    rows = without_near_duplicates(rows, ["collection", "importance_rank"], "passage_no", "passage_embedding", config.duplicate_threshold)
    good = lambda kind: of_quality(F.col("passage"), kind, None, config)
    kind: bool | Column = F.col("is_recipe") if any(t in f"{job} {persona}".lower() for t in C.FOOD_CONTEXT) else False
    rows = rows.where(passage_allowed(F.col("passage"), job) & (good(False) if kind is False else F.when(kind, good(True)).otherwise(good(False))))
    return best_passages(scored_passages(rows, persona, job, kind, config, profiles), config)


# Sentences and topics.


def sentences(text: str) -> list[str]:
    """Sentences of more than fifteen characters; an end counts behind more than twenty and before a capital, a space or the end."""
    found, begin = [], 0
    for i, c in enumerate(text):
        if c in ".!?" and len(text[begin : i + 1].strip()) > 20 and (i + 1 == len(text) or text[i + 1].isupper() or text[i + 1] == " "):
            found.append(text[begin : i + 1].strip())
            begin = i + 1
    if text[begin:].strip():
        found.append(text[begin:].strip())
    return [s for s in found if len(s) > 15]


def split_sentences(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with (sentence_no, sentence)."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentences(t or ""))

    return rows.select("*", F.posexplode(split(F.col(text_col))).alias("sentence_no", "sentence"))


def grouped_sentences(listed: Column, config: EngineConfig = DEFAULT, topics=None) -> Column:
    """Array of passages: sentences joined until long enough, until the topic changes in a long one, or before they get too long."""
    topics = topics or C.SENTENCE_TOPICS
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("topic"))

    def step(state: Column, sentence: Column) -> Column:
        topic = best_topic(sentence, topics)
        turns = state["topic"].isNotNull() & topic.isNotNull() & (topic != state["topic"]) & (state["n"] > 200)
        over = state["n"] + F.length(sentence) > config.max_passage_length
        ends = ((state["n"] > config.target_passage_length) | turns | over) & (F.size(state["open"]) > 0)
        return F.when(
            ends,
            F.struct(
                F.concat(state["done"], F.array(F.array_join(state["open"], " "))).alias("done"), F.array(sentence).alias("open"),
                F.length(sentence).alias("n"), topic.alias("topic"),
            ),
        ).otherwise(
            F.struct(
                state["done"].alias("done"), F.concat(state["open"], F.array(sentence)).alias("open"),
                (state["n"] + F.length(sentence)).alias("n"), F.coalesce(state["topic"], topic).alias("topic"),
            )
        )

    end = F.aggregate(listed, start, step)
    return F.when(F.size(end["open"]) > 0, F.concat(end["done"], F.array(F.array_join(end["open"], " ")))).otherwise(end["done"])


def topic_groups(rows: DataFrame, group: str, order: str, text_col: str, topics=None) -> DataFrame:
    """``rows`` with topic and topic_group: a new group where the topic changes; behind no topic any topic joins."""
    w = Window.partitionBy(group).orderBy(order)
    named = rows.withColumn("topic", best_topic(F.col(text_col), topics or C.CONTEXT_TOPICS))
    before = F.lag("topic").over(w)
    begins = F.when(before.isNotNull() & ~F.col("topic").eqNullSafe(before), 1).otherwise(0)
    return named.withColumn("begins", begins).withColumn("topic_group", F.sum("begins").over(w).cast("int")).drop("begins")


def narrative(parts: Column) -> Column:
    """The parts as one text: a full stop where one is missing, spaces mended."""
    last = F.size(parts) - 1
    ended = F.transform(
        parts, lambda p, i: F.when(stripped(p).rlike(r"[.!?]$") | (i == last), stripped(p)).otherwise(F.concat(stripped(p), F.lit(".")))
    )
    kept = F.filter(F.arrays_zip(parts.alias("p"), ended.alias("e")), lambda x: stripped(x["p"]) != "")
    text = F.array_join(F.transform(kept, lambda x: x["e"]), " ")
    for old, new in (("  ", " "), (" .", "."), (" ,", ",")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return stripped(text)
