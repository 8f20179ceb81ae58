"""Sections from blocks: headings with their text, recipes, pages as a fallback.

The two folds (whose next step depends on what was accepted before) run per
document in Arrow batches; everything else is windows and aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.config import DEFAULT, EngineConfig
from foliant.functions.text import contains_any, cut_with_dots, stripped, word_count

SECTION_SCHEMA = (
    "doc_id long, section_no int, title string, page_number int, x double, y double, font_size double, content string, importance_rank int"
)


def bold_heading(text: Column, flags: Column) -> Column:
    """Bold, at least two words and three characters, and not a trivial heading."""
    low = F.regexp_replace(F.lower(text), "^:+|:+$", "")
    trivial = low.isin(*C.TRIVIAL_HEADINGS) | low.rlike("^(" + "|".join(C.TRIVIAL_HEADINGS) + "):")
    return (flags == 20) & (word_count(text) >= 2) & (F.length(text) >= 3) & ~trivial


def recipe_documents(blocks: DataFrame, keywords=C.RECIPE_KEYWORDS, ratio: float = DEFAULT.recipe_ratio) -> DataFrame:
    """(doc_id, is_recipe): the share of blocks with a recipe keyword reaches the ratio."""
    share = F.avg(contains_any("text", keywords).cast("int"))
    return blocks.groupBy("doc_id").agg((share >= ratio).alias("is_recipe"))


def page_sections(blocks: DataFrame, config: EngineConfig = DEFAULT, *carried: str) -> DataFrame:
    """Sections from pages: the first long block is the title, the next four the content.

    ``carried`` columns are the same in all blocks of a document and stay.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("y", "block_no", "text"))), lambda b: b["text"])
    pages = blocks.where(F.length("text") > 10).groupBy("doc_id", "page_number").agg(texts.alias("texts"), *[F.first(c).alias(c) for c in carried])
    order = Window.partitionBy("doc_id").orderBy("page_number")
    numbered = pages.withColumn("importance_rank", F.row_number().over(order)).where(F.col("importance_rank") <= config.fallback_sections)
    return numbered.select(
        "doc_id",
        "page_number",
        "importance_rank",
        cut_with_dots(F.element_at("texts", 1), 80).alias("title"),
        cut_with_dots(F.array_join(F.slice("texts", 2, 4), " "), 400).alias("content"),
        *carried,
    )


def _is_trivial(text: str) -> bool:
    bare = text.lower().strip(":")
    return bare in C.TRIVIAL_HEADINGS or any(bare.startswith(t + ":") for t in C.TRIVIAL_HEADINGS)


def assemble_sections(texts: list[str], flags: list[int], config: EngineConfig = DEFAULT) -> list[tuple[int, str, list[str]]]:
    """(heading block, title, content blocks) of a document's sections in reading order.

    A heading takes the blocks behind it up to the next bold block (the one
    right behind it may be bold) or the cap; blocks taken head no section.
    """
    found, taken = [], set()

    def content_after(i: int) -> tuple[list[str], int]:
        content, k = [], i + 1
        while k < len(texts) and len(content) < config.max_content_blocks:
            if flags[k] == 20 and k != i + 1 and texts[k]:
                break
            if texts[k] and texts[k].lower().strip(":") not in C.TRIVIAL_HEADINGS:
                content.append(texts[k])
            k += 1
        return content, k

    def enough(content: list[str]) -> bool:
        return len(content) >= config.min_content_blocks and len(" ".join(content)) >= config.min_section_length

    for i, text in enumerate(texts):
        if len(text) < 3:
            continue
        if _is_trivial(text):
            # It joins the nearest bold heading before it.
            for j in range(i - 1, -1, -1):
                if flags[j] == 20 and texts[j].lower().strip(":") not in C.TRIVIAL_HEADINGS and len(texts[j].split()) >= 2:
                    content, end = content_after(i)
                    if enough(content):
                        found.append((i, f"{texts[j]} - {text}", content))
                        taken.update((j, *range(i, end)))
                    break
        elif flags[i] == 20 and i not in taken and len(text.split()) >= 2:
            content, end = content_after(i)
            if enough(content):
                found.append((i, text if len(text) <= 100 else text[:100] + "...", content))
                taken.update(range(i, end))
    return found


def heading_sections(blocks: DataFrame, config: EngineConfig = DEFAULT, *carried: str) -> DataFrame:
    """Sections under bold headings, before titles are filtered; ``carried`` columns are the same in a document and stay."""
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in carried)
    names = [*(c.split()[0] for c in SECTION_SCHEMA.split(", ")), *carried]

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["page_number", "y", "block_no"], kind="stable").reset_index(drop=True)
        rows = [
            (own.doc_id[0], n, title, own.page_number[i], own.x[i], own.y[i], own.font_size[i], "\n".join(content), n + 1, *(own[c][0] for c in carried))
            for n, (i, title, content) in enumerate(assemble_sections(own.text.tolist(), own.font_flags.tolist(), config))
        ]
        return pd.DataFrame(rows, columns=names)

    wanted = blocks.select("doc_id", "block_no", "page_number", "x", "y", "font_size", "font_flags", stripped("text").alias("text"), *carried)
    return wanted.groupBy("doc_id").applyInPandas(fold, ", ".join(filter(None, (SECTION_SCHEMA, kinds))))


def distinct_titles(sections: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Per document the first section of each title; trivial titles and short contents go first."""
    kept = (
        sections.withColumn("norm", F.lower(stripped("title")))
        .where("norm <> ''")
        .where(~F.col("norm").rlike("|".join(C.TRIVIAL_HEADINGS)))
        .where(word_count("content") >= config.min_section_words)
    )
    first = Window.partitionBy("doc_id", "norm").orderBy("section_no")
    kept = kept.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "norm")
    order = Window.partitionBy("doc_id").orderBy("section_no")
    return kept.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= config.sections_per_document).drop("rn")


def standard_sections(blocks: DataFrame, config: EngineConfig = DEFAULT, *carried: str) -> DataFrame:
    """Sections under headings; documents without any get their pages.

    Both kinds are made for every document in one pass each, and a window tells
    which one stays, so the fold runs once and documents are not joined.
    """
    headed = distinct_titles(heading_sections(blocks, config, *carried), config)
    pages = page_sections(blocks, config, *carried).select(
        "doc_id", (F.col("importance_rank") - 1).alias("section_no"), "title", "page_number", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.lit(12.0).alias("font_size"), "content", "importance_rank", *carried,
    )
    both = headed.withColumn("_headed", F.lit(True)).unionByName(pages.withColumn("_headed", F.lit(False)))
    any_headed = F.max("_headed").over(Window.partitionBy("doc_id"))
    return both.withColumn("_any", any_headed).where(F.col("_headed") == F.col("_any")).drop("_headed", "_any")


def recipe_title(ingredients: Column, number: Column) -> Column:
    """The first food term, else the first cooking method, that the ingredients name."""
    low = F.lower(ingredients)
    named = lambda terms, tail: F.element_at(
        F.filter(F.array(*[F.when(low.contains(t), F.lit(f"{t.title()} {tail}")) for t in terms]), lambda x: x.isNotNull()), 1
    )
    with_guard = lambda terms, tail: F.when(contains_any(low, terms), named(terms, tail))
    return F.coalesce(
        with_guard(C.RECIPE_FOODS, "Recipe"), with_guard(C.COOKING_METHODS, "Dish"), F.concat(F.lit("Recipe "), number.cast("string"))
    )


def assemble_recipes(texts: list[str], ingredient_cues, instruction_cues) -> list[tuple[list[int], list[int]]]:
    """(ingredient blocks, instruction blocks) of a document's recipes in reading order."""
    low = [t.lower() for t in texts]
    starts = [any(c in t for c in ingredient_cues) for t in low]
    directs = [any(c in t for c in instruction_cues) for t in low]
    found, i = [], 0
    while i < len(texts):
        if not (starts[i] and len(texts[i]) >= 3):
            i += 1
            continue
        end = next((j for j in range(i + 1, len(texts)) if texts[j] and (directs[j] or starts[j])), len(texts))
        if end == len(texts) or not directs[end]:
            i += 1
            continue
        stop = next((k for k in range(end + 1, len(texts)) if texts[k] and starts[k]), len(texts))
        parts = [i, *(j for j in range(i + 1, end) if texts[j] and len(texts[j]) < 100 and not low[j].startswith(("step", "recipe", "serves", "prep time")))]
        ways = [end, *(k for k in range(end + 1, stop) if texts[k] and len(texts[k]) < 200 and not low[k].startswith(("recipe", "serves", "prep time")))]
        found.append((parts, ways))
        # The block with the directions may itself name ingredients and begin the next recipe.
        i = end
    return found


def recipe_sections(
    blocks: DataFrame,
    ingredient_cues=C.DOCUMENT_INGREDIENT_CUES,
    instruction_cues=C.DOCUMENT_INSTRUCTION_CUES,
    config: EngineConfig = DEFAULT,
) -> DataFrame:
    """(doc_id, section_no, title, page_number, ingredients, instructions, content) of recipes, fifteen a document at most."""
    schema = "doc_id long, section_no int, page_number int, ingredients string, instructions string, texts array<string>"

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["page_number", "y", "block_no"], kind="stable").reset_index(drop=True)
        texts, rows = own.text.tolist(), []
        for n, (parts, ways) in enumerate(assemble_recipes(texts, ingredient_cues, instruction_cues), 1):
            both = [texts[k] for k in (*parts, *ways)]
            rows.append((own.doc_id[0], n, own.page_number[parts[0]], " ".join(texts[k] for k in parts), " ".join(texts[k] for k in ways), both))
        return pd.DataFrame(rows, columns=["doc_id", "section_no", "page_number", "ingredients", "instructions", "texts"])

    wanted = blocks.select("doc_id", "block_no", "page_number", "y", stripped("text").alias("text"))
    recipes = wanted.groupBy("doc_id").applyInPandas(fold, schema)
    whole = F.array_join("texts", " ")
    recipes = recipes.where((F.length(whole) >= config.min_recipe_text) & (word_count(whole) >= config.min_recipe_words))
    named = recipes.withColumn("name", recipe_title(F.col("ingredients"), F.col("section_no")))
    parts = F.array(
        F.concat(F.lit("Recipe: "), "name"), F.concat(F.lit("Ingredients: "), "ingredients"), F.concat(F.lit("Instructions: "), "instructions")
    )
    more = F.filter("texts", lambda t: ~F.exists(parts, lambda p: p.contains(t)))
    order = Window.partitionBy("doc_id").orderBy("section_no")
    return (
        named.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= config.sections_per_document)
        .select(
            "doc_id", "section_no", F.concat(cut_with_dots("name", 80), F.lit(" - Ingredients & Instructions")).alias("title"), "page_number",
            "name", "ingredients", "instructions", F.array_join(F.concat(parts, more), " ").alias("content"),
        )
    )
