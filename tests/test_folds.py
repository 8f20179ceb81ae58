"""The operators whose state depends on accepted output, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import config as C
from foliant.operators import outline, passages, sections


def test_section_assembly_consumes_blocks():
    long = "word " * 20
    texts = ["First Heading Here", long, long, long, "Second Heading Here", long, "Introduction", long, long, long]
    flags = [20, 0, 0, 0, 20, 0, 20, 0, 0, 0]
    found = sections.assemble_sections(texts, flags)
    # The trivial heading joins the one before it; the second heading alone has too little text.
    assert [(i, t) for i, t, _ in found] == [(0, "First Heading Here"), (6, "Second Heading Here - Introduction")]
    assert [len(c) for _, _, c in found] == [3, 3]


def test_adjacent_bold_block_is_content():
    long = "word " * 30
    found = sections.assemble_sections(["Main Title Here", "Bold Subtitle Here", long, long], [20, 20, 0, 0])
    assert found == [(0, "Main Title Here", ["Bold Subtitle Here", long, long])]


def test_content_is_capped():
    found = sections.assemble_sections(["Main Title Here", *["some words of text here and more" for _ in range(30)]], [20, *[0] * 30])
    assert len(found[0][2]) == C.DEFAULT.max_content_blocks


def test_recipes():
    texts = ["Ingredients: two eggs", "flour", "step not counted", "Instructions: mix", "bake it", "Ingredients: rice", "no directions follow"]
    assert sections.assemble_recipes(texts, C.DOCUMENT_INGREDIENT_CUES, C.DOCUMENT_INSTRUCTION_CUES) == [([0, 1], [3, 4])]


def test_semantic_passages(spark):
    rows = [("T", "You need ingredients. Flour and eggs. Method is to mix. Then rest! Serve"), ("", "plain. text"), ("T", ""), ("T", None)]
    frame = spark.createDataFrame(rows, "title string, content string")
    found = [r[0] for r in frame.select(passages.semantic_passages(F.col("title"), F.col("content"))).collect()]
    assert found == [["T: You need ingredients Flour and eggs Method is to mix", "T: Then rest Serve"], ["plain text"], [], []]


@pytest.mark.parametrize("partitions", [1, 7])
def test_greedy_duplicates(spark, partitions):
    draw = np.random.default_rng(3)
    rows = [(g, i, draw.normal(size=3).tolist()) for g in range(4) for i in range(20)] + [(9, 0, [0.0] * 3), (9, 1, None)]
    frame = spark.createDataFrame(rows, "g int, i int, v array<double>").repartition(partitions)
    found = {(r.g, r.i) for r in passages.without_near_duplicates(frame, ["g"], "i", "v", 0.88).collect()}
    expected = set()
    for g in {r[0] for r in rows}:
        kept: list = []
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            cos = lambda a, b: 0.0 if a is None or b is None or not np.any(a) or not np.any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
            if not any(cos(v, k) >= 0.88 for k in kept):
                kept.append(v)
                expected.add((g, i))
    assert found == expected


def test_sentences():
    assert passages.sentences("Short. This one is long enough. next is lower. End of it all here!") == [
        "Short. This one is long enough.", "next is lower. End of it all here!"
    ]


def test_sentence_groups_by_length(spark):
    frame = spark.createDataFrame([([f"{'x' * 160}{i}" for i in range(5)],)], "s array<string>")
    found = frame.select(passages.grouped_sentences(F.col("s"))).first()[0]
    assert [len(p.split()) for p in found] == [2, 2, 1]


def test_headings_split_and_similar():
    assert outline.split_heading("2.1 Intended Audience 2.2 Career Paths") == ["2.1 Intended Audience", "2.2 Career Paths"]
    assert outline.split_heading("Overview") == ["Overview"]
    assert outline.similar_texts("the big cat", "big cat")
    assert not outline.similar_texts("1. alpha beta", "2. gamma delta")


def test_repeated_words(spark):
    frame = spark.createDataFrame([("the The cat cat sat",), ("",), ("one",)], "t string")
    assert [r[0] for r in frame.select(outline.without_repeated_words(F.col("t"))).collect()] == ["the cat sat", "", "one"]


def test_title_components(spark):
    rows = [("Travel Guide", "Complete Travel Guide France"), ("Nice", "Complete Travel Guide France"), ("Anything", "")]
    frame = spark.createDataFrame(rows, "t string, title string")
    assert [r[0] for r in frame.select(outline.title_component(F.col("t"), F.col("title"))).collect()] == [True, False, False]
