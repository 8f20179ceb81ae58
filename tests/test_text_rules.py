"""Text rules against Python's own string methods."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as T

SAMPLES = ["", "  ", "The Cat", "They'Re", "3D Model", "Éa Bc", "ALL CAPS 1", "a b  c\td", "one, two; three: (x)", "ÀÉ", "vegetable", "1.1 Intro", "x\ny"]


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_case_and_counts(spark):
    t = F.col("t")
    assert column(spark, SAMPLES, T.is_title(t)) == [s.istitle() for s in SAMPLES]
    assert column(spark, SAMPLES, T.is_upper(t)) == [s.isupper() for s in SAMPLES]
    assert column(spark, SAMPLES, T.word_count(t)) == [len(s.split()) for s in SAMPLES]
    assert column(spark, SAMPLES, T.distinct_words(t)) == [len(set(s.lower().split())) for s in SAMPLES]
    assert column(spark, SAMPLES, T.count_of(t, ",", ";", ":", "(")) == [sum(map(s.count, ",;:(")) for s in SAMPLES]
    assert column(spark, SAMPLES, T.contains_any(t, ("table", "the c"))) == [any(k in s.lower() for k in ("table", "the c")) for s in SAMPLES]
    assert column(spark, SAMPLES, T.hits(t, ("a", "e", "cat"))) == [sum(k in s.lower() for k in ("a", "e", "cat")) for s in SAMPLES]
    assert column(spark, SAMPLES, T.stripped(t)) == [s.strip() for s in SAMPLES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB ,.;1é\n", max_size=30), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    t = F.col("t")
    assert column(spark, texts, T.word_count(t)) == [len(s.split()) for s in texts]
    assert column(spark, texts, T.is_title(t)) == [s.istitle() for s in texts]


def test_topics_and_cuts(spark):
    topics = {"a": ("x", "y"), "b": ("z",), "c": ("q", "r")}
    values = ["x z", "z", "none", "q r x"]
    assert column(spark, values, T.best_topic(F.col("t"), topics)) == ["a", "b", None, "c"]
    assert column(spark, ["abcdef", "ab"], T.cut_with_dots("t", 3)) == ["abc...", "ab"]


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, expected):
    from foliant.functions.score import cosine

    frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert frame.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected)


def test_similarity_equals_vector_cosine(spark):
    from foliant.functions.score import cosine
    from foliant.operators.embed import buckets, hashing, similarity

    values = ["the cat sat on the mat", "", "dog", "the the the cat"]
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    profile = "The cat and the dog"
    both = frame.select(similarity(buckets(F.col("t")), profile).alias("s"), cosine(hashing(F.col("t")), hashing(F.lit(profile))).alias("c")).collect()
    assert all(r["s"] == pytest.approx(r["c"]) for r in both)


def test_min_max_of_equal_scores(spark):
    from foliant.functions.score import min_max

    frame = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 2.0, 2.0), (1.0, 0.0, 4.0)], "s double, lo double, hi double")
    assert [r[0] for r in frame.select(min_max(F.col("s"), F.col("lo"), F.col("hi"))).collect()] == [0.0, 1.0, 0.25]
