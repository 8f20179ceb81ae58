"""Languages of texts and documents: each text is read once, results equal a plain pass."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from foliant.operators import language as L
from foliant.plans import catalog

SPACES = " \t\n\x0b\f\r"
ENGLISH, GERMAN, FRENCH = "the of and to in that is was for with " * 2, "der die das und ist nicht ein eine mit auf " * 2, "le la les des et qui dans une pour sous " * 2
TEXTS = (
    None, "", " ", "the", "the " * 13, "the la " * 30, "que " * 30, "que por " * 7 + "x" * 60, "der und le la " * 12, "der und le " * 8 + "x" * 60,
    "THE OF And der " + "y" * 50, "\t\n the \x0b la" * 20, "que por " * 300 + "der " * 4000, "x" * 998 + " the le le le", " " * 60 + "der", ENGLISH, GERMAN, FRENCH,
)


def probable(text):
    found = [] if text is None else "".join(" " if c in SPACES else c for c in text[:1000].lower()).split(" ")
    counts = sorted(((sum(w in own for w in found), -i, code) for i, (code, own) in enumerate(L.FREQUENT.items())), reverse=True)
    weights = [math.exp((n - counts[0][0]) * L.ODDS / 10) for n, _, _ in counts]
    return [(code, None if text is None else w / sum(weights)) for (_, _, code), w in zip(counts, weights)]


def identified(text):
    code, prob = probable(text)[0]
    return "en" if text is None or len(text.strip(SPACES)) < 50 or prob < 0.8 else code


def test_texts_equal_a_plain_pass(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    text = F.col("text")
    for i, own, lang, shares in rows.select("i", L.probabilities(text), L.identified(text), L.shares(text)).collect():
        expected = probable(TEXTS[i])
        assert [x.lang for x in own] == [code for code, _ in expected]
        assert [x.prob for x in own] == pytest.approx([prob for _, prob in expected])
        assert lang == identified(TEXTS[i])
        assert [x.lang for x in shares] == ([code for code, prob in expected if prob is not None and prob >= 0.3] or ["en"])


def multilingual(texts):
    step = max(len(texts) // 10, 1)
    sample = [t for i, t in enumerate(texts) if i % step == 0 and t is not None and len(t) > 50][:10]
    return len(texts) >= 5 and len({identified(t) for t in sample}) > 1


def test_documents_equal_a_plain_pass(spark):
    documents = {
        1: [ENGLISH, GERMAN] * 2, 2: [ENGLISH, GERMAN, ENGLISH, GERMAN, FRENCH], 3: [ENGLISH] * 10 + [GERMAN] * 9, 4: ["the", None] * 5 + [ENGLISH] * 4 + [GERMAN] * 5,
        5: [ENGLISH, GERMAN] * 10, 6: [ENGLISH, ENGLISH, GERMAN, ENGLISH] * 5, 7: ["der"] * 9, 8: [None] * 6, None: [ENGLISH, GERMAN, FRENCH] * 3,
    }
    rows = [(d, 3 * i, t) for d, texts in documents.items() for i, t in enumerate(texts)]
    found = L.multilingual_documents(spark.createDataFrame(rows, "doc_id long, block_no int, text string").repartition(5)).collect()
    assert dict(map(tuple, found)) == {d: d is not None and multilingual(texts) for d, texts in documents.items()}
    assert len(found) == len(documents)


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once(spark, small):
    """Uses of a column in lambdas each split the text again, some hundred times in all; the query also read it twice and shuffled it."""
    for name in ("language_vote", "language_shares"):
        assert plan(catalog.QUERIES[name](spark, small)).count("split(") == 1
    query = catalog.QUERIES["multilingual_documents"](spark, small)
    assert plan(query).count("split(") == 2  # lines, words
    assert plan(query).count("regexp_replace(") == 2  # a line's ends, and again where a language other than English is likely
    assert plan(query).count("Relation [") == 1
    assert query._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
