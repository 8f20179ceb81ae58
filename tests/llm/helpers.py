"""Rows with every trouble: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

WORDS = "river stone bright market letter window garden copper silver winter summer cloud meadow harbor bridge lantern orchard thunder valley candle".split()


def prose(seed: int, n: int) -> str:
    """n words in sentences, different for every seed."""
    import random

    draw = random.Random(seed)
    words = [draw.choice(WORDS) + (f"{draw.randrange(1000)}" if draw.random() < 0.3 else "") for _ in range(n)]
    return " ".join(w + (",."[i // 7 % 2] if i % 7 == 6 else "") for i, w in enumerate(words)).rstrip(".,") + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, class string, score string, spans string, path string"


def documents(spark, rows):
    """A documents table with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "w", "p") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


TROUBLED = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (None, None), (6, "word " * 60_000), (7, "x" * 200_000)]
