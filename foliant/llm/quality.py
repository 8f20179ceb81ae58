"""Quality classifier from weak labels: labellers, expectation-maximisation, hashed scorer.

Eight overlapping heuristic labellers vote low, high or abstain on each text.
A two-class model of their votes (each labeller has its own distribution of
votes in either class, independent given the class) is fitted by
expectation-maximisation on the counts of vote patterns over all documents;
there are at most 3**8 patterns, so only that histogram reaches the driver.
The posterior of a document's pattern is its soft label, and soft labels of a
bounded sample of distinct texts, each of them once however many rows repeat it, train a logistic regression on hashed word and word-shape
features.  The scorer then judges every whole text.

Defined results: a text without a word (null, empty, blank) has score 1, that
is lowest quality; a text is kept if its score is below the threshold, so a
score at it is not; whole texts are read, however long; repeated rows and ids
each get their row; without any text the model is neutral; an empty table gives
no rows; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, text_or_empty, with_text_batches

ABSTAIN, LOW, HIGH = 0, 1, 2
#: Distinct texts with soft labels that the scorer is trained on, at most.
TRAINING_ROWS = 8_000
DIMENSIONS = 1 << 14
THRESHOLD = 0.5
EM_ROUNDS = 200
EPOCHS = 12
#: Bounds of a labeller's rate of low votes, least and most, for the classes high and low.
RATES = (np.array([[1e-4], [0.15]]), np.array([[0.01], [0.98]]))

# Bytes counted as symbols (no part of ordinary prose).
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"!#$%&*<>[\\]^`{|}~")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a") : ord("z") + 1] = True


def _vote(low: bool, high: bool) -> int:
    return LOW if low else HIGH if high else ABSTAIN


def measures(text: str) -> dict[str, float]:
    """What the labellers look at; one pass over the bytes and one over the words."""
    data = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = text.split()
    n, letters = max(1, len(words)), int(count[_UPPER].sum() + count[_LOWER].sum())
    ends = sum(text.count(x) for x in (". ", ", ", ".\n", ",\n", "? ", "; ", ": ")) + (text[-1:] in ".?")
    return {
        "words": len(words),
        "symbols": int(count[_SYMBOLS].sum()) / max(1, len(data)),
        "letters": letters,
        "upper": int(count[_UPPER].sum()) / max(1, letters),
        "shouts": int(count[ord("!")]) / n,
        "bars": int(count[ord("|")]) / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "ends": ends / n,
        "length": sum(map(len, words)) / n,
    }


def votes(text: str) -> str:
    """The labellers' votes, a digit each."""
    m = measures(text)
    n = m["words"]
    given = (
        _vote(m["symbols"] > 0.04, m["symbols"] < 0.01),
        ABSTAIN if m["letters"] < 20 else _vote(m["upper"] > 0.5, m["upper"] < 0.15),
        _vote(m["shouts"] > 0.3, m["shouts"] < 0.05),
        _vote(m["bars"] > 0.1, m["bars"] == 0),
        ABSTAIN if n < 10 else _vote(m["repeats"] > 0.2, m["repeats"] < 0.1),
        ABSTAIN if n < 30 or n > 3000 else _vote(m["distinct"] < 0.35, m["distinct"] > 0.5),
        ABSTAIN if n < 20 else _vote(m["ends"] < 0.04, 0.06 < m["ends"] < 0.4),
        ABSTAIN if n < 5 else _vote(m["length"] < 2.5 or m["length"] > 12, 3.5 < m["length"] < 8),
    )
    return "".join(map(str, given))


@dataclass(frozen=True)
class LabelModel:
    """low: share of low-quality texts; alarm[class, labeller]: how often a vote is low, of the classes high, low."""

    low: float
    alarm: np.ndarray

    def posterior(self, pattern: str) -> float:
        """Probability of low quality."""
        cast = np.frombuffer(pattern.encode(), dtype=np.uint8) - ord("0")
        return float(_posterior(self.low, self.alarm, cast[None, :])[0])


def _posterior(low: float, alarm: np.ndarray, cast: np.ndarray) -> np.ndarray:
    chance = np.where(cast == LOW, np.log(alarm)[:, None], np.where(cast == HIGH, np.log1p(-alarm)[:, None], 0.0))
    odds = chance.sum(axis=2)
    return 1 / (1 + np.exp(np.clip(odds[0] - odds[1] + np.log1p(-low) - np.log(low), -500, 500)))


def fit_label_model(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation of the labellers' accuracies on vote-pattern counts.

    An abstention says nothing of the class.  A labeller looks for one kind of
    junk, so most low-quality texts may pass it, but it seldom cries low on a
    good one; the bounds on the two rates keep the classes to that meaning.
    """
    size = len(next(iter(patterns), "0" * 8))
    low, alarm = 0.2, np.repeat(np.array([[0.005], [0.4]]), size, axis=1)
    if not patterns:
        return LabelModel(low, alarm)
    cast = np.array([list(map(int, p)) for p in patterns])
    weight = np.array(list(patterns.values()), dtype=float)
    for _ in range(rounds):
        share = _posterior(low, alarm, cast) * weight
        low = float(np.clip((share.sum() + 1) / (weight.sum() + 2), 0.01, 0.6))
        each = np.stack([weight - share, share])
        cried, cast_any = each @ (cast == LOW), each @ (cast != ABSTAIN)
        alarm = np.clip((cried + 1) / (cast_any + 2), *RATES)
    return LabelModel(low, alarm)


def _shape(word: str) -> str:
    """The word's character classes, runs collapsed."""
    shape = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return "".join(shape)


def features(text: str, places: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's hashed features; values are shares of its words.

    ``places`` remembers the indices of words seen before.
    """
    words = text.split()
    n = max(1, len(words))
    index, value = [0, 1], [1.0, sum(map(eq, words, words[1:])) / n]  # bias, share of repeated words
    if len(places) > 150_000:
        places.clear()
    for word, count in Counter(words).items():
        at = places.get(word)
        if at is None:
            room = DIMENSIONS // 2
            at = places[word] = (
                2 + zlib.crc32(_shape(word).encode("utf-8", "replace")) % (room - 2),
                room + zlib.crc32(word.lower().encode("utf-8", "replace")) % room,
            )
        index += at
        value += (count / n, count / n)
    return np.array(index, dtype=np.int32), np.array(value, dtype=np.float32)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic regression on soft labels (adaptive gradient steps, fixed order)."""
    weights, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    # Words weigh less than shapes, which carry over to unseen texts.
    scale = np.where(np.arange(DIMENSIONS) < DIMENSIONS // 2, 1.0, 0.2)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            index, value, label = rows[i]
            value = value * scale[index]
            z = float(np.clip(weights[index] @ value, -30, 30))
            slope = (1 / (1 + np.exp(-z)) - label) * value
            np.add.at(seen, index, slope**2)
            np.add.at(weights, index, -0.5 * slope / np.sqrt(seen[index]))
    return weights * scale


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def judge(self, text: Column) -> Column:
        """struct(votes, posterior, score): probabilities of low quality."""
        labels, weights = self.labels, self.weights

        @F.pandas_udf("votes string, posterior double, score double")
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            places: dict[str, tuple[int, int]] = {}
            known: dict[str, float] = {}
            for texts in batches:
                rows = []
                for value in texts:
                    whole = value if isinstance(value, str) else ""
                    pattern = votes(whole)
                    if pattern not in known:
                        known[pattern] = labels.posterior(pattern)
                    rows.append((pattern, known[pattern], self_score(whole, weights, places)))
                yield pd.DataFrame(rows, columns=["votes", "posterior", "score"])

        return judged(text)

    def score(self, text: Column) -> Column:
        """Probability of low quality."""
        weights = self.weights

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            places: dict[str, tuple[int, int]] = {}
            for texts in batches:
                yield pd.Series([self_score(x if isinstance(x, str) else "", weights, places) for x in texts], dtype=float)

        return scored(text)


def self_score(text: str, weights: np.ndarray, places: dict[str, tuple[int, int]]) -> float:
    if not text or text.isspace():
        return 1.0
    index, value = features(text, places)
    return float(1 / (1 + np.exp(-np.clip(weights[index] @ value, -30, 30))))


def _sample(text: DataFrame, most: int) -> DataFrame:
    """The distinct texts with the smallest hashes, ``most`` at most: the same ones for any order and partitions of the rows."""
    hashes = text.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(most)
    last = hashes.agg(F.max("h").alias("h")).first()["h"]
    return text.where(F.xxhash64("text") <= F.lit(last)).distinct()


def fit_quality(documents: DataFrame, text_col: str = "text", training_rows: int = TRAINING_ROWS) -> QualityModel:
    """Label model from the votes on all documents, scorer from a sample of at most ``training_rows`` distinct texts."""

    @F.pandas_udf("string")
    def voted(texts: pd.Series) -> pd.Series:
        return texts.map(votes)

    text = with_text_batches(documents).select(text_or_empty(text_col).alias("text")).where(F.trim("text") != "")
    patterns = text.select(voted("text").alias("votes")).groupBy("votes").agg(F.count("*").alias("n")).collect()
    histogram = {r["votes"]: int(r["n"]) for r in sorted(patterns, key=lambda r: r["votes"])}
    labels = fit_label_model(histogram)

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[str, tuple[int, int]] = {}
        for batch in batches:
            found = [features(x, places) for x in batch["text"]]
            yield pd.DataFrame(
                {
                    "i": [i.tobytes() for i, _ in found],
                    "v": [v.tobytes() for _, v in found],
                    "p": [labels.posterior(votes(x)) for x in batch["text"]],
                }
            )

    sample = _sample(text, training_rows)
    rows = sample.mapInPandas(sampled, "i binary, v binary, p double").collect()
    data = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32), r["p"]) for r in rows]
    data.sort(key=lambda r: (r[0].tobytes(), r[1].tobytes()))
    return QualityModel(labels, train_scorer(data))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents)
    judged = documents.select("doc_id", model.judge(text_or_empty("text")).alias("j"))
    return judged.select("doc_id", "j.votes", "j.posterior", "j.score", (F.col("j.score") < THRESHOLD).alias("keep"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict = {}
