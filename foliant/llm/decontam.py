"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every run of four words of an item is a seed if few items hold it; a run that
more than ``SHARED`` items hold grows by the words after it until so few do, so a
template's phrases seed nothing by themselves and a text brings at most
``SHARED`` items for each of its places.  An item whose runs all stay common is
seeded by its whole text.  Items with equal words are one.

One scan of the corpus finds where seeds occur.  Nearby hits of one item become
a passage, and every passage is a candidate, however many documents hold its
seeds: a seed that many hold may be an item's copies themselves.  Equal passages
of a batch are aligned once, and a passage whose words cannot reach the
threshold in any order is not aligned, so phrases that are frequent in the
corpus cost little.  Each other candidate is aligned with its item word by word
(local alignment, linear gaps); the score is the share of the best possible
score of the item, so edited and paraphrased copies score by how much of the
item they keep.

The item side is shipped to the tasks in groups of at most ``GROUP_WORDS``
words; a larger benchmark takes one scan for each group.  Passages are shipped
as ids of the items' own words.

Defined results
* words are runs of letters, digits and underscores, lower-cased; null texts
  are empty; whole texts are read, however long; items of fewer than
  ``SEED_WORDS`` words hold no seed and match nothing, as do copies without a
  seed of the item; empty tables give no rows;
* one row per (doc_id, item_id): rows that repeat either id give one row, the
  best; of equal scores the passage that begins first counts; ids may be null
  and of any type; other columns are not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, text_or_empty, with_text_batches, written

SEED_WORDS = 4
#: Distinct items that hold a seed, at most, and words to which a common run grows.
SHARED = 32
LONGEST_SEED = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's best possible score from which a document is contaminated.
THRESHOLD = 0.6
#: Words of benchmark items that one scan ships to its tasks, at most (an item's own length aside).
GROUP_WORDS = 1_000_000
#: Passages aligned at a time.
BATCH = 512
BATCH_WORDS = 1 << 20

_WORD = re.compile(r"\w+")
_SCORE_SCHEMA = "doc_id string, item_id string, score double, begin int, length int"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Items:
    """A group of benchmark items with distinct words: vocabulary, word ids and sorted seeds by length."""

    def __init__(self, rows: list[tuple[str | None, str]], shared: int = SHARED):
        own: dict[tuple[str, ...], list[str | None]] = {}
        for item_id, text in rows:
            own.setdefault(tuple(words_of(text)), []).append(item_id)
        self.ids = [list(dict.fromkeys(x)) for x in own.values()]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int32) for words in own]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.seeds = {length: _sorted_seeds(*x) for length, x in _rare_runs(self.words, self.sizes, shared).items()}

    def passages(self, text: str) -> Iterator[tuple[int, int, bytes]]:
        """(item, first word, word ids) of each stretch of a text around hits of one item."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words_of(text)], dtype=np.int32)
        found = list(self._hits(ids))
        if not found:
            return
        where, owner, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((where, owner))
        where, owner, place = where[order], owner[order], place[order]
        size = self.sizes[owner]
        breaks = np.flatnonzero((owner[1:] != owner[:-1]) | (where[1:] - where[:-1] > size[1:])) + 1
        for part in np.split(np.arange(len(where)), breaks):
            item, n = int(owner[part[0]]), int(size[part[0]])
            slack = n // 2 + 1
            begin = max(0, int((where[part] - place[part]).min()) - slack)
            end = min(len(ids), int((where[part] - place[part]).max()) + n + slack)
            yield item, begin, ids[begin:end].tobytes()

    def _hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, item, place in the item) of equal seeds, for each length."""
        keys, unknown = np.zeros(len(ids), dtype=np.uint64), np.cumsum(np.append(0, ids < 0))
        for length in range(1, max(self.seeds, default=0) + 1):
            if len(ids) < length:
                return
            keys = _grown(keys[: len(ids) - length + 1], ids[length - 1 :])
            if length not in self.seeds:
                continue
            distinct, first, owners, places = self.seeds[length]
            known = np.flatnonzero(unknown[length:] == unknown[:-length])
            at = np.searchsorted(distinct, keys[known])
            hit = distinct[np.minimum(at, len(distinct) - 1)] == keys[known]
            known, at = known[hit], at[hit]
            if not len(known):
                continue
            begin, many = first[at], first[at + 1] - first[at]
            where = np.repeat(known, many)
            slot = np.repeat(begin, many) + np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
            yield where, owners[slot], places[slot]

    def bound(self, item: int, words: np.ndarray) -> float:
        """What the passage's score is at most: the share of the item's words that it holds, in any order."""
        own, wanted = self.counts[item]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        held = np.bincount(at[own[at] == words], minlength=len(own))
        return np.minimum(held, wanted).sum() / wanted.sum()


def _grown(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """64-bit keys of runs of word ids with a further word each (alignment decides, so a collision does no harm)."""
    return keys * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.int64).astype(np.uint64) + np.uint64(1)


def _rare_runs(words: list[np.ndarray], sizes: np.ndarray, shared: int) -> dict[int, tuple[np.ndarray, ...]]:
    """(keys, items, places) of the seeds by their length: the shortest run at each place that at most ``shared`` items hold."""
    flat = np.concatenate([np.zeros(0, np.int32), *words])
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    keys = np.zeros(len(flat), dtype=np.uint64)
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    seeded = np.zeros(len(words), dtype=bool)
    for length in range(1, LONGEST_SEED + 1):
        fits = place + length <= sizes[owner]
        owner, place, keys = owner[fits], place[fits], keys[fits]
        keys = _grown(keys, flat[starts[owner] + place + length - 1])
        if length < SEED_WORDS or not len(keys):
            continue
        held = np.unique(np.stack([keys, owner.astype(np.uint64)]), axis=1)[0]  # once for each item
        distinct, holders = np.unique(held, return_counts=True)
        rare = holders[np.searchsorted(distinct, keys)] <= shared
        if rare.any():
            found[length] = [(keys[rare], owner[rare], place[rare])]
            seeded[owner[rare]] = True
        owner, place, keys = owner[~rare], place[~rare], keys[~rare]
    for item in np.flatnonzero(~seeded & (sizes >= SEED_WORDS)).tolist():
        key = np.zeros(1, dtype=np.uint64)
        for word in words[item]:
            key = _grown(key, word.reshape(1))
        found.setdefault(int(sizes[item]), []).append((key, np.array([item]), np.zeros(1, dtype=np.int64)))
    return {length: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for length, parts in found.items()}


def _sorted_seeds(keys: np.ndarray, owners: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, where the rows of each begin, items, places), by key."""
    order = np.argsort(keys, kind="stable")
    distinct, first = np.unique(keys[order], return_index=True)
    return distinct, np.append(first, len(keys)), owners[order].astype(np.int32), places[order].astype(np.int32)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each (item, passage) pair.

    A row of the dynamic program is computed for all pairs at once; the run of
    gaps along a row is a running maximum.
    """
    n, m = max(map(len, items)), max(map(len, passages))
    left = np.full((len(items), n), -2, dtype=np.int32)
    right = np.full((len(items), m), -1, dtype=np.int32)
    for i, (a, b) in enumerate(zip(items, passages, strict=True)):
        left[i, : len(a)], right[i, : len(b)] = a, b
    slope = -GAP * np.arange(m + 1, dtype=np.int32)
    above = np.zeros((len(items), m + 1), dtype=np.int32)
    best = np.zeros(len(items), dtype=np.int32)
    for row in range(n):
        score = np.where(right == left[:, row : row + 1], MATCH, MISMATCH)
        now = np.zeros_like(above)
        np.maximum(above[:, :-1] + score, above[:, 1:] + GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        np.maximum(best, now.max(axis=1), out=best)
        above = now
    return best


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """(id, item_id, score, begin, length): documents that hold a benchmark item, and where."""
    found = None
    for items in _groups(benchmark, item_col, item_text_col, group_words):
        one = _scan(documents, items, id_col, text_col, threshold)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max_by(F.struct("begin", "length"), F.struct("score", -F.col("begin"))).alias("at")
    ).select(
        F.col("doc_id").cast(documents.schema[id_col].dataType).alias(id_col),
        F.col("item_id").cast(benchmark.schema[item_col].dataType).alias("item_id"),
        "score",
        F.col("at.begin").alias("begin"),
        F.col("at.length").alias("length"),
    )


def without_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """The documents that hold no benchmark item, judged where they are read: texts are not shuffled."""
    documents = with_text_batches(documents)
    for items in _groups(benchmark, item_col, item_text_col, group_words):
        shared = documents.sparkSession.sparkContext.broadcast(items)  # at most GROUP_WORDS words and one item
        documents = documents.where(~_holds_an_item(shared, threshold)(text_or_empty(text_col)))
    return documents


def _holds_an_item(shared: Broadcast, threshold: float) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        held = np.zeros(len(texts), dtype=bool)
        for found in _matches(shared.value, range(len(texts)), texts, threshold):
            held[found["doc_id"].to_numpy(int)] = True
        return pd.Series(held)

    return holds


def _groups(benchmark: DataFrame, item_col: str, item_text_col: str, group_words: int) -> Iterator[Items]:
    """The benchmark's items in groups of about so many words, at least one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), text_or_empty(item_text_col).alias("text"))
    size = items.select(F.sum(F.length("text") / 2 + 1).alias("words")).first()["words"] or 0  # a word has 2 characters, or 1 and a space
    groups = max(1, int(-(-size // group_words)))
    keyed = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(groups)))
    for part in range(groups):
        yield Items([(r["item_id"], r["text"]) for r in keyed.where(F.col("part") == part).orderBy("item_id", "text").collect()])


def _scan(documents: DataFrame, items: Items, id_col: str, text_col: str, threshold: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)  # at most GROUP_WORDS words and one item

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for out in _matches(own, batch["doc_id"], batch["text"], threshold):
                out["item_id"] = [own.ids[i] for i in out["item"]]
                yield out[["doc_id", "item_id", "score", "begin", "length"]].explode("item_id")

    texts = with_text_batches(documents).select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return written(texts.mapInPandas(score, _SCORE_SCHEMA), "contaminated")


def _matches(own: Items, keys: Iterable, texts: Iterable[str], threshold: float) -> Iterator[pd.DataFrame]:
    """(doc_id, item, words, begin, size, score, length) of the texts' passages that reach the threshold."""
    rows = [(key, *passage) for key, text in zip(keys, texts, strict=True) for passage in own.passages(text)]
    hits = pd.DataFrame(rows, columns=["doc_id", "item", "begin", "words"])
    once = hits[["item", "words"]].drop_duplicates()
    able = [own.bound(item, np.frombuffer(x, dtype=np.int32)) >= threshold for item, x in zip(once["item"], once["words"], strict=True)]
    # Like lengths together, so that little is padding.
    once = once[np.array(able, dtype=bool)].assign(size=lambda x: x["words"].map(len)).sort_values("size", kind="stable")
    for part in _parts(once):
        left = [own.words[i] for i in part["item"]]
        right = [np.frombuffer(x, dtype=np.int32) for x in part["words"]]
        share = align(left, right) / (MATCH * np.array([len(x) for x in left]))
        out = hits.merge(part.assign(score=share, length=[len(x) for x in right])[share >= threshold], on=["item", "words"])
        if len(out):
            yield out


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of at most BATCH passages and about BATCH_WORDS words, or one passage."""
    begin = 0
    for end in range(1, len(batch) + 1):
        longest = batch["size"].iat[min(end, len(batch) - 1)] // 4
        if end == len(batch) or end - begin >= BATCH or (end - begin + 1) * longest > BATCH_WORDS:
            yield batch.iloc[begin:end]
            begin = end


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
ORACLES: dict = {}
