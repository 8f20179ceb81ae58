"""Embedding providers: texts to vectors, distinct texts only.

``hashing`` is the built-in default (token counts by hash bucket), ``tfidf``
weighs tokens by rarity, ``precomputed`` joins stored vectors and
``transformer`` runs a sentence model where its library is installed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5
from math import sqrt

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import DEFAULT, EngineConfig
from foliant.functions.text import words
from foliant.sources.work import written


def buckets(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """The hash bucket of each word of the text's beginning (what the model would read)."""
    head = F.lower(F.substring(text, 1, config.embedded_characters))
    return F.transform(words(head), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % config.dimensions)


def hashing(text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Counts of the buckets as a vector; zero for an empty text."""
    own = buckets(F.coalesce(text, F.lit("")), config)
    return F.transform(F.sequence(F.lit(0), F.lit(config.dimensions - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("double"))


def similarity(own: Column, text: str, config: EngineConfig = DEFAULT) -> Column:
    """Cosine of hashed texts, from the buckets of one and the other's text; equal to that of their vectors.

    The product looks each word up in the other's counts, and the squared norm
    grows by 2n + 1 with the n-th repeat in sorted buckets, so no vector is built.
    """
    counts = [0] * config.dimensions
    for word in text[: config.embedded_characters].lower().split():
        counts[int(md5(word.encode()).hexdigest()[:8], 16) % config.dimensions] += 1
    norm = sqrt(sum(c * c for c in counts))
    if not norm:
        return F.lit(0.0)
    table = F.array(*map(F.lit, counts))
    product = F.aggregate(own, F.lit(0).cast("long"), lambda t, b: t + F.get(table, b.cast("int")))
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(state: Column, b: Column) -> Column:
        run = F.when(state["last"] == b, state["run"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(b.alias("last"), run.alias("run"), (state["total"] + 2 * run + 1).alias("total"))

    own_norm = F.sqrt(F.aggregate(F.array_sort(own), start, step, lambda state: state["total"]).cast("double"))
    return F.when(F.size(own) > 0, product / (own_norm * norm)).otherwise(F.lit(0.0))


def tfidf_similarity(texts: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """(id, similarity): weighted cosine of each text with a query text.

    The counts of (text, token) are made once and written; their norms and
    products come from one aggregate, as the query's few weights are constants.
    """
    tokens = texts.select(F.col(id_col).alias("id"), F.explode(words(F.lower(F.col(text_col)))).alias("token"))
    counts = written(tokens.groupBy("id", "token").agg(F.count("*").alias("tf")), "tfidf-counts")
    n = texts.count()
    weights = counts.groupBy("token").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    asked = Counter(query.lower().split())
    found = {r["token"]: r["idf"] for r in weights.where(F.col("token").isin(*asked)).collect()}  # the query's words only
    scaled = {token: asked[token] * idf for token, idf in found.items()}
    query_norm = sqrt(sum(w * w for w in scaled.values()))
    own = F.lit(0.0)
    for token, weight in sorted(scaled.items()):
        own = F.when(F.col("token") == token, F.lit(weight)).otherwise(own)
    weighed = counts.join(weights, "token").select("id", (F.col("tf") * F.col("idf")).alias("w"), own.alias("qw"))
    sums = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("qw")).alias("product"))
    return sums.where("product > 0").select(F.col("id").alias(id_col), (F.col("product") / (F.col("norm") * F.lit(query_norm))).alias("similarity"))


def precomputed(rows: DataFrame, id_col: str, vectors: DataFrame, vector_id: str, vector_col: str) -> DataFrame:
    """``rows`` with the stored vector of their id; null where there is none."""
    stored = vectors.select(F.col(vector_id).alias(id_col), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.join(stored, id_col, "left")


#: Models of this Python worker by name: each is loaded once for all of the worker's tasks.
_LOADED = "_foliant_models"


def worker_model(model: str, load: Callable[[str], object]) -> object:
    """The model of this worker, loaded at its first use."""
    kept = pyspark.__dict__.setdefault(_LOADED, {})
    if model not in kept:
        kept[model] = load(model)
    return kept[model]


def sentence_model(model: str) -> object:
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(model)


def transformer(texts: DataFrame, text_col: str, model: str, batch_rows: int = 64, load: Callable[[str], object] = sentence_model) -> DataFrame:
    """``texts`` with vectors of a sentence model; each distinct text is encoded once."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = worker_model(model, load)
        for batch in batches:
            yield pd.Series(loaded.encode(batch.tolist(), batch_size=batch_rows).astype(float).tolist())

    head = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, DEFAULT.embedded_characters)
    keyed = texts.withColumn("_head", head)
    vectors = keyed.select("_head").distinct().withColumn("embedding", encode("_head"))
    return keyed.join(vectors, "_head").drop("_head")


def embedded(texts: DataFrame, text_col: str, config: EngineConfig = DEFAULT, load: Callable[[str], object] = sentence_model) -> DataFrame:
    """``texts`` with vectors of the provider that the configuration names: ``hashing``, or the path of a sentence model."""
    if config.embedding_model_path in ("", "hashing"):
        return texts.withColumn("embedding", hashing(F.col(text_col), config))
    return transformer(texts, text_col, config.embedding_model_path, load=load)


PROVIDERS = {"hashing": hashing, "tfidf": tfidf_similarity, "precomputed": precomputed, "transformer": transformer}
