"""Exact top-k inner-product search by tiled matrix products.

Queries and candidates are dealt into blocks; every (query block, candidate
shard) tile is one small matrix product whose best k per query are selected at
once, so a tile returns k rows a query however large the shard is.  The lists
of the tiles are then merged in a tree with a fixed fan-in.

Every tile holds at most about ``query_block`` by ``shard_rows`` vectors, and
the product runs over slices of it, so memory does not grow with the input.
The number of tiles grows with queries times shards, as an exact search must.

Defined results
* a vector that is null, empty, or holds a null or non-finite component takes
  no part, neither as a query nor as a candidate; nor does a row without id;
* only vectors of equal length are compared;
* a query is never answered with rows of its own id; other rows that repeat
  each other are each a candidate of their own, while repeated query rows
  (same id and same vector) are answered once;
* equal scores are ordered by the smaller id; a query with fewer than k
  candidates gets all of them; empty tables give no rows;
* any finite component takes part.  Vectors with components too large for 64-bit
  products are multiplied as whole numbers of any size; a score beyond 64 bits
  is ranked by its size (as a double) and given as the nearest 64-bit number;
* other columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from math import isqrt
from sys import float_info

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table

QUERY_BLOCK = 8192
SHARD_ROWS = 8192
FAN_IN = 16
#: Rows of a tile's query side that are multiplied at a time.
SLICE = 256

#: Up to here every whole number is a double.
EXACT = 2**53
LARGEST = 2**63 - 1

_TILE_SCHEMA = "query_id long, vkey long, shard int, top array<struct<wide:double,loss:long,vec_id:long>>"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): the usable vectors with components floor(scale * x), as doubles that hold whole numbers."""
    x = F.col(vec_col).cast("array<double>")
    usable = (
        F.col(id_col).isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    top = F.lit(float_info.max)
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(F.least(F.greatest(c, -top), top))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c * scale)).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _hit(score: int, vec_id: int) -> dict:
    try:
        wide = -float(score)
    except OverflowError:
        wide = -np.inf if score > 0 else np.inf
    return {"wide": wide, "loss": -max(-LARGEST, min(LARGEST, score)), "vec_id": vec_id}


def best_of_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int
) -> Iterator[tuple[int, list[dict]]]:
    """For each query its k best hits (-score, id) of a shard, exactly."""
    order = np.argsort(ids, kind="stable")
    ids, shard = ids[order], shard[order]
    most = isqrt(2**62 // shard.shape[1])
    small, fits = (np.abs(x).max(axis=1) <= most for x in (queries, shard))
    others = np.flatnonzero(~fits)
    large = _whole(shard[others])
    found = _best_of_small(query_ids[small], queries[small].astype(np.int64), ids[fits], shard[fits].astype(np.int64), k)
    for i, few in zip(np.flatnonzero(small).tolist(), found, strict=True):
        if len(others):
            scores = large @ _whole(queries[i : i + 1])[0]
            few = _first(few + [(int(s), int(ids[j])) for s, j in zip(scores, others, strict=True) if ids[j] != query_ids[i]], k)
        yield i, [_hit(*x) for x in few]
    if not small.all():
        whole = _whole(shard)
        for i in np.flatnonzero(~small).tolist():
            scores = whole @ _whole(queries[i : i + 1])[0]
            yield i, [_hit(*x) for x in _first([(int(s), int(j)) for s, j in zip(scores, ids, strict=True) if j != query_ids[i]], k)]


def _whole(rows: np.ndarray) -> np.ndarray:
    """Whole numbers of any size."""
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def _first(hits: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return nsmallest(k, hits, key=lambda x: (-x[0], x[1]))


def _best_of_small(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
    """For each query its k best (score, id); products fit into 64 bits and ``ids`` are sorted."""
    n = len(ids)
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(shard).max(initial=0)) * shard.shape[1]
    # A double holds (score, position) as one exact number while this bound is kept.
    packed = bound * n + n < EXACT
    dense = shard.T.astype(np.float64) if packed else shard.T
    position = np.arange(n - 1, -1, -1)
    for at in range(0, len(queries), SLICE):
        part = queries[at : at + SLICE]
        scores = (part.astype(np.float64) if packed else part) @ dense
        first, last = (np.searchsorted(ids, query_ids[at : at + SLICE], side) for side in ("left", "right"))
        for i, row in enumerate(scores):
            lo, hi = first[i], last[i]
            if packed:
                key = row * n + position
                key[lo:hi] = -np.inf
                few = np.argpartition(key, n - k)[n - k :] if n > k else np.arange(n)
                few = few[np.argsort(-key[few], kind="stable")]
            else:
                few = np.lexsort((ids, -row))[: k + hi - lo]
            yield [(int(row[j]), int(ids[j])) for j in few if not lo <= j < hi][:k]


def top_k(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    query_block: int = QUERY_BLOCK,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products."""
    whole = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(vectors.where(is_query), id_col, vec_col, scale).distinct()
    blocks = max(1, -(-asked.count() // query_block))
    shards = max(1, -(-whole.count() // shard_rows))
    dim = F.size("v").alias("dim")
    left = asked.select(
        dim,
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        "vec_id",
        F.xxhash64("v").alias("vkey"),
        "v",
    )
    right = whole.select(
        dim,
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        # Rows that repeat an id are spread as well.
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() % 64), F.lit(shards)).cast("int").alias("shard"),
        "vec_id",
        "v",
    )

    def tile(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(shard):
            query_ids = queries["vec_id"].to_numpy(np.int64)
            vkeys = queries["vkey"].to_numpy(np.int64)
            ids = shard["vec_id"].to_numpy(np.int64)
            for i, top in best_of_tile(query_ids, _matrix(queries["v"]), ids, _matrix(shard["v"]), k):
                if top:
                    rows.append((int(query_ids[i]), int(vkeys[i]), int(key[2]), top))
        return pd.DataFrame(rows, columns=["query_id", "vkey", "shard", "top"])

    keys = ("dim", "block", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, _TILE_SCHEMA)
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = (
            lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
            .groupBy("query_id", "vkey", "shard")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        )
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.loss")).alias("score"),
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES = {"op7_exact_topk": op7_exact_topk}

ORACLES = {
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""
}
