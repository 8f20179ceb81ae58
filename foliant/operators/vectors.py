"""Nearest vectors by cosine, exactly, in tiles of query and row blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and rows in a tile, about.
BLOCK = 4096
#: Lists that are merged at a time.
FAN_IN = 16

_LISTS = "query_id long, shard int, top array<struct<far:double,vec_id:long>>"


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.array(column.tolist(), dtype=np.float64)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar other rows of each query, ties to the smaller id.

    A tile is one matrix product that gives k rows a query, and the tiles'
    lists are merged in a tree, so no pair of rows becomes a row.  Vectors
    without a component, or of another length than the query's, take no part;
    similarities are rounded before they are ranked; a zero vector is similar
    to none (0).
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull())
    )
    asked = vectors.where(is_query).select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") > 0)
    blocks, shards = (max(1, -(-x.count() // block)) for x in (asked, own))
    dim, deal = F.size("v").alias("dim"), lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(dim, deal(blocks).alias("block"), every(shards).alias("shard"), "vec_id", "v")
    right = own.select(dim, every(blocks).alias("block"), deal(shards).alias("shard"), "vec_id", "v")

    def tile(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, unit = rows["vec_id"].to_numpy(), _unit(rows["v"])
            for query_id, near in zip(queries["vec_id"], np.round(_unit(queries["v"]) @ unit.T, digits), strict=True):
                first = [j for j in np.argsort(-near, kind="stable")[: k + int((ids == query_id).sum())] if ids[j] != query_id][:k]
                found.append((query_id, key[2], [{"far": -float(near[j]), "vec_id": int(ids[j])} for j in first]))
        return pd.DataFrame(found, columns=["query_id", "shard", "top"])

    keys = ("dim", "block", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, _LISTS)
    while shards > 1:
        shards = -(-shards // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")).agg(merged.alias("top"))
    hits = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return hits.select("query_id", F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("similarity"), (F.col("at") + 1).alias("rank"))
