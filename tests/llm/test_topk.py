from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm.topk import best_of_tile, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, scale=64):
    usable = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    found = set()
    for q, a in {r for r in usable if r[0] % 20 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
        found |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return found


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_equals_brute_force(spark, shard_rows):
    draw = np.random.default_rng(5)
    rows = [(i, np.float32(draw.normal(size=4)).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (320, [1.0, 2.0]), (321, [1.0, 2.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)
    found = top_k(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, query_block=5)
    assert {tuple(r) for r in found.collect()} == brute(rows, 20)
    assert found.count() == len(brute(rows, 20))


def test_empty_and_few(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert top_k(frame, "vec_id", "embedding", F.col("vec_id") % 20 == 0).isEmpty()
    one = spark.createDataFrame([(0, [1.0], "s", 1)], SCHEMA)
    assert top_k(one, "vec_id", "embedding", F.col("vec_id") % 20 == 0).isEmpty()


def test_large_components_stay_exact():
    big = 2**29
    ids, shard = np.array([1, 2, 3]), np.array([[big, 1], [big, 2], [-big, 0]], dtype=float)
    found = dict(best_of_tile(np.array([9]), np.array([[big, 1.0]]), ids, shard, 2))
    assert [(h["loss"], h["vec_id"]) for h in found[0]] == [(-(big * big + 2), 2), (-(big * big + 1), 1)]


@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_components_beyond_64_bit_products(spark, shard_rows):
    rows = [(i, [float(i % 7), 2.0**40 + i, -1.0 - i]) for i in range(25)] + [(20 * i, [1.0, -0.5, 2.0 ** (20 * i)]) for i in range(2, 5)]
    rows += [(100, [1e300, 0.0, 0.0]), (101, [-1e300, 1.0, 1.0]), (120, [1.0, 1.0, 1.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows)
    most = 2**63 - 1
    wanted = {(q, n, i, max(-most, min(most, s))) for q, n, i, s in brute(rows, 5)}
    assert {tuple(r) for r in found.collect()} == wanted
