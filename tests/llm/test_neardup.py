from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from foliant.llm.neardup import _unmet, depth_for, near_duplicates
from tests.llm.helpers import TROUBLED, documents, prose


def brute(rows, threshold=0.8):
    """{row: (class id, copy id, copies, links)} by comparing all pairs."""

    def shingles(text):
        words = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()

    classes = defaultdict(list)
    for key, text in rows:
        classes[shingles(text)].append(key)
    sets = list(classes)
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i].add(j)
                links[j].add(i)
    part = list(range(len(sets)))
    for _ in sets:
        for i in links:
            part[i] = min([part[i], *(part[j] for j in links[i])])
    first = {}
    for i, s in enumerate(sets):
        first[part[i]] = min([first.get(part[i], 10**9), *(k for k in classes[s] if k is not None)])
    return sorted((k if k is not None else -1, first[part[i]], min(x for x in classes[s] if x is not None), len(classes[s]) - 1, len(links[i])) for i, s in enumerate(sets) for k in classes[s])


def edited(text, seed, edits):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out, key = [], 10
    base = [prose(i, 150) for i in range(6)]
    for n, text in enumerate(base):  # groups of near copies around the threshold, one of them large
        for i in range(60 if n == 0 else 8):
            out.append((key, edited(text, key, 1 + (i * (n + 1)) % 5)))
            key += 1
    shared = prose(99, 60)  # a passage that many otherwise different texts hold
    for i in range(40):
        out.append((key, prose(1000 + i, 60) + " " + shared + " " + prose(2000 + i, 60)))
        key += 1
    for i in range(30):
        out.append((key, base[1] if i % 2 else base[1].upper() + " !"))
        key += 1
    return out + [(i, t) for i, t in TROUBLED if i is not None]


@pytest.mark.parametrize("partitions", [2, 9])
def test_equals_brute_force(spark, rows, partitions):
    found = near_duplicates(documents(spark, rows).repartition(partitions))
    own = sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found.collect())
    assert own == brute(rows)


@pytest.mark.parametrize("size", [3, 30, 60])
def test_a_chain_without_a_centre_equals_brute_force(spark, size):
    words = prose(4242, 1300).split()
    chain = [(i, " ".join(words[16 * i : 16 * i + 200])) for i in range(size)]  # neighbours share 180 of 212 shingles
    wanted = brute(chain)
    assert {r[1] for r in wanted} == {0} and {r[4] for r in wanted} == {1, 2}
    found = near_duplicates(documents(spark, chain))
    assert sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found.collect()) == wanted


def test_overlapping_windows_equal_brute_force(spark):
    words = prose(77, 1000).split()
    chain = [(i, " ".join(words[5 * i : 5 * i + 200])) for i in range(60)]  # each linked to several on either side
    found = near_duplicates(documents(spark, chain))
    assert sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found.collect()) == brute(chain)


def test_nodes_across_many_ranges_equal_brute_force(spark, rows):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "70")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = near_duplicates(documents(spark, rows)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found) == brute(rows)


def test_recall_on_the_small_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(table).collect()
    own = sorted((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in found)
    assert own == brute([tuple(r) for r in table.collect()])


def test_done_classes_are_not_looked_up_again(spark):
    classes = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (b"d",)], "class binary")
    facts = spark.createDataFrame([(b"a", b"b", 0.01, True), (b"a", b"c", 0.02, True), (b"d", b"a", 0.5, False)], "a binary, b binary, distance double, linked boolean")
    left = lambda depth: {bytes(r[0]) for r in _unmet(classes, facts, 0.8, depth, 32, 0.999).collect()}
    assert left(8) == {b"b", b"c", b"d"}  # two close links make the unseen partner weigh little
    assert left(7) == set()


def test_troubled_rows(spark):
    found = near_duplicates(documents(spark, TROUBLED)).collect()
    assert len(found) == len(TROUBLED)
    assert all(r["n_links"] == 0 for r in found)
    assert {r["class_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert near_duplicates(documents(spark, [])).isEmpty()


def test_depth_follows_the_target():
    assert depth_for(0.8, 32, 8, 0.999) == 7
    assert depth_for(0.8, 16, 8, 0.9995) == 4
    assert depth_for(0.8, 1, 8, 0.9999) == 1
