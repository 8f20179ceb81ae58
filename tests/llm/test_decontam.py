from __future__ import annotations

import random
import re

import numpy as np

from foliant.llm.decontam import GAP, MATCH, MISMATCH, Items, align, find_contamination, without_contamination
from tests.llm.helpers import TROUBLED, documents, prose


def smith_waterman(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = MATCH if a[i - 1] == b[j - 1] else MISMATCH
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] + GAP, table[i, j - 1] + GAP)
    return table.max()


def test_alignment_equals_the_recurrence():
    draw = np.random.default_rng(2)
    items = [draw.integers(0, 6, n).astype(np.int32) for n in (1, 5, 12, 20, 30)]
    passages = [draw.integers(-1, 6, n).astype(np.int32) for n in (4, 9, 40, 1, 33)]
    assert align(items, passages).tolist() == [smith_waterman(a, b) for a, b in zip(items, passages)]


def items():
    return [(i, prose(500 + i, 30)) for i in range(12)]


def test_planted_copies_are_found_and_clean_texts_left(spark):
    draw, own = random.Random(1), dict(items())
    rows, wanted = [], set()
    for i in range(12):
        words = own[i].rstrip(".").split()
        rows.append((i, prose(i, 200) + " " + own[i].upper() + " " + prose(50 + i, 200)))  # exact but for case
        wanted.add((i, i))
        for k in draw.sample(range(len(words)), 4):  # four words replaced, two inserted
            words[k] = "other"
        words[10:10] = ["in", "between"]
        rows.append((100 + i, prose(80 + i, 100) + " " + " ".join(words)))
        wanted.add((100 + i, i))
        rows.append((200 + i, prose(900 + i, 300) + " " + " ".join(own[i].split()[:6])))  # six words of it only
    # An item that most documents hold is no less a leak.
    rows += [(300 + i, prose(3000 + i, 40) + " " + own[3] + " tail") for i in range(60)]
    wanted |= {(300 + i, 3) for i in range(60)}
    benchmark = spark.createDataFrame([(*r, "x") for r in items() + [(90, None), (91, "too short"), (None, prose(7777, 20))]], "item_id long, text string, begin string")
    found = find_contamination(documents(spark, rows + TROUBLED), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted
    assert all(r["score"] == 1.0 for r in found.where("doc_id < 100").collect())
    # A benchmark in several groups gives the same rows.
    grouped = find_contamination(documents(spark, rows), benchmark, group_words=100)
    assert {(r["doc_id"], r["item_id"]) for r in grouped.collect()} == wanted


def test_edited_copies_with_one_seed_are_found_in_any_number(spark):
    words = [f"own{i}" for i in range(15)]
    edited = " ".join("other" if i in (4, 8, 12) else w for i, w in enumerate(words))  # one run of four is left
    phrase = " ".join(words[:4])
    rows = [(i, prose(i, 60) + " " + edited + " " + prose(9000 + i, 60)) for i in range(40)]
    rows += [(100 + i, edited) for i in range(20)] + [(200 + i, prose(i, 60) + " " + phrase) for i in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = find_contamination(documents(spark, rows), benchmark).collect()
    assert sorted((r["doc_id"], r["score"]) for r in found) == [(i, 0.7) for i in [*range(40), *range(100, 120)]]


def test_the_bound_is_never_below_the_score():
    draw = np.random.default_rng(5)
    for _ in range(200):
        item, passage = (draw.integers(0, 8, draw.integers(4, 30)) for _ in range(2))
        own = Items([(0, " ".join(f"w{x}" for x in item))])
        ids = np.array([own.vocabulary.get(f"w{x}", -1) for x in passage], dtype=np.int32)
        assert own.bound(0, ids) >= align([own.words[0]], [ids])[0] / (MATCH * len(item))


def test_equals_aligning_every_document_with_every_item(spark):
    """All pairs that share a run of four words, and nine tenths of all pairs at the threshold at least."""
    draw, own = random.Random(3), [prose(500 + i, draw_size) for i, draw_size in enumerate((15, 20, 30, 45, 60, 80))]
    rows = []
    for key in range(90):
        words = own[key % 6].rstrip(".").split()
        for at in draw.sample(range(len(words)), draw.randrange(len(words) // 2)):
            words[at] = draw.choice(["other", "more", words[at - 1]])
        rows.append((key, " ".join(prose(2000 + key, 40).split() + words * (key % 3) + prose(3000 + key, 40).split())))
    split = [re.findall(r"\w+", x.lower()) for x in own]
    wanted, sharing = {}, set()
    for key, text in rows:
        words = re.findall(r"\w+", text.lower())
        runs = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        for item, mine in enumerate(split):
            score = smith_waterman(mine, words) / (MATCH * len(mine))
            if score >= 0.6:
                wanted[key, item] = score
                if any(tuple(mine[i : i + 4]) in runs for i in range(len(mine) - 3)):
                    sharing.add((key, item))
    benchmark = spark.createDataFrame(list(enumerate(own)), "item_id int, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in find_contamination(documents(spark, rows), benchmark).collect()}
    assert set(found) == sharing and len(sharing) >= 0.9 * len(wanted) > 30
    assert all(abs(found[x] - wanted[x]) < 1e-9 for x in found)


def test_templated_items_bring_few_candidates():
    words = [f"t{i}" for i in range(40)]
    own = Items([(str(i), " ".join([*words[:25], f"name{i}", f"place{i}", *words[25:]])) for i in range(3000)])
    template = " ".join(words[:25]) + " x " + " ".join(words[25:])
    assert not list(own.passages(template * 5))
    held = list(own.passages("a b " + " ".join([*words[10:25], "name7", "place7", *words[25:30]])))
    assert [own.ids[item] for item, _, _ in held] == [["7"]]
    # Items without a rare run are found by their whole text, and equal items share their seeds.
    nested = Items([*((str(i), f"a b c d e{i}") for i in range(100)), ("short", "a b c d"), *(("same" + str(i), "p q r s t") for i in range(100))])
    assert [nested.ids[i] for i, _, _ in nested.passages("x a b c d x")] == [["short"]]
    assert [len(nested.ids[i]) for i, _, _ in nested.passages("x p q r s x")] == [100]


def test_ids_of_other_types_and_repeats(spark):
    own = prose(1, 20)
    benchmark = spark.createDataFrame([("i", own), ("i", prose(2, 20)), ("k", own.upper()), (None, own)], "name string, text string")
    docs = spark.createDataFrame([("d", own), ("d", prose(2, 20)), (None, own)], "doc string, text string")
    found = find_contamination(docs, benchmark, "doc", "text", "name").collect()
    assert sorted((r["doc"] or "", r["item_id"] or "") for r in found) == [("", ""), ("", "i"), ("", "k"), ("d", ""), ("d", "i"), ("d", "k")]


def test_the_filter_drops_what_is_found(spark):
    own = items()
    rows = [(100 + i, prose(i, 60) + " " + own[i % 12][1] * (i % 3 == 0)) for i in range(40)] + TROUBLED
    docs, benchmark = documents(spark, rows), spark.createDataFrame(own, "item_id long, text string")
    dropped = {r["doc_id"] for r in find_contamination(docs, benchmark).collect()}
    for words in (1_000_000, 100):
        kept = without_contamination(docs, benchmark, group_words=words)
        assert kept.columns == docs.columns and kept.count() == len(rows) - len(dropped)
        assert not dropped & {r["doc_id"] for r in kept.collect()}
    assert dropped == {100 + i for i in range(40) if i % 3 == 0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items(), "item_id long, text string")
    assert find_contamination(documents(spark, TROUBLED), none).isEmpty()
    assert find_contamination(documents(spark, []), some).isEmpty()
