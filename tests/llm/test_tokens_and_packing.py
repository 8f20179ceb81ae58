from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm.common import work_path
from foliant.llm.packing import best_fit, configurations, cut, pack, solve_configuration_lp
from foliant.llm.tokens import count_tokens, encoder, ignores_space_runs, read_cache
from tests.llm.helpers import TROUBLED, documents

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def texts():
    draw = random.Random(4)
    pieces = ["<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "\t", "\u00a0", "é", "中文", "don't", "WORD", "word", "12345", "!?", "😀", "\r\n", " ", "İ", "ﬁ"]
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(400)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    path = str(public_tokenizers.path(name))
    library = Tokenizer.from_file(path)
    own = encoder(path)(texts())
    assert [list(x) for x in own] == [library.encode(t, add_special_tokens=False).ids for t in texts()]


def test_other_vocabularies():
    assert encoder(str(public_tokenizers.path("piece_bpe_32k.model")))(["a b", ""])[1] == []
    assert encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))(["a b"]) == [list(x) for x in encoder(BYTE)(["a b"])]
    assert ignores_space_runs(WORD) and not ignores_space_runs(BYTE)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_and_cache(spark, path):
    rows = TROUBLED + [(100 + i, t) for i, t in enumerate(texts())]
    library, cache = Tokenizer.from_file(path), work_path(spark, "cache")
    expected = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for _ in range(2):  # the second run finds every count in the cache
        found = count_tokens(documents(spark, rows), "doc_id", "text", path, cache).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in found) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in found)
    stored = read_cache(spark, cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert count_tokens(documents(spark, []), "doc_id", "text", path, work_path(spark, "cache")).isEmpty()


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(11, 10) == [(0, 1), (1, 10)] and cut(20, 10) == [(0, 10), (10, 10)]


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_every_piece(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 200, 3000) if seed % 2 else np.clip(draw.lognormal(4, 1, 3000), 1, 256).astype(int)
    histogram = {int(n): int((lengths == n).sum()) for n in np.unique(lengths)}
    for chosen in (configurations(histogram, 256), best_fit(histogram, 256)):
        held: dict[int, int] = {}
        for found, many in chosen:
            assert sum(n * a for n, a in found.items()) <= 256
            for n, a in found.items():
                held[n] = held.get(n, 0) + a * many
        assert held == histogram
    sequences = sum(m for _, m in configurations(histogram, 256))
    assert sequences <= 1.01 * -(-int(lengths.sum()) // 256) + 2


def kinds():
    draw = np.random.default_rng(3)
    even = lambda low, high, n: dict(zip(*(x.tolist() for x in np.unique(draw.integers(low, high, n), return_counts=True)), strict=True))
    return {"long": even(342, 700, 5000), "thirds": even(200, 500, 5000), "halves": even(513, 1024, 2000), "mixed": even(100, 900, 5000)}


@pytest.mark.parametrize("kind", ["long", "thirds", "halves", "mixed"])
def test_sequences_against_the_bound_of_the_linear_program(kind):
    histogram = kinds()[kind]
    solution = solve_configuration_lp(histogram, 1024)
    held = dict.fromkeys(histogram, 0.0)
    for found, amount in solution.uses.items():
        assert sum(n * a for n, a in found) <= 1024
        for n, a in found:
            held[n] += a * amount
    shares = [held[n] / histogram[n] for n in histogram]
    assert max(shares) <= 1 + 1e-6 and abs(min(shares) - solution.covered) < 1e-6
    # Uses over the least share cover everything: a solution of the linear program, no better than the bound.
    assert solution.bound <= sum(solution.uses.values()) / solution.covered + 1e-6
    own, plain = (sum(m for _, m in x) for x in (configurations(histogram, 1024), best_fit(histogram, 1024)))
    assert solution.bound - 1e-6 <= own <= plain * 1.01 + 1
    assert own <= solution.bound * {"long": 1.05, "thirds": 1.03, "halves": 1.1, "mixed": 1.02}[kind]
    if kind == "halves":
        assert own == sum(histogram.values())  # no two fit


def test_the_weights_decide():
    histogram = {8: 600, 5: 600, 6: 600, 3: 600, 7: 600}
    fixed, moved = solve_configuration_lp(histogram, 20, rate=0.0), solve_configuration_lp(histogram, 20)
    assert fixed.covered < 0.75 and moved.covered > 0.95
    still, own = (sum(m for _, m in configurations(histogram, 20, rate=r)) for r in (0.0, 0.1))
    assert 870 <= own < still  # 870 sequences are full
    thirds = kinds()["thirds"]
    assert sum(m for _, m in configurations(thirds, 1024)) < 0.97 * sum(m for _, m in best_fit(thirds, 1024))


def test_long_white_space_and_other_ids(spark):
    rows = [("a", " " * 1_000_000), ("b", "x" + "\n" * 40_000 + "y"), ("c", "word"), (None, None)]
    library = Tokenizer.from_file(BYTE)
    found = pack(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text", BYTE).toPandas()
    sizes = {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in rows}
    assert {k: int(found[found.doc_id.eq(k) if k else found.doc_id.isna()].length.sum()) for k, _ in rows} == sizes


def test_packing(spark):
    rows = [(i, t) for i, t in TROUBLED if i is not None and i not in (5,)] + [(100 + i, t) for i, t in enumerate(texts())]
    library = Tokenizer.from_file(BYTE)
    found = pack(documents(spark, rows), "doc_id", "text", BYTE).toPandas()
    for key, own in found.groupby("doc_id"):
        ids = [*library.encode(dict(rows)[key] or "", add_special_tokens=False).ids, 2]
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            assert p.length == 1024 or p.piece == 0
    assert set(found.doc_id) == {i for i, _ in rows}
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert pack(documents(spark, []), "doc_id", "text", BYTE).isEmpty()


def test_null_and_repeated_ids_are_packed(spark):
    found = pack(documents(spark, TROUBLED), "doc_id", "text", BYTE)
    first = found.where("piece = 0")
    assert first.count() == len(TROUBLED) and first.where("doc_id is null").count() == 2
