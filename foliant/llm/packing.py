"""Best-fit packing of token pieces into sequences by a configuration linear program.

Every document becomes its token ids and an end id; only documents longer than
a sequence are cut, into full pieces behind a first piece that may be shorter.
What is optimised is the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are:

* the configuration LP (how often to use each way to fill a sequence) is solved
  by multiplicative weights: every length has a price, and a round fills as many
  sequences as the bound below says are needed at least with the configurations
  of highest price, found by knapsack dynamic programming, no length more often
  than it has pieces.  Lengths that a round leaves out violate their covering
  constraint, and their prices rise by a factor that grows with the share left
  out.  The rounds' average is the solution;
* prices over the price of the best filled sequence are feasible for the dual
  program, so every round gives a lower bound, and the largest is kept;
* the fractional solution is rounded down, then up where pieces remain, and
  what rounding leaves over is placed by best fit, first where sequences have room;
* pieces take their places by rank within their length.  Ranks come from
  counts of (length, salt) groups, so a length that a third of all pieces have
  is ranked in many tasks.

Only the histogram and the configurations come to the driver; there are at most
as many lengths as the capacity, and rounds times as many configurations.

Defined results: a null text is empty and gives one piece, the end id; texts of
any length are encoded whole; repeated rows are packed each, in any order among
themselves; ids of any type, null too, are carried along; an empty table gives no
rows.  Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import table, with_text_batches, written
from foliant.llm.tokens import CHUNK, worker_encoder

CAPACITY = 1024
END_ID = 2
#: Rounds of the multiplicative weights, and how strongly a price follows its constraint's violation.
ROUNDS = 16
RATE = 0.1
#: Configurations this close to the most valuable one are used before prices are looked at again.
NEAR = 0.95
#: Pieces of one length that one task ranks, about.
RANKED_ROWS = 1_000_000
LEAST_SALTS = 64

_PIECE_SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind the rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces_of(documents: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = worker_encoder(tokenizer_path)
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            keys, rows = batch["doc_id"].tolist(), []
            for at in range(0, len(texts), CHUNK):
                for key, found in zip(keys[at : at + CHUNK], run(texts[at : at + CHUNK]), strict=True):
                    ids = np.array([*found, end_id], dtype="<u4")
                    for n, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((key, n, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # As a string a 64-bit id stays exact beside null ids.
    rows = with_text_batches(documents).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = documents.schema[id_col].dataType
    return rows.mapInPandas(encode, _PIECE_SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fills(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room the highest price of what fits, and the last length taken (-1: none); unbounded knapsack.

    ``lengths`` ascend; of equally good ones the longest is taken.
    """
    size = len(lengths)
    longest_first, own = lengths[::-1], prices[::-1]
    begin = size - np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        candidates = best[room - longest_first[begin[room] :]] + own[begin[room] :]
        at = int(candidates.argmax())
        best[room], taken[room] = candidates[at], size - 1 - begin[room] - at
    return best, taken


@dataclass
class Solution:
    """Configurations (pairs of length and count) with how often to use each, in fractions.

    ``covered`` is the least share of a length's pieces that they hold, ``bound``
    a number of sequences that no packing can go below.
    """

    uses: dict[tuple[tuple[int, int], ...], float]
    covered: float
    bound: float


def _round(lengths: np.ndarray, demand: np.ndarray, prices: np.ndarray, capacity: int, sequences: float) -> tuple[dict, np.ndarray, float]:
    """Fill so many sequences by price, no length beyond its demand.

    Returns the configurations with their uses, the share of each demand they
    hold, and the price of the best sequence.
    """
    left, uses, highest = demand.copy(), {}, 0.0
    while sequences > 1e-9:
        active = np.flatnonzero(left > 1e-9 * demand)
        if not len(active):
            break
        own, price = lengths[active], prices[active]
        best, taken = best_fills(own, price, capacity)
        highest = highest or float(best[capacity])
        # The best configuration that has a given length, for each of them; the most valuable first, then the longest.
        value = price + best[capacity - own]
        order = np.lexsort((-own, -np.round(value / best[capacity], 6)))
        for i in order[value[order] >= NEAR * value[order[0]]].tolist():
            found, room = {i: 1}, capacity - int(own[i])
            while taken[room] >= 0:
                j = int(taken[room])
                found[j] = found.get(j, 0) + 1
                room -= int(own[j])
            amount = min(sequences, *(left[active[j]] / a for j, a in found.items()))
            if amount <= 1e-9:
                continue
            for j, a in found.items():
                left[active[j]] -= amount * a
            sequences -= amount
            key = tuple(sorted((int(own[j]), a) for j, a in found.items()))
            uses[key] = uses.get(key, 0.0) + amount
            if sequences <= 1e-9:
                break
    return uses, (demand - left) / demand, highest


def solve_configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> Solution:
    """The configuration LP's covering constraints by multiplicative weights."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    prices = lengths / capacity
    bound, total, covered = float(demand @ prices), {}, np.zeros(len(lengths))
    for _ in range(rounds):
        uses, share, highest = _round(lengths, demand, prices, capacity, bound)
        bound = max(bound, float(demand @ prices) / highest)
        covered += share
        for key, amount in uses.items():
            total[key] = total.get(key, 0.0) + amount / rounds
        prices = prices * np.exp(rate * (1 - share))
    return Solution(total, float(covered.min()) / rounds, bound)


def best_fit(histogram: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: equal sequences are opened and filled together, those ``begun`` first."""
    open_by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for filled, many in begun:
        _put(open_by_room, capacity - sum(n * a for n, a in filled.items()), filled, many)
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        for room in sorted(r for r in open_by_room if r >= length):
            while count and open_by_room.get(room):
                filled, many = open_by_room[room].pop()
                fits = room // length
                full = min(many, count // fits)
                if full:
                    _put(open_by_room, room - fits * length, {**filled, length: filled.get(length, 0) + fits}, full)
                    count -= full * fits
                if full < many:
                    rest = min(count, fits - 1) if full == count // fits or not full else 0
                    if rest and count < fits:
                        _put(open_by_room, room - rest * length, {**filled, length: filled.get(length, 0) + rest}, 1)
                        count -= rest
                        full += 1
                    if full < many:
                        open_by_room[room].append((filled, many - full))
                    if not count:
                        break
            if not count:
                break
        fits = capacity // length
        if count >= fits:
            _put(open_by_room, capacity - fits * length, {length: fits}, count // fits)
            count %= fits
        if count:
            _put(open_by_room, capacity - count * length, {length: count}, 1)
    return [entry for entries in open_by_room.values() for entry in entries]


def _put(open_by_room: dict, room: int, filled: dict[int, int], many: int) -> None:
    open_by_room.setdefault(room, []).append((filled, many))


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with how many sequences use each; together they hold every piece exactly."""
    left = dict(histogram)
    chosen: list[tuple[dict[int, int], int]] = []
    solution = solve_configuration_lp(histogram, capacity, rounds, rate).uses if histogram else {}

    def use(found: tuple[tuple[int, int], ...], many: int) -> None:
        many = min(many, *(left[n] // a for n, a in found))
        if many > 0:
            for n, a in found:
                left[n] -= many * a
            chosen.append((dict(found), many))

    # Full sequences before those with room, then the most used; a tie goes by the lengths.
    filled = {key: sum(n * a for n, a in key) for key in solution}
    for key in sorted(solution, key=lambda k: (-filled[k], -solution[k], k)):
        use(key, int(solution[key]))
    for key in sorted(solution, key=lambda k: (-filled[k], int(solution[k]) - solution[k], k)):
        use(key, 1)
    return best_fit({n: c for n, c in left.items() if c}, capacity, chosen)


def places(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: the sequences and the offset where they go."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for found, many in chosen:
        offset = 0
        for length in sorted(found, reverse=True):
            for _ in range(found[length]):
                rank = next_rank.get(length, 0)
                rows.append((length, rank, base, offset))
                next_rank[length] = rank + many
                offset += length
        base += many
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns, strict=True))


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank (from 0) among those of their length."""
    salts = max(LEAST_SALTS, pieces.count() // RANKED_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-groups")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(ahead, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("own"))


def pack(
    documents: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = written(pieces_of(documents, id_col, text_col, tokenizer_path, end_id, capacity), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = places(configurations(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        # One sorted key for (length, rank): ranks stay below 2**52.
        starts = runs["length"] * 2**52 + runs["rank"]
        at = np.searchsorted(starts, length.to_numpy() * 2**52 + rank.to_numpy(), side="right") - 1
        return pd.DataFrame(
            {"sequence_id": runs["sequence"][at] + rank.to_numpy() - runs["rank"][at], "offset": runs["offset"][at]}
        )

    return (
        ranked(pieces)
        .withColumn("place", place("length", "rank"))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset")
        )
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", path)


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict = {}
