"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles.  Texts with the same set are one class
and stand for each other.  Every class has a MinHash signature that is cut into
the label sequences of ``TREES`` prefix tries.  A trie is its label sequences in
sorted order, dealt out by ranges so that no prefix is too hot for a task: the
classes under a node lie together, and one pass over a range names, for every
class and every depth, the first class of its node (its pivot).  Nodes that
cross the end of a range are sewn together from the ranges' first and last rows.

Matched prefixes are shortened step by step, from the full depth.  At a depth
the members of a node are compared with its pivot, exactly, on the whole sets.
Then the recall of each class is estimated: a link of similarity s is found at
this depth with chance p(s) = 1 - (1 - s**depth)**trees, so k found links stand
for the sum of their 1 / p, and one unseen partner at the threshold t counts
beside them, found with p(t).  A class whose share (k + p(t)) / (sum + 1)
reaches the target is done; only nodes that hold a class below it are looked up
with a label less.  At the depth where p(t) alone reaches the target all are done.

Nodes whose members are still not all connected are searched for links in tiles:
the members outside the node's largest part against all of its members, as
matrix products.  A tile gives at most one link for two parts, so texts just
below the threshold never become rows of pairs, and no two texts are compared
that never met under a prefix.

Links are then counted within each connected part around its centre, the set of
shingles that at least half of its classes hold (empty where there are none),
using that Jaccard distance is a metric: classes within half the distance bound
of the centre are all linked to each other.  The links of classes further out
are counted in tiles by matrix products, which give a count per class and no row
per pair; tiles hold the sets' differences from the centre, from which the
shared shingles follow exactly.

Defined results: words are runs of letters, digits and underscores, lower-cased;
a text of one to four words is one shingle; texts without words are one class
without links; whole texts count, however long; rows that repeat an id get a row
each; a class without any id has no links beyond its copies; an empty table
gives no rows.  Only the id and text columns are read, so other columns may have
any name; the ids need an order, which decides between equal texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import scratch, table, text_or_empty, with_text_batches, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
TARGET_RECALL = 0.999
_LABEL_BYTES = 2
_CLASS_BYTES = 16
_CHUNK = 2048
#: Sets on either side of a tile, about, and shingles multiplied at a time.
TILE_ROWS = 128
TILE_SHINGLES = 8192

_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return found


def shingles(text: str, hashes: dict[str, int], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(size, len(own))
    total = np.full(len(own) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[i : i + len(total)]
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of permutations of the 32-bit numbers."""
    draw = np.random.default_rng(11)
    return draw.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), draw.integers(0, 2**32, count, dtype=np.uint32)


def signature(found: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> bytes:
    """For each permutation a 16-bit label of the smallest value."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), _CHUNK):
        np.minimum(least, (short[at : at + _CHUNK, None] * factors + offsets).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def depth_for(threshold: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix whose expected recall reaches the target, shortening from the full depth."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _signed(documents: DataFrame, id_col: str, text_col: str, trees: int, deepest: int) -> DataFrame:
    """(id, class, size, sig) of every row; the class is the digest of the shingle set."""
    factors, offsets = hash_functions(trees * deepest)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, hashes)
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), signature(found, factors, offsets)))
            out = pd.DataFrame(rows, columns=["class", "size", "sig"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    rows = with_text_batches(documents).select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    kind = documents.schema[id_col].dataType
    return rows.mapInPandas(sign, "id string, class binary, size int, sig binary").withColumn("id", F.col("id").cast(kind))


def _sets(documents: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the wanted (class, id), from the whole texts."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            rows = []
            for own, text in zip(batch["class"], batch["text"], strict=True):
                found = shingles(text, hashes)
                if xxhash.xxh3_128_digest(found.tobytes()) == bytes(own):  # an id may stand for several texts
                    rows.append((own, found.tobytes()))
            yield pd.DataFrame(rows, columns=["class", "shingles"])

    texts = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = texts.join(wanted.select("class", "id"), "id").select("class", "text")
    return found.mapInPandas(build, "class binary, shingles binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, limit: Fraction, others: DataFrame | None = None) -> DataFrame:
    """(a, b, distance, linked) of the pairs (a, b), on the whole sets; b may name one of ``others``."""
    above, below = limit.numerator, limit.denominator

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                rows.append((1 - both / either, both * below >= either * above))
            out = pd.DataFrame(rows, columns=["distance", "linked"])
            out.insert(0, "a", batch["a"].to_numpy())
            out.insert(1, "b", batch["b"].to_numpy())
            yield out

    joined = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("left")), "a").join(
        (others or sets).select(F.col("class").alias("b"), F.col("shingles").alias("right")), "b"
    )
    return joined.select("a", "b", "left", "right").mapInPandas(compare, "a binary, b binary, distance double, linked boolean")


def _tries(classes: DataFrame, trees: int, deepest: int, floor: int) -> DataFrame:
    """The forest's matched prefixes: rows (tree, matched, class, pivots) and, where ``edge``, what ends the ranges.

    ``matched`` is the depth of the deepest node that the class shares with one
    before it in its range; ``pivots`` holds the first classes of its nodes from
    that depth up to ``floor``.
    """
    width = deepest * _LABEL_BYTES
    placed = classes.select("class", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("labels"), "class"
    )
    # The class is part of the order, so a label sequence that many share is dealt to many tasks.
    ordered = placed.repartitionByRange("tree", "labels", "class").sortWithinPartitions("tree", "labels", "class")
    depths = range(deepest, floor - 1, -1)
    names = ["tree", "matched", "class", "pivots", "labels", "edge", "place"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = last = None  # (tree, labels, class) of the first row; the last row with its pivots by depth
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.asarray(batch.column(0))
            labels = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(len(tree), deepest)
            own = np.array(batch.column(2).to_pylist(), dtype=object)
            if last is None:
                begin = (int(tree[0]), labels[0].tobytes(), own[0])
                before = np.array([-1]), labels[:1], [None] * len(depths)
            else:
                before = np.array([last[0]]), np.frombuffer(last[1], dtype="<u2")[None, :], last[3]
            same = np.vstack([before[1], labels[:-1]]) == labels
            shared = np.cumprod(same, axis=1).sum(axis=1)
            shared[np.append(before[0], tree[:-1]) != tree] = -1
            at = np.arange(len(tree))
            pivots = []
            for depth, carried in zip(depths, before[2], strict=True):
                since = np.maximum.accumulate(np.where(shared < depth, at, -1))
                pivots.append(np.where(since < 0, carried, own[since]))
            met = np.flatnonzero(shared >= floor)
            if len(met):
                deep = np.minimum(shared[met], deepest)
                chains = [b"".join(pivots[deepest - d][i] for d in range(m, floor - 1, -1)) for i, m in zip(met.tolist(), deep.tolist(), strict=True)]
                rows = [tree[met], deep, own[met], chains, [None] * len(met), [False] * len(met), [0] * len(met)]
                yield pa.record_batch([pa.array(x, type=t) for x, t in zip(rows, kinds, strict=True)], names=names)
            last = (int(tree[-1]), labels[-1].tobytes(), own[-1], [p[-1] for p in pivots])
        if last is not None:
            place = TaskContext.get().partitionId()
            rows = [[begin[0], last[0]], [0, 1], [begin[2], last[2]], [None, b"".join(last[3])], [begin[1], last[1]], [True, True], [place, place]]
            yield pa.record_batch([pa.array(x, type=t) for x, t in zip(rows, kinds, strict=True)], names=names)

    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32()]
    return ordered.mapInArrow(walk, "tree int, matched int, class binary, pivots binary, labels binary, edge boolean, place int")


def _sewn(edges: list, deepest: int, floor: int) -> tuple[list[tuple], list[tuple]]:
    """What the ranges' ends say of nodes that cross them.

    Rows (tree, matched, class, pivots) of the first classes of ranges, and
    (tree, depth, pivot, root): nodes that began in a range before, under root.
    """
    ends: dict[int, dict[int, tuple]] = {}
    for r in edges:
        ends.setdefault(r["place"], {})[r["matched"]] = r
    rows, roots = [], []
    tree, labels, open_roots = None, b"", {}
    for place in sorted(ends):
        first, final = ends[place][0], ends[place][1]
        shared = -1
        if first["tree"] == tree:
            mine, other = (np.frombuffer(bytes(x), dtype="<u2") for x in (first["labels"], labels))
            shared = int(np.cumprod(mine == other).sum())
        own = bytes(first["class"])
        going_on = {d: open_roots[d] for d in range(floor, min(shared, deepest) + 1)}
        if going_on:
            rows.append((tree, max(going_on), own, b"".join(going_on[d] for d in sorted(going_on, reverse=True))))
            roots += [(tree, d, own, root) for d, root in going_on.items()]
        chain = bytes(final["pivots"])
        tree, labels = final["tree"], bytes(final["labels"])
        for i, d in enumerate(range(deepest, floor - 1, -1)):
            pivot = chain[i * _CLASS_BYTES : (i + 1) * _CLASS_BYTES]
            open_roots[d] = going_on.get(d, pivot) if pivot == own and first["tree"] == tree else pivot
    return rows, roots


class _Forest:
    """The nodes of the tries that hold more than one class, by depth."""

    def __init__(self, classes: DataFrame, trees: int, deepest: int, floor: int):
        spark = classes.sparkSession
        found = written(_tries(classes, trees, deepest, floor), "nd-tries")
        # Two rows for each task of the pass: the driver sees no more than that.
        edges = found.where("edge").select("tree", "matched", "class", "pivots", "labels", "place").collect()
        rows, roots = _sewn(edges, deepest, floor)
        kept = "tree int, matched int, class binary, pivots binary"
        self.rows = found.where("not edge").select("tree", "matched", "class", "pivots").union(spark.createDataFrame(rows, kept))
        self.roots = spark.createDataFrame(roots, "tree int, depth int, pivot binary, root binary")
        self.floor = floor

    def at(self, depth: int) -> DataFrame:
        """(node, tree, class, pivot): the members of the nodes of a depth beside their pivots."""
        pivot = F.expr(f"substring(pivots, (matched - {depth}) * {_CLASS_BYTES} + 1, {_CLASS_BYTES})")
        whole = self.rows.where(F.col("matched") >= depth).select("tree", "class", pivot.alias("pivot"))
        roots = F.broadcast(self.roots.where(F.col("depth") == depth).select("tree", "pivot", "root"))  # a row for each task at most
        sewn = whole.join(roots, ["tree", "pivot"], "left").select("tree", "class", F.coalesce("root", "pivot").alias("pivot"))
        return sewn.select(F.xxhash64(F.lit(depth), "tree", "pivot").alias("node"), "tree", "class", "pivot")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, part): the smallest class of each node's connected part, by label passing and pointer jumping."""
    both = written(links.select("a", "b").union(links.select("b", "a")), "nd-links")
    # Nodes without links keep themselves; only the others take part in the rounds.
    labels = written(both.groupBy(F.col("a").alias("class")).agg(F.least(F.col("class"), F.min("b")).alias("part")), "nd-labels")
    while True:
        heard = both.join(labels.select(F.col("class").alias("b"), "part"), "b").select(F.col("a").alias("class"), "part", F.lit(None).cast("binary").alias("own"))
        told = labels.select("class", "part", F.col("part").alias("own")).union(heard)
        nearer = written(told.groupBy("class").agg(F.min("part").alias("part"), F.min("own").alias("before")), "nd-labels")
        if nearer.where(F.col("part") != F.col("before")).isEmpty():
            break
        labels = written(_jumped(nearer.select("class", "part")), "nd-labels")
    return nodes.join(labels, "class", "left").select("class", F.coalesce("part", "class").alias("part"))


def _jumped(labels: DataFrame) -> DataFrame:
    """Labels followed one step further."""
    further = labels.select(F.col("class").alias("part"), F.col("part").alias("further"))
    return labels.join(further, "part", "left").select("class", F.least("part", F.coalesce("further", "part")).alias("part"))


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` with those joined that links (a, b) connect."""
    ends = written(_with_parts(links, parts).groupBy(F.col("part_a").alias("a"), F.col("part_b").alias("b")).agg(F.lit(1).alias("x")).select("a", "b"), "nd-joins")
    if ends.isEmpty():
        return parts
    names = ends.select(F.col("a").alias("class")).union(ends.select("b")).distinct()
    wider = connected(names, ends).select(F.col("class").alias("part"), F.col("part").alias("wider"))
    return written(parts.join(wider, "part", "left").select("class", F.coalesce("wider", "part").alias("part")), "nd-parts")


def _with_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not connected yet, with part_a and part_b."""
    return (
        pairs.join(parts.select(F.col("class").alias("a"), F.col("part").alias("part_a")), "a")
        .join(parts.select(F.col("class").alias("b"), F.col("part").alias("part_b")), "b")
        .where(F.col("part_a") != F.col("part_b"))
    )


def chance(similarity: float | Column, depth: int, trees: int) -> float | Column:
    """How likely two sets of this similarity meet under a prefix of this depth."""
    return 1 - (1 - similarity**depth) ** trees


def _unmet(classes: DataFrame, facts: DataFrame, threshold: float, depth: int, trees: int, target: float) -> DataFrame:
    """(class): those whose estimated recall at this depth is below the target."""
    linked = facts.where("linked").select("a", "b", (1 - F.col("distance")).alias("s"))
    ends = linked.select(F.col("a").alias("class"), "s").union(linked.select("b", "s"))
    found = ends.groupBy("class").agg(F.count("*").alias("k"), F.sum(1 / chance(F.col("s"), depth, trees)).alias("total"))
    k, total = F.coalesce("k", F.lit(0)), F.coalesce("total", F.lit(0.0))
    return classes.join(found, "class", "left").where((k + F.lit(chance(threshold, depth, trees))) / (total + 1) < target).select("class")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    deepest: int = DEPTH,
    target: float = TARGET_RECALL,
    count_links: bool = True,
) -> DataFrame:
    """One row per document: (id, class_id, copy_id, n_copies[, n_links]).

    ``class_id`` is the smallest id of the connected group, ``copy_id`` that of
    the texts with the same shingle set, ``n_copies`` the number of further rows
    with that set and ``n_links`` the number of other sets at the threshold.
    """
    with scratch() as keep:
        return _near_duplicates(documents, id_col, text_col, threshold, trees, deepest, target, count_links, keep)


def _near_duplicates(
    documents: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, deepest: int, target: float, count_links: bool, keep: Callable
) -> DataFrame:
    limit = Fraction(str(threshold)).limit_denominator(1000)
    floor = depth_for(threshold, trees, deepest, target)
    rows = written(_signed(documents, id_col, text_col, trees, deepest), "nd-rows")
    classes = written(
        rows.groupBy("class").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")
        ),
        "nd-classes",
    )
    linkable = classes.where((F.col("size") > 0) & F.col("id").isNotNull())
    forest = _Forest(linkable.select("class", "sig"), trees, deepest, floor)
    at_floor = forest.at(floor)
    involved = written(at_floor.select("class").union(at_floor.select("pivot")).distinct(), "nd-involved")
    sets = written(_sets(documents, id_col, text_col, linkable.join(involved, "class", "left_semi")), "nd-sets")

    # At the full depth: each member with the smallest of its pivots, then with the others it is not connected to.
    nodes = forest.at(deepest)
    final = nodes.select("node", "tree", "class", "pivot")
    compared = written(_pairs(nodes), "nd-pairs")
    first = written(compared.groupBy("a").agg(F.min("b").alias("b")), "nd-first")
    facts = written(_verified(first, sets, limit), "nd-facts")
    stars = involved.join(facts.where("linked").select(F.col("a").alias("class"), F.col("b").alias("part")), "class", "left")
    stars = written(_jumped(written(stars.select("class", F.coalesce("part", "class").alias("part")), "nd-stars")), "nd-stars")
    rest = written(_with_parts(compared.join(first, ["a", "b"], "left_anti"), stars).select("a", "b"), "nd-rest")
    facts = facts.union(written(_verified(rest, sets, limit), "nd-facts"))
    parts = written(connected(involved, facts.where("linked")), "nd-parts")

    for depth in range(deepest - 1, floor - 1, -1):
        unmet = written(_unmet(involved, facts, threshold, depth + 1, trees, target), "nd-unmet")
        nodes = forest.at(depth)
        asking = nodes.join(unmet, "class", "left_semi").select("node").union(nodes.join(unmet.withColumnRenamed("class", "pivot"), "pivot", "left_semi").select("node"))
        nodes = written(nodes.join(asking.distinct(), "node", "left_semi"), "nd-nodes")
        final = final.join(nodes.select("tree", "class"), ["tree", "class"], "left_anti").unionByName(nodes)
        apart = written(_with_parts(_pairs(nodes), parts).select("a", "b"), "nd-rest")
        met = written(_verified(apart, sets, limit), "nd-facts")
        facts = facts.union(met)
        parts = _merged(parts, met.where("linked"))
    parts = _merged(parts, _bridges(final, parts, sets, limit))

    groups = classes.select("class", "id", "copies").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    names = groups.groupBy("part").agg(F.min("id").alias("class_id"))
    named = groups.join(written(names, "nd-names"), "part").select("class", "class_id", F.col("id").alias("copy_id"), (F.col("copies") - 1).alias("n_copies"))
    if count_links:
        named = named.join(_link_counts(parts, sets, limit), "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    named, rows = keep(written(named, "nd-named")), keep(rows)
    return rows.select("class", F.col("id").alias(id_col)).join(named, "class").drop("class")


def _pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each member once with each of its pivots."""
    return nodes.groupBy(F.col("class").alias("a"), F.col("pivot").alias("b")).agg(F.lit(1).alias("x")).select("a", "b")


def _bridges(nodes: DataFrame, parts: DataFrame, sets: DataFrame, limit: Fraction) -> DataFrame:
    """Links (a, b) between parts that share a node without being connected by its pivot.

    Of each such node the members outside its largest part are compared with all
    members, tile by tile.  Nodes of different tries with the same members are
    searched once.
    """
    members = nodes.select("node", "class").union(nodes.select("node", F.col("pivot").alias("class")).distinct()).join(parts, "class")
    each = members.groupBy("node", "part").agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")
    )
    split = each.groupBy("node").agg(
        F.sum("k").alias("n"), F.count("*").alias("parts"), F.max_by("part", F.struct("k", "part")).alias("main"), F.max("k").alias("most"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
    )
    once = split.where("parts > 1").groupBy("n", "x", "y").agg(F.min(F.struct("node", "main", "most")).alias("of"))
    block = lambda n: F.ceil(n / TILE_ROWS).cast("int")
    open_nodes = once.select("of.node", "of.main", block(F.col("n") - F.col("of.most")).alias("rows"), block(F.col("n")).alias("columns"))
    whole = members.join(written(open_nodes, "nd-open"), "node").withColumn("is_row", F.col("part") != F.col("main"))
    placed = written(_tiles(whole, "node", "part"), "nd-open-tiles").join(sets, "class")

    def find(tile: pd.DataFrame) -> pd.DataFrame:
        rows, columns = tile[tile["is_row"]], tile[~tile["is_row"]]
        linked = _linked(rows["shingles"], columns["shingles"], limit)
        linked &= rows["part"].to_numpy()[:, None] != columns["part"].to_numpy()[None, :]
        at, to = np.nonzero(linked)
        out = pd.DataFrame({"a": rows["class"].to_numpy()[at], "b": columns["class"].to_numpy()[to], "x": rows["part"].to_numpy()[at], "y": columns["part"].to_numpy()[to]})
        return out.drop_duplicates(["x", "y"])[["a", "b"]]

    return written(placed.groupBy("node", "row", "column").applyInPandas(find, "a binary, b binary"), "nd-bridges")


def _tiles(whole: DataFrame, group: str, *keep: str) -> DataFrame:
    """Tiles (group, row, column) of those with ``is_row`` against all, with class, is_row and ``keep``.

    ``rows`` and ``columns`` tell into how many blocks either side of a group is dealt.
    """
    at = whole.withColumn("at", F.xxhash64("class"))
    left = at.where("is_row").select(
        group, F.pmod("at", "rows").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "class", F.lit(True).alias("is_row"), *keep
    )
    right = at.select(
        group, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod("at", "columns").cast("int").alias("column"), "class", F.lit(False).alias("is_row"), *keep
    )
    return left.union(right)


def _centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(part, centre): of each part the set of shingles that at least half of its classes hold."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(x, dtype=np.int64) for x in batch["shingles"]]
            if found:
                yield pd.DataFrame({"part": np.repeat(batch["part"].to_numpy(), [len(x) for x in found]), "shingle": np.concatenate(found)})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Sorted as unsigned numbers, as the sets are.
            own = [np.sort(np.asarray(x, dtype=np.int64).view(np.uint64)).tobytes() for x in batch["shingles"]]
            yield pd.DataFrame({"part": batch["part"], "centre": own})

    rows = sets.join(members.select("class", "part"), "class").select("part", "shingles").mapInPandas(spread, "part binary, shingle long")
    counts = rows.groupBy("part", "shingle").agg(F.count("*").alias("k"))
    sizes = written(members.groupBy("part").agg(F.count("*").alias("n")), "nd-sizes")
    common = written(counts, "nd-shingles").join(sizes, "part").where(F.col("k") * 2 >= F.col("n"))
    return common.groupBy("part").agg(F.collect_list("shingle").alias("shingles")).mapInPandas(gather, "part binary, centre binary")


def _around_centres(members: DataFrame, sets: DataFrame, centres: DataFrame, limit: Fraction) -> DataFrame:
    """Members (class, part) with their difference from the part's centre, and whether they belong to its core.

    ``shingles`` holds the shingles that only one of the set and the centre has,
    ``lost`` those of the centre among them; ``base`` is the centre's size.
    """
    above, below = limit.numerator, limit.denominator

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for whole, centre in zip(batch["shingles"], batch["centre"], strict=True):
                x, y = np.frombuffer(whole, np.uint64), np.frombuffer(centre, np.uint64)
                only = np.setxor1d(x, y, assume_unique=True)
                either = (len(x) + len(y) + len(only)) // 2
                lost = (len(only) + len(y) - len(x)) // 2
                rows.append((len(x), len(y), lost, bool(len(y)) and 2 * len(only) * below <= either * (below - above), only.tobytes()))
            out = pd.DataFrame(rows, columns=["size", "base", "lost", "core", "shingles"])
            out.insert(0, "class", batch["class"].to_numpy())
            out.insert(1, "part", batch["part"].to_numpy())
            yield out

    joined = members.join(centres, "part", "left").join(sets, "class").select("class", "part", "shingles", F.coalesce("centre", F.lit(b"")).alias("centre"))
    return joined.mapInPandas(measure, "class binary, part binary, size int, base int, lost int, core boolean, shingles binary")


def _link_counts(parts: DataFrame, sets: DataFrame, limit: Fraction) -> DataFrame:
    """(class, n_links): links within each connected part, decided by distances to its centre where they can be."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    sized = written(parts.join(written(sizes.where("n > 1"), "nd-part-sizes"), "part"), "nd-sized")
    pairs = sized.where("n = 2").select("class", F.lit(1).cast("long").alias("n_links"))
    larger = written(sized.where("n > 2").select("class", "part"), "nd-larger")
    # A part of drifting texts may have no shingle in half of its classes: its centre is empty and no class is of the core.
    near = written(_around_centres(larger, sets, written(_centres(larger, sets), "nd-centres"), limit), "nd-spokes")
    # Members of the core are at most the bound apart.
    cores = written(near.where("core").groupBy("part").agg(F.count("*").alias("n")), "nd-cores")
    in_core = near.where("core").join(cores, "part").select("class", (F.col("n") - 1).alias("n_links"))
    at_fringe = _fringe_links(near, limit)
    return written(pairs.union(in_core).union(at_fringe).groupBy("class").agg(F.sum("n_links").cast("long").alias("n_links")), "nd-counts")


def _fringe_links(near: DataFrame, limit: Fraction) -> DataFrame:
    """(class, n_links): links with an end outside the core, counted tile by tile; no pair becomes a row.

    Rows of the tiles are the fringe of a part, columns all of it.  A class of
    the core gets its count from the tiles' columns, one of the fringe from
    their rows, so a pair of two fringe classes counts once for each.
    """
    counts = near.groupBy("part").agg(F.count("*").alias("n"), F.sum((~F.col("core")).cast("int")).alias("outside")).where("outside > 0")
    block = lambda n: F.ceil(F.col(n) / TILE_ROWS).cast("int")
    sized = written(counts.select("part", block("outside").alias("rows"), block("n").alias("columns")), "nd-tiles")
    whole = near.join(sized, "part").withColumn("is_row", ~F.col("core"))
    placed = written(_tiles(whole, "part", "core"), "nd-placed").join(near.select("class", "size", "base", "lost", "shingles"), "class")

    def count(tile: pd.DataFrame) -> pd.DataFrame:
        rows, columns = tile[tile["is_row"]], tile[~tile["is_row"]]
        linked = _linked_around(rows, columns, limit)
        linked &= rows["class"].to_numpy()[:, None] != columns["class"].to_numpy()[None, :]
        inner = columns["core"].to_numpy(bool)
        return pd.DataFrame(
            {
                "class": np.concatenate([rows["class"].to_numpy(), columns["class"].to_numpy()[inner]]),
                "n_links": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)[inner]]).astype(np.int64),
            }
        )

    return placed.groupBy("part", "row", "column").applyInPandas(count, "class binary, n_links long")


def _linked(rows: pd.Series, columns: pd.Series, limit: Fraction) -> np.ndarray:
    """Which of the sets are linked."""
    left, right = ([np.frombuffer(x, np.uint64) for x in side] for side in (rows, columns))
    return _at_limit(_shared(left, right), [len(x) for x in left], [len(x) for x in right], limit)


def _linked_around(rows: pd.DataFrame, columns: pd.DataFrame, limit: Fraction) -> np.ndarray:
    """Which of the sets are linked, from their differences from one centre.

    What two sets share is the centre without what either lost, and what both
    gained: base - lost - lost' + what the differences share.
    """
    left, right = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (rows, columns))
    lost = np.add.outer(rows["lost"].to_numpy(np.int64), columns["lost"].to_numpy(np.int64))
    base = rows["base"].to_numpy(np.int64)[:, None]
    return _at_limit(base - lost + _shared(left, right), rows["size"], columns["size"], limit)


def _at_limit(shared: np.ndarray, left: list[int], right: list[int], limit: Fraction) -> np.ndarray:
    either = np.add.outer(np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)) - shared
    return shared * limit.denominator >= either * limit.numerator


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share, by matrix products over slices of those on both sides."""
    shared = np.zeros((len(left), len(right)), dtype=np.int64)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True) if left and right else np.zeros(0, np.uint64)
    for at in range(0, len(common), TILE_SHINGLES):
        part = common[at : at + TILE_SHINGLES]
        a, b = (_incidence(side, part) for side in (left, right))
        shared += (a @ b.T).astype(np.int64)
    return shared


def _incidence(sets: list[np.ndarray], shingles: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shingles)), dtype=np.float32)
    for i, own in enumerate(sets):
        inside = own[np.searchsorted(own, shingles[0]) : np.searchsorted(own, shingles[-1], side="right")]
        at = np.searchsorted(shingles, inside)
        out[i, at[shingles[np.minimum(at, len(shingles) - 1)] == inside]] = 1
    return out


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLES: dict = {}
