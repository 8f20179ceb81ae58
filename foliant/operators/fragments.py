"""Repair of text that extraction split: tests for fragments, lines, headings and sentences put together again.

Relations between neighbours are windows; the two folds whose next step depends
on what was merged before (grouping and strict reconstruction) run per page in
Arrow batches, as a merge never crosses a page.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_title, is_upper, stripped, word_count, words

# Word lists and patterns of fragments.
HEADING_WORDS = ("level", "extension", "foundation", "overview", "introduction", "chapter", "section", "part", "guide", "manual", "document")
OPEN_ENDS = (" and", " of", " the", " for", " in", " on", " with", " Level")
CONTINUING_WORDS = ("and", "of", "the", "for", "in", "on", "with", "extensions", "level")
JOINING_WORDS = ("and", "or", "the", "of", "in", "to", "for", "by")
UNFINISHED_WORDS = ("and", "or", "the", "of")
CONTINUATIONS = (
    (r"date\s+of\s+entering\s+the\s+central\s+government", r"service"),
    (r"home\s+town\s+as\s+recorded\s+in\s+the", r"service\s+book"),
    (r"whether\s+wife.*husband.*employed.*and\s+if", r"so\s+whether\s+entitled"),
    (r"single\s+rail\s+fare.*headquarters\s+to.*by", r"shortest\s+route"),
    (r"if\s+the\s+concession.*visit.*in", r"india"),
)
#: Followers that grouping looks at, and strict reconstruction.
WINDOW = 7
STRICT_WINDOW = 5

COLUMNS = ("doc_id", "page_number", "block_no", "text", "x", "y", "width", "height", "font_name", "font_size", "font_flags")
_SCHEMA = (
    "doc_id long, page_number int, block_no int, text string, x double, y double, width double, height double, font_name string, "
    "font_size double, font_flags int, n_merged int"
)


def page_of(blocks: DataFrame) -> Column:
    """The block's page: ``page_number``, else ``page``, else 1, of the columns that are there."""
    return F.coalesce(*[F.col(c) for c in ("page_number", "page") if c in blocks.columns], F.lit(1))


def heading_text(text: Column) -> Column:
    """Five to a hundred characters in at most eight words, capitalised, shouted or with a heading's word."""
    own = stripped(text)
    listed, n = words(own), word_count(own)
    capital = F.size(F.filter(listed, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
    named = F.exists(listed, lambda w: F.lower(w).isin(*HEADING_WORDS))
    return F.length(own).between(5, 100) & (n <= 8) & ((capital >= n * 0.6) | (is_upper(own) & (n <= 5)) | named)


def fragmented(n: Column, mean_font: Column, least_font: Column, characters: Column, short: Column, mean_gap: Column, joined: Column) -> Column:
    """Whether a run of neighbours on a line is a heading in pieces: a few words, many short pieces close together, or heading text."""
    large = (mean_font >= F.when(n <= 4, 12).otherwise(15)) & (least_font >= 10)
    pieces = F.when(n <= 4, characters.between(10, 80)).otherwise((short >= n * 0.6) & (mean_gap <= mean_font * 0.7))
    return (n >= 2) & large & (pieces | heading_text(joined))


def heading_parts(first: Column, second: Column) -> Column:
    """Whether two texts read as parts of one heading: two of five signs, and no new sentence or statement."""
    count = lambda c: c.cast("int")
    cased = lambda t: is_title(t) | is_upper(t)
    signs = (
        count(cased(first) & cased(second))
        + count(_ends_with_any(first, OPEN_ENDS))
        + count(F.lower(F.element_at(words(second), 1)).isin(*CONTINUING_WORDS))
        + count((word_count(first) <= 4) & (word_count(second) <= 4))
        + count(~first.rlike(r"(?s)\..") & ~second.rlike(r"(?s)\.."))
    )
    capital = second.rlike(r"^\p{Lu}")
    sentence = capital & first.endswith(".")
    statement = first.rlike(r"[!?:]$") & capital & (word_count(second) > 3)
    return F.coalesce(~sentence & ~statement & (signs >= 2), F.lit(False))


def _ends_with_any(text: Column, ends: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for end in ends:
        found = found | text.endswith(end)
    return found


def same_heading(a: Column, b: Column) -> Column:
    """Whether block ``b`` (text, x, y, font_size, page_number) continues the heading of block ``a``."""
    first, second, size = stripped(a["text"]), stripped(b["text"]), a["font_size"]
    near = F.abs(size - b["font_size"]) <= F.greatest(F.lit(2.0), size * 0.15)
    down = F.abs(a["y"] - b["y"])
    beside = F.abs(b["x"] - (a["x"] + F.length(first) * size * 0.6)) <= size * 1.5
    below = (
        (F.abs(a["x"] - b["x"]) <= size).cast("int")
        + ((F.length(first) <= 50) & (F.length(second) <= 50)).cast("int")
        + ((size >= 12) & (b["font_size"] >= 12)).cast("int")
        + heading_parts(first, second).cast("int")
    )
    placed = F.when(down <= size * 0.3, beside).when(down <= size * 2, below >= 2).otherwise(False)
    return (a["page_number"] == b["page_number"]) & (F.length(first) <= 100) & (F.length(second) <= 100) & near & placed


def neighbour_merges(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, merges): whether a block and the next one of its page, downwards, are one heading."""
    order = Window.partitionBy("doc_id", "page_number").orderBy(F.desc("y"), "x", "block_no")
    fields = ("text", "x", "y", "font_size", "page_number")
    rows = blocks.select("doc_id", "block_no", "page_number", F.struct(*fields).alias("a"), F.lead(F.struct(*fields)).over(order).alias("b"))
    return rows.select("doc_id", "block_no", F.coalesce(same_heading(F.col("a"), F.col("b")), F.lit(False)).alias("merges"))


def line_gaps(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, line, n_blocks, mean_gap): mean distance of neighbours on a line, 0 for one block."""
    order = Window.partitionBy("doc_id", "page_number", "line").orderBy("x", "block_no")
    rows = blocks.withColumn("line", F.bround(F.col("y") / 2) * 2)
    gap = F.abs(F.col("x") - F.lag(F.col("x") + F.col("width")).over(order))
    return rows.withColumn("gap", gap).groupBy("doc_id", "page_number", "line").agg(
        F.count("*").alias("n_blocks"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap")
    )


def joined_pieces(pieces: Column) -> Column:
    """The text of pieces (text, x, width) in a row: single letters stick to what they touch, words get spaces."""

    def step(state: Column, piece: Column) -> Column:
        text, before = stripped(piece["text"]), state["last"]
        gap = piece["x"] - state["right"]
        letters = before.rlike(r"^\p{L}+$") & text.rlike(r"^\p{L}+$") & ((F.length(before) == 1) | (F.length(text) == 1))
        capital = text.rlike(r"^\p{Lu}")
        spaced = (
            (gap > 2)
            | ((F.length(before) > 1) & (F.length(text) > 1) & before.rlike(r"\p{L}$") & text.rlike(r"^\p{L}"))
            | ((F.length(before) <= 2) & (F.length(text) == 1) & capital)
            | ((F.length(before) == 1) & (F.length(text) > 1) & capital)
        )
        space = F.when(state["text"].isNull() | ((gap <= 1) & letters) | ~spaced, "").otherwise(" ")
        return F.struct(F.concat(F.coalesce(state["text"], F.lit("")), space, text).alias("text"), text.alias("last"), (piece["x"] + piece["width"]).alias("right"))

    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit("").alias("last"), F.lit(0.0).alias("right"))
    return stripped(F.regexp_replace(F.aggregate(pieces, start, step)["text"], r"\s+", " "))


def reconstructed_lines(blocks: DataFrame) -> DataFrame:
    """Blocks with headings in pieces put together; all others stay as they are.

    Islands over (page, line): a block continues the run if it is closer than a
    font size (0.8 of one for small fonts) and of like size.  A run that looks
    fragmented becomes one block at its first block's place.
    """
    line = Window.partitionBy("doc_id", "page_number", "line").orderBy("x", "block_no")
    rows = blocks.select(*COLUMNS).withColumn("line", F.bround(F.col("y") / 2) * 2)
    right, font = F.lag(F.col("x") + F.col("width")).over(line), F.lag("font_size").over(line)
    widest = font * F.when(font > 15, 1.0).otherwise(0.8)
    begins = right.isNull() | (F.col("x") - right >= widest) | (F.abs(F.col("font_size") - font) >= 5)
    rows = rows.withColumn("gap", F.abs(F.col("x") - right)).withColumn("begins", begins.cast("int"))
    rows = rows.withColumn("run", F.sum("begins").over(line)).withColumn("gap", F.when(F.col("begins") == 0, F.col("gap")))
    piece = F.struct("x", "block_no", *[c for c in COLUMNS if c not in ("x", "block_no", "doc_id", "page_number")])
    own = stripped("text")
    runs = rows.groupBy("doc_id", "page_number", "line", "run").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.count("*").alias("n"),
        F.avg("font_size").alias("mean_font"),
        F.min("font_size").alias("least_font"),
        F.sum(F.length(own)).alias("characters"),
        F.sum((F.length(own) <= 3).cast("int")).alias("short"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"),
    )
    joined = F.array_join(F.transform("pieces", lambda p: stripped(p["text"])), " ")
    is_one = fragmented(*map(F.col, ("n", "mean_font", "least_font", "characters", "short", "mean_gap")), joined)
    first, last = F.element_at("pieces", 1), F.element_at("pieces", -1)
    merged = F.struct(
        first["block_no"].alias("block_no"), joined_pieces(F.col("pieces")).alias("text"), first["x"].alias("x"), first["y"].alias("y"),
        (last["x"] + last["width"] - first["x"]).alias("width"), F.array_max(F.transform("pieces", lambda p: p["height"])).alias("height"),
        first["font_name"].alias("font_name"), first["font_size"].alias("font_size"), first["font_flags"].alias("font_flags"), F.col("n").cast("int").alias("n_merged"),
    )
    alone = F.transform(
        "pieces",
        lambda p: F.struct(
            p["block_no"].alias("block_no"), p["text"].alias("text"), p["x"].alias("x"), p["y"].alias("y"), p["width"].alias("width"), p["height"].alias("height"),
            p["font_name"].alias("font_name"), p["font_size"].alias("font_size"), p["font_flags"].alias("font_flags"), F.lit(1).alias("n_merged"),
        ),
    )
    return runs.select("doc_id", "page_number", F.inline(F.when(is_one, F.array(merged)).otherwise(alone)))


def needs_space(first: str, second: str) -> bool:
    """No space before closing punctuation, behind an opening one, or where there is one."""
    if not first or not second or first[-1] == " " or second[0] == " ":
        return False
    return second[0] not in ",.!?:;)]}" and first[-1] not in "([{"


def mended(text: str) -> str:
    """Single spaces, none before closing punctuation and none behind an opening one."""
    text = " ".join(text.split())
    text = re.sub(r"\s+(?=[,.!?:;)\]}])", "", text)
    return re.sub(r"(?<=[(\[{])\s+", "", text)


def mended_text(text: Column) -> Column:
    """``mended`` as a column expression."""
    single = stripped(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(single, r"\s+([,.!?:;)\]}])", "$1"), r"([(\[{])\s+", "$1")


def _titled(text: str) -> bool:
    return text.istitle() or text.isupper()


def _parts_of_heading(first: str, second: str) -> bool:
    if not second or (second[0].isupper() and (first.endswith(".") or (first.endswith(("!", "?", ":")) and len(second.split()) > 3))):
        return False
    signs = (
        _titled(first) and _titled(second),
        first.endswith(OPEN_ENDS),
        second.split()[0].lower() in CONTINUING_WORDS,
        len(first.split()) <= 4 and len(second.split()) <= 4,
        "." not in first[:-1] and "." not in second[:-1],
    )
    return sum(signs) >= 2


def _same_heading(a: dict, b: dict) -> bool:
    """``same_heading`` of two blocks at hand; the first one's text may have grown."""
    first, second, size = a["text"].strip(), b["text"].strip(), a["font_size"]
    if len(first) > 100 or len(second) > 100 or abs(size - b["font_size"]) > max(2, size * 0.15):
        return False
    down = abs(a["y"] - b["y"])
    if down <= size * 0.3:
        return abs(b["x"] - (a["x"] + len(first) * size * 0.6)) <= size * 1.5
    signs = (abs(a["x"] - b["x"]) <= size, len(first) <= 50 and len(second) <= 50, size >= 12 and b["font_size"] >= 12, _parts_of_heading(first, second))
    return down <= size * 2 and sum(signs) >= 2


def group_page(blocks: list[dict]) -> list[dict]:
    """A page's blocks, downwards, with each heading's pieces joined to its first one.

    A block looks at the next seven that no block before it has taken; what it
    takes makes its text grow, and the grown text is what the next are held to.
    """
    left, out = list(blocks), []
    while left:
        own = dict(left.pop(0), n_merged=1)
        own["text"] = own["text"].strip()
        for other in left[:WINDOW]:
            if _same_heading(own, other):
                text = other["text"].strip()
                own["text"] += " " * needs_space(own["text"], text) + text
                own["n_merged"] += 1
                left.remove(other)
        own["text"] = mended(own["text"])
        out.append(own)
    return out


def is_complete(text: str) -> bool:
    """Ended, a numbered item with its description, or a heading's length without an open end."""
    text = text.strip()
    return (
        text.endswith((".", "?", "!", ":"))
        or bool(re.match(r"^\d+\.\s+.{10,}$", text))
        or (3 <= len(text.split()) <= 15 and not text.endswith(UNFINISHED_WORDS))
    )


def continues(base: dict, other: dict) -> bool:
    """Whether a block close to the base goes on with its text: known phrases, joining words, a number's text."""
    if abs(other["y"] - base["y"]) > 20 or abs(other["x"] - base["x"]) > 100:
        return False
    first, second = base["text"].strip().lower(), other["text"].strip().lower()
    return (
        any(re.search(a, first) and re.search(b, second) for a, b in CONTINUATIONS)
        or first.endswith(JOINING_WORDS)
        or second.startswith(JOINING_WORDS)
        or bool(re.match(r"\d+\.$", first) and re.match(r"[a-zA-Z]", second))
    )


def reconstruct_page(blocks: list[dict]) -> list[dict]:
    """A page's blocks in reading order; a block takes up to five followers while they go on with it and its text is not complete."""
    out, i = [], 0
    while i < len(blocks):
        own, taken = dict(blocks[i], n_merged=1), []
        text = own["text"].strip()
        for other in blocks[i + 1 : i + 1 + STRICT_WINDOW]:
            if not continues(blocks[i], other):
                break
            taken.append(other)
            text = f"{text} {other['text'].strip()}".strip()
            if is_complete(text):
                break
        if taken:
            own |= {"text": text, "width": max(b["width"] for b in (own, *taken)), "height": sum(b["height"] for b in (own, *taken)), "n_merged": 1 + len(taken)}
        out.append(own)
        i += 1 + len(taken)
    return out


def _by_page(blocks: DataFrame, fold, order: list[str], ascending: list[bool]) -> DataFrame:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, ascending=ascending, kind="stable")
        return pd.DataFrame(fold(own.to_dict("records")), columns=names)

    wanted = blocks.select(*COLUMNS).withColumn("block_no", F.col("block_no").cast("int")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return wanted.groupBy("doc_id", "page_number").applyInPandas(run, _SCHEMA)


def grouped_fragments(blocks: DataFrame) -> DataFrame:
    """Blocks with the pieces of headings grouped, ``n_merged`` to each."""
    return _by_page(blocks, group_page, ["y", "x", "block_no"], [False, True, True])


def reconstructed_text(blocks: DataFrame) -> DataFrame:
    """Blocks with unfinished texts continued by their followers (the strict variant)."""
    return _by_page(blocks, reconstruct_page, ["y", "x", "block_no"], [True, True, True])


def heading_order(upwards: bool) -> list[Column]:
    """Order of headings in a document: by page, then from the largest y (upwards coordinates) or the smallest."""
    return [F.col("page_number"), F.desc("y") if upwards else F.asc("y"), F.col("x"), F.col("block_no")]
