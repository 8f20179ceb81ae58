"""Text rules as column expressions; all stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: ColumnOrName) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def words(text: ColumnOrName) -> Column:
    """The words between runs of white space; none for an empty text."""
    return F.filter(F.split(_col(text), r"\s+"), lambda w: w != "")


def word_count(text: ColumnOrName) -> Column:
    return F.size(words(text))


def distinct_words(text: ColumnOrName) -> Column:
    return F.size(F.array_distinct(words(F.lower(_col(text)))))


def count_of(text: ColumnOrName, *parts: str) -> Column:
    """How often the parts (of one character each) occur, together."""
    text = _col(text)
    return F.length(text) - F.length(F.translate(text, "".join(parts), ""))


def alternation(terms: Iterable[str]) -> str:
    """One pattern that finds any of the terms; a single pass over the text."""
    return "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)


def contains_any(text: ColumnOrName, terms: Iterable[str]) -> Column:
    """True if any of the (lower-case) terms occurs in the lower-cased text, inside words too."""
    return F.lower(_col(text)).rlike(alternation(terms))


def hits(text: ColumnOrName, terms: Iterable[str]) -> Column:
    """How many of the terms occur in the lower-cased text."""
    low = F.lower(_col(text))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def is_upper(text: ColumnOrName) -> Column:
    text = _col(text)
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_title(text: ColumnOrName) -> Column:
    """Upper case only behind uncased characters, lower case only behind cased ones."""
    text = _col(text)
    return (
        text.rlike(r"[\p{Lu}\p{Lt}]")
        & ~text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]")
        & ~text.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
    )


def cut_with_dots(text: ColumnOrName, size: int) -> Column:
    text = _col(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def best_topic(text: ColumnOrName, topics: dict[str, tuple[str, ...]]) -> Column:
    """The topic with most hits, the first of equals; null without any hit."""
    options = F.array(*[F.struct(hits(text, terms).alias("n"), F.lit(-i).alias("order"), F.lit(t).alias("topic")) for i, (t, terms) in enumerate(topics.items())])
    best = F.array_max(options)
    return F.when(best["n"] > 0, best["topic"])


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a group joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)
