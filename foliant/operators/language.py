"""Languages: dimension table, identification by frequent words, normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import stripped

# Code, name, family, written right to left, complex script.
LANGUAGES = (
    ("en", "English", "Germanic", False, False),
    ("es", "Spanish", "Romance", False, False),
    ("fr", "French", "Romance", False, False),
    ("de", "German", "Germanic", False, False),
    ("it", "Italian", "Romance", False, False),
    ("pt", "Portuguese", "Romance", False, False),
    ("nl", "Dutch", "Germanic", False, False),
    ("ru", "Russian", "Slavic", False, False),
    ("ja", "Japanese", "Japonic", False, True),
    ("ko", "Korean", "Koreanic", False, True),
    ("zh", "Chinese", "Sino-Tibetan", False, True),
    ("hi", "Hindi", "Indo-European", False, True),
    ("th", "Thai", "Tai-Kadai", False, True),
    ("vi", "Vietnamese", "Austroasiatic", False, False),
    ("ar", "Arabic", "Semitic", True, True),
    ("he", "Hebrew", "Semitic", True, True),
    ("fa", "Persian", "Indo-European", True, True),
    ("tr", "Turkish", "Turkic", False, False),
    ("pl", "Polish", "Slavic", False, False),
    ("sv", "Swedish", "Germanic", False, False),
    ("no", "Norwegian", "Germanic", False, False),
    ("da", "Danish", "Germanic", False, False),
)
FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with"),
    "fr": ("le", "la", "les", "des", "et", "que", "qui", "dans", "une", "pour"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf"),
    "es": ("el", "los", "las", "del", "que", "por", "con", "una", "para", "es"),
}
ASIAN_PUNCTUATION = (("。", ". "), ("、", ", "))


def dimension(spark: SparkSession) -> DataFrame:
    """(code, name, family, rtl, complex_script), 22 rows."""
    return spark.createDataFrame(list(LANGUAGES), "code string, name string, family string, rtl boolean, complex_script boolean")


def with_language_metadata(rows: DataFrame, code_col: str) -> DataFrame:
    """``rows`` with name, family, rtl and complex_script of a language; unknown codes are Unknown."""
    table = F.broadcast(dimension(rows.sparkSession).withColumnRenamed("code", "_code"))  # 22 rows
    return rows.join(table, F.col(code_col) == F.col("_code"), "left").drop("_code").withColumns(
        {"name": F.coalesce("name", F.lit("Unknown")), "family": F.coalesce("family", F.lit("Unknown")), "rtl": F.coalesce("rtl", F.lit(False)),
         "complex_script": F.coalesce("complex_script", F.lit(False))}
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; a plain column is computed anew at every use in a lambda."""
    return F.transform(F.array(value), use)[0]


def frequent_words(text: Column) -> Column:
    """All words in the text's beginning that are frequent in some language, repeats too."""
    some = sorted({w for own in FREQUENT.values() for w in own})
    return F.filter(F.split(F.lower(F.substring(text, 1, 1000)), r"\s+"), lambda w: w.isin(some))


#: Log odds, in tenths, that a frequent word of one language speaks for it against another.
ODDS = 20


def probabilities(text: Column) -> Column:
    """Array of (lang, prob) of all languages, likeliest first, from the frequent words in the text's beginning.

    Every frequent word speaks for the languages that have it with the same
    odds, so probabilities are those of a model of independent words; without
    any such word all languages are equally likely.
    """

    def counted(found: Column) -> Column:
        counts = [F.size(F.filter(found, lambda w: w.isin(*own))) for own in FREQUENT.values()]
        rows = [F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("lang")) for i, (code, n) in enumerate(zip(FREQUENT, counts))]
        return F.sort_array(F.array(*rows), asc=False)

    def weighed(ordered: Column) -> Column:
        most = F.element_at(ordered, 1)["n"]
        return F.transform(ordered, lambda c: F.struct(c["lang"].alias("lang"), F.exp((c["n"] - most) * (ODDS / 10)).alias("w")))

    def shared(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda t, x: t + x["w"])
        return bound(total, lambda t: F.transform(weights, lambda x: F.struct(x["lang"].alias("lang"), (x["w"] / t).alias("prob"))))

    return bound(bound(bound(frequent_words(text), counted), weighed), shared)


def identified(text: Column, fallback: str = "en", least: float = 0.8) -> Column:
    """The likeliest language if its probability reaches the bound; short texts and doubtful ones give the fallback."""

    def judged(best: Column) -> Column:
        doubtful = (best["prob"] < least) | (best["lang"] == fallback)  # these need no measuring
        return F.when(doubtful | (F.length(stripped(text)) < 50), fallback).otherwise(best["lang"])

    return bound(F.element_at(probabilities(text), 1), judged)


def shares(text: Column, least: float = 0.3) -> Column:
    """Array of (lang, prob) of the languages with a probability of at least 0.3; English alone where there is none."""
    english = F.array(F.struct(F.lit("en").alias("lang"), F.lit(1.0).alias("prob")))
    return bound(F.filter(probabilities(text), lambda x: x["prob"] >= least), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(english))


def preprocessed(text: Column, language: Column) -> Column:
    """Trimmed; Chinese, Japanese and Korean also with single spaces, plain punctuation and half-width forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    asian = F.regexp_replace(text, r"(?U)\s+", " ")  # wide spaces too
    for mark, plain in ASIAN_PUNCTUATION:
        asian = F.replace(asian, F.lit(mark), F.lit(plain))
    return stripped(F.when(language.isin("zh", "ja", "ko"), F.translate(asian, wide, narrow)).otherwise(text))


def composed(text: Column) -> Column:
    """Unicode compatibility composition (NFKC)."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)

    return normal(text)


def normalised(text: Column) -> Column:
    return F.lower(stripped(text))


def multilingual_documents(blocks: DataFrame, samples: int = 10) -> DataFrame:
    """(doc_id, is_multilingual): more than one language in a sample of long blocks, of documents with five or more.

    Long blocks are identified where they are read, so that no text is shuffled;
    the sample is then taken of small rows, with one shuffle for all windows.
    A document of null id is never multilingual.
    """
    spoken = blocks.select("doc_id", "block_no", F.when(F.length("text") > 50, identified(F.col("text"))).alias("language"))
    document = Window.partitionBy("doc_id").orderBy("block_no")
    whole = document.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = spoken.select("doc_id", "block_no", "language", (F.row_number().over(document) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    step = F.greatest(F.floor(F.col("n") / samples), F.lit(1))
    sample = numbered.withColumn("language", F.when(F.col("i") % step == 0, F.col("language")))
    nth = F.count("language").over(document.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = sample.withColumn("language", F.when(nth <= samples, F.col("language")))
    several = F.coalesce(F.min("language") != F.max("language"), F.lit(False)) & F.col("doc_id").isNotNull()
    return picked.groupBy("doc_id").agg(((F.max("n") >= 5) & several).alias("is_multilingual"))
