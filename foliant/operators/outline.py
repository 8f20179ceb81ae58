"""Outlines from headings: titles, document kinds, cleaning, levels, entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import count_of, hits, is_upper, stripped, word_count, words
from foliant.operators.headings import any_of
from foliant.sources.work import written

# Word lists and patterns of titles and headings.
NO_TITLE = (
    r"copyright\s*©?\s*\d{4}",
    r"all\s+rights\s+reserved",
    r"©|®|™",
    r"^version\s+\d+",
    r"^v\d+\.\d+",
    r"\.(pdf|doc|docx|txt)$",
    r"^[a-zA-Z]:\\",
    r"/[a-zA-Z0-9_.-]+/",
    r"(department|ministry|government)\s+of",
    r"by\s+[a-zA-Z]+\s+[a-zA-Z]+",
    r"^page\s+\d+",
    r"^\d+\s+of\s+\d+$",
    r"^.{1,3}$",
    r"^.{100,}$",
)
GOOD_TITLE = (
    r"application\s+form",
    r"registration\s+form",
    r"claim\s+form",
    r"request\s+form",
    r"(manual|guide|handbook)",
    r"(report|analysis|study)",
    r"(syllabus|curriculum|overview)",
    r"foundation\s+level",
    r"level\s+extensions?",
    r"testing\s+(qualifications?|board)",
    r"software\s+testing",
    r"request\s+for\s+proposal",
    r"rfp:",
    r"digital\s+library",
    r"stem\s+pathways?",
)
TITLE_CASE_WORDS = r"^[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"
INVITATIONS = ("hope to see you", "see you there", "join us", "please attend", "you are invited", "rsvp", "save the date")
FIELD_NAMES = (
    "date", "name", "address", "phone", "email", "designation", "amount", "amount of advance required", "purpose", "duration",
    "place", "headquarters", "office", "employee code", "pay scale",
)
TITLE_CONTENT = (
    "i declare", "i certify", "the undersigned", "signature of", "please fill", "for office use", "date of birth", "address",
)
TITLE_KEYWORDS = (
    "application", "form", "overview", "manual", "guide", "handbook", "report", "analysis", "study", "syllabus", "curriculum",
    "certification", "foundation", "level", "extension", "testing", "qualification", "proposal", "request", "rfp", "pathways",
    "stem", "digital", "library",
)
SCORED_FIELDS = ("date", "name", "amount", "address", "phone", "email", "designation", "signature")
FINAL_NO_TITLE = (r"page\s+\d+", r"^\d+$", r"^[a-zA-Z]$", "confidential", "draft", "internal")
FORM_TITLES = (
    "application form", "registration form", "request form", "claim form", "grant form", "advance form", "ltc advance",
    "loan application", "leave application", "form for",
)
STRONG_FORM_TITLES = ("application form", "ltc advance", "grant form")
FORM_FIELDS = (
    "amount of advance", "name of", "date of", "employee code", "pay scale", "headquarters to", "shortest route", "fare",
    "place to be visited", "duration", "purpose", "designation", "service", "whether", "block for which", "concession",
    "entitled to", "permanent or temporary", "pay +", "government servant", "employee id", "department", "office", "section",
    "unit", "basic pay", "grade pay", "allowances", "deductions", "signature", "date:", "place:", "station", "district",
    "advance required", "relationship", "age", "s.no", "entering", "central government", "amount", "rs.",
)
FORM_FIELD_NAMES = ("date", "name", "service", "designation", "station", "office", "rs.", "amount")
DECLARATIONS = ("i declare", "i certify", "i undertake", "i hereby", "certified that", "declaration", "undertaking")
EVENT_PHRASES = (
    "hope to see you", "see you there", "join us", "please attend", "you are invited", "rsvp", "save the date", "shoes required",
    "closed toed shoes", "address:", "topjump", "climbing",
)
EVENT_LOGISTICS = (
    r"^(rsvp|address|phone|email|contact):?\s*",
    r"shoes?\s+(required|needed)",
    r"closed\s+toed?\s+shoes?",
    r"(required|needed)\s+for\s+",
    r"are\s+required",
    r"\(.*\)",
    r"www\.",
    r"\.com",
    r"near\s+\w+",
    r"so\s+your\s+child",
    r"can\s+attend",
    r"topjump\s+address",
)
EVENT_WELCOME = (r"hope\s+to\s+see", r"see\s+you\s+there", r"join\s+us", "welcome", "celebrate")
STANDARD_SECTIONS = (
    "introduction", "overview", "summary", "conclusion", "abstract", "appendix", "bibliography", "glossary", "references",
    "acknowledgements", "background", "methodology", "table of contents", "revision history", "contents", "preface", "foreword",
    "index",
)
MAIN_SECTIONS = ("introduction", "overview", "background", "summary", "conclusion", "references", "abstract", "methodology")
TOP_SECTIONS = (
    r"^(introduction|overview|summary|conclusion|abstract|appendix|bibliography|glossary|references|acknowledgements|background"
    r"|methodology|table\s+of\s+contents|revision\s+history)$"
)
LINKS = ("http://", "https://", "www.", "@", ".com", ".org", ".net", ".edu")


def _plain(terms) -> str:
    return "|".join(re.escape(t).replace("\\ ", " ") for t in terms)


def title_candidate(text: Column) -> Column:
    own = stripped(text)
    low = F.lower(own)
    return (
        F.length(own).between(5, 100)
        & ~own.rlike(any_of(NO_TITLE))
        & ~own.rlike(r"^[-=_*+.]{3,}$")
        & ~low.rlike(_plain(INVITATIONS))
        & ~low.isin(*FIELD_NAMES)
        & ~low.rlike(_plain(TITLE_CONTENT))
    )


def title_score(text: Column, page: Column, font_size: Column, pattern_type: Column) -> Column:
    """Hundredths."""
    own = stripped(text)
    low, size, n = F.lower(own), F.length(own), word_count(own)
    matches = hits(own, TITLE_KEYWORDS)
    good = own.rlike(any_of(GOOD_TITLE)) | own.rlike(TITLE_CASE_WORDS)
    ladder = lambda a, b, c, d: F.when(font_size >= 24, a).when(font_size >= 20, b).when(font_size >= 16, c).when(font_size >= 14, d).otherwise(0)
    return (
        F.when(size.between(20, 60) & (n >= 2), 60).when(size.between(15, 80) & (n >= 2), 40).when(size.between(10, 100), 20)
        .when((n == 1) & size.between(5, 15), 10).otherwise(0)
        + F.when(matches >= 3, 120).when(matches == 2, 100).when(matches == 1, 60).otherwise(0)
        + F.when(good, 30).otherwise(0)
        + F.when(page == 1, 30).otherwise(0)
        + F.when((matches > 0) | good, ladder(100, 80, 60, 40)).otherwise(ladder(30, 20, 10, 0))
        - F.when(low.rlike(_plain(SCORED_FIELDS)), 100).otherwise(0)
        - F.when(own.endswith(".") & (F.length(text) < 50), 50).otherwise(0)
        + F.when(pattern_type == "centered", 40).when(pattern_type == "font", 20).otherwise(0)
    )


def picked_titles(headings: DataFrame, least: int = 150) -> DataFrame:
    """(doc_id, title, score): the best candidate of the first page, the first of equals, if good enough."""
    scored = headings.where("page_number = 1").where(title_candidate(F.col("text"))).select(
        "doc_id", "block_no", stripped("text").alias("title"), title_score(F.col("text"), F.col("page_number"), F.col("font_size"), F.col("pattern_type")).alias("score")
    )
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("title", "score"), F.struct("score", -F.col("block_no"))).alias("b"))
    return best.select("doc_id", "b.title", "b.score").where(F.col("score") >= least)


def valid_title(title: Column) -> Column:
    return (F.length(stripped(title)) >= 5) & ~stripped(title).rlike(any_of(FINAL_NO_TITLE))


def form_documents(headings: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, is_form): a form's title and mostly field labels or a declaration below it."""
    low = F.lower(stripped("text"))
    short = ((word_count(low) == 1) & (F.length(low) <= 4)) | low.rlike(r"^\d+\.$") | low.rlike(r"^\d+\.\s*\d+\.$")
    field = (low.rlike(_plain(FORM_FIELDS)) | low.isin(*FORM_FIELD_NAMES)).cast("int") + short.cast("int")
    sums = headings.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.sum(field).alias("fields"),
        F.sum(low.rlike(_plain(DECLARATIONS)).cast("int")).alias("declarations"),
        F.sum(((F.length(low) <= 5) | low.rlike(r"^\d+\.?\s*$")).cast("int")).alias("labels"),
    )
    joined = titles.join(sums, "doc_id", "left")
    title = F.lower("title")
    filled = (
        F.col("n").isNull()
        | (F.col("fields") > F.col("n") * 0.4)
        | (F.col("declarations") > 0)
        | ((F.col("n") <= 3) & title.rlike(_plain(STRONG_FORM_TITLES)))
        | (F.col("labels") > F.col("n") * 0.6)
    )
    return joined.select("doc_id", (title.rlike(_plain(FORM_TITLES)) & filled).alias("is_form"))


def event_documents(headings: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, is_event): at least three phrases of an invitation in the headings."""
    joined = headings.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "y", "block_no", "text"))), lambda h: F.lower(h["text"])), " ").alias("whole")
    )
    n = hits(F.col("whole"), EVENT_PHRASES)
    return joined.select("doc_id", n.alias("n_phrases"), (n >= 3).alias("is_event"))


def document_heading(text: Column, is_event: Column) -> Column:
    own = stripped(text)
    low, n, size = F.lower(own), word_count(own), F.length(own)
    numbered = own.rlike(r"^\d+\.\s+[A-Za-z]|^\d+\.\d+\s+[A-Za-z]|^\d+\.\d+\.\d+\s+[A-Za-z]")
    sentence = (n > 15) | own.contains(".") | own.contains("●") | (count_of(own, ",") > 2)
    named = (
        low.isin(*STANDARD_SECTIONS)
        | (own.endswith(":") & n.between(2, 8))
        | (is_upper(own) & n.between(2, 6))
        | own.rlike(r"(?i)^(chapter|section|part|appendix)\s+[A-Z0-9]")
        | (own.endswith("?") & n.between(3, 12))
        | (n.between(1, 12) & own.rlike(r"^\p{Lu}") & ((n > 1) | (size >= 4)))
    )
    plain = F.when(numbered, n <= 15).when(sentence, F.lit(False)).otherwise(named)
    at_event = (
        F.when(low.rlike(any_of(EVENT_LOGISTICS, "")), F.lit(False))
        .when(low.rlike(any_of(EVENT_WELCOME, "")), F.lit(True))
        .when((n <= 2) & ~low.rlike(r"[:()]"), F.lit(False))
        .otherwise(plain)
    )
    return F.when(~size.between(3, 120), F.lit(False)).when(is_event, at_event).otherwise(plain)


def content_not_heading(text: Column) -> Column:
    low, n = F.lower(stripped(text)), word_count(text)
    punctuation = F.length(text) - F.length(F.regexp_replace(text, r"[.,;!?()\[\]{}]", ""))
    return ((F.length(low) <= 4) & (n == 1)) | (n > 15) | low.rlike(_plain(LINKS)) | (punctuation > 2)


def title_component(text: Column, title: Column) -> Column:
    """The heading repeats a part of the title: one to three of its words, or nine tenths of its own words."""
    low, own = F.lower(stripped(text)), words(F.lower(title))
    last = F.size(own) - 1
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(last - i + 1, F.lit(1)))), lambda n: F.array_join(F.slice(own, i + 1, n), " ")),
        )
    )
    near = lambda c: (low == c) | ((F.length(c) > 5) & F.contains(low, c)) | ((F.length(low) > 5) & F.contains(c, low))
    mine = F.array_distinct(words(low))
    overlap = F.size(F.array_intersect(mine, own))
    return (F.size(own) > 0) & (F.exists(parts, near) | ((overlap >= F.size(mine) * 0.9) & (F.size(mine) > 0) & (F.length(low) > 10)))


def similar_texts(a: str, b: str) -> bool:
    if a in b or b in a:
        return True
    x, y = set(a.split()), set(b.split())
    if x <= y or y <= x:
        return True
    share = len(x & y) / min(len(x), len(y))
    both = re.match(r"\d+\.", a) and re.match(r"\d+\.", b)
    return share > (0.9 if both else 0.8)


def distinct_headings(headings: DataFrame) -> DataFrame:
    """Per document, greedily in reading order: headings similar to an accepted one go."""
    schema = headings.schema

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["page_number", "y", "block_no"], kind="stable")
        kept, seen = [], []
        for i, text in enumerate(own.text):
            norm = " ".join(text.lower().split())
            if 2 <= len(text.strip()) <= 150 and not any(similar_texts(norm, s) for s in seen):
                kept.append(i)
                seen.append(norm)
        return own.iloc[kept]

    return headings.groupBy("doc_id").applyInPandas(fold, schema)


def numbered_text(text: Column) -> Column:
    """Main sections without a number get ``1. ``."""
    low = F.lower(stripped(text))
    main = low.isin(*MAIN_SECTIONS) | low.rlike("(section|overview)$") | low.startswith("introduction")
    return F.when(main & ~stripped(text).rlike(r"^\d+\."), F.concat(F.lit("1. "), stripped(text))).otherwise(text)


_TWO_NUMBERS = re.compile(r"(\d+\.\d+\s+[^0-9]+?)(\d+\.\d+(?:\s+|$))")
_NUMBER_TAIL = re.compile(r"(\d+\.\d+)\s*(.*)")
_TWO_PHRASES = re.compile(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)")


def split_heading(text: str) -> list[str]:
    """The headings a concatenated one holds; itself if it is one."""
    text = text.strip()
    parts: list[str] = []
    for m in _TWO_NUMBERS.finditer(text):
        if m[1].strip():
            parts.append(m[1].strip())
        tail = _NUMBER_TAIL.match(text[m.start(2) :])
        if tail:
            parts.append(f"{tail[1]} {tail[2]}".strip())
    if parts:
        return parts
    m = _TWO_PHRASES.match(text)
    if m and len(m[1].split()) >= 2 and len(m[2].split()) >= 2:
        return [m[1].strip(), m[2].strip()]
    return [text]


def split_headings(headings: DataFrame) -> DataFrame:
    """One row per part with ``part_no``; parts of a split heading lose a tenth of their confidence."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_heading)

    parts = headings.withColumn("parts", split("text"))
    confidence = F.when(F.size("parts") > 1, F.col("confidence") * 0.9).otherwise(F.col("confidence").cast("double"))
    whole = parts.withColumn("confidence", confidence)
    others = [c for c in headings.columns if c != "text"]
    return whole.select(*others, F.posexplode("parts").alias("part_no", "text"))


def outline_levels(headings: DataFrame) -> DataFrame:
    """Headings with level by number and name, else by the document's two largest fonts."""
    ladder = F.reverse(F.array_sort(F.collect_set("font_size").over(Window.partitionBy("doc_id"))))
    own, size = stripped("text"), F.col("font_size")
    second = F.try_element_at("ladder", F.lit(2))
    level = (
        F.when(own.rlike(r"^\d+\.\s+[A-Za-z]"), "H1")
        .when(own.rlike(r"^\d+\.\d+\s+[A-Za-z]"), "H2")
        .when(own.rlike(r"^\d+\.\d+\.\d+\s+[A-Za-z]"), "H3")
        .when(F.lower(own).rlike(TOP_SECTIONS) | F.lower(own).rlike(r"^(introduction|overview)\s+to\s+") | own.rlike(r"(?i)^(chapter|part|section)\s+\d+"), "H1")
        .when(size >= F.element_at("ladder", 1) * 0.95, "H1")
        .when(second.isNotNull() & (size >= second * 0.9), "H2")
        .when(size >= 12, "H2")
        .otherwise("H3")
    )
    return headings.withColumn("ladder", ladder).withColumn("level", level).drop("ladder")


def outline_entries(headings: DataFrame) -> DataFrame:
    """(doc_id, entry_no, level, text, page); a document of one page has page 0."""
    document = Window.partitionBy("doc_id")
    page = F.when((F.max("page_number").over(document) == 1) & (F.col("page_number") == 1), 0).otherwise(F.col("page_number"))
    order = document.orderBy("page_number", "y", "block_no")
    return headings.select("doc_id", F.row_number().over(order).alias("entry_no"), "level", stripped("text").alias("text"), page.alias("page"))


def without_repeated_words(text: Column) -> Column:
    """Consecutive repeats of a word become one."""
    own = words(text)
    before = F.concat(F.array(F.lit("")), F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
    pairs = F.zip_with(own, before, lambda w, b: F.struct(w.alias("w"), b.alias("b")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: F.lower(p["w"]) != F.lower(F.coalesce(p["b"], F.lit("")))), lambda p: p["w"]), " ")


def build_outline(headings: DataFrame) -> DataFrame:
    """Outlines of documents (doc_id, title, outline) from detected headings; forms have an empty one."""
    headings = written(headings, "headings")  # several branches read them
    titles = picked_titles(headings)
    kinds = event_documents(headings).join(titles.select("doc_id", "title"), "doc_id", "left").join(form_documents(headings, titles), "doc_id", "left")
    rows = headings.join(kinds, "doc_id").where(~F.coalesce("is_form", F.lit(False)))
    rows = rows.where(document_heading(F.col("text"), F.col("is_event"))).where(~F.coalesce(title_component(F.col("text"), F.col("title")), F.lit(False)))
    cleaned = distinct_headings(rows.select(headings.columns))
    leveled = outline_levels(split_headings(cleaned).withColumn("text", numbered_text(F.col("text"))).drop("level", "part_no"))
    entries = outline_entries(leveled).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "level", "text", "page"))).alias("outline"))
    return kinds.select("doc_id", F.coalesce("title", F.lit("")).alias("title")).join(entries, "doc_id", "left")
