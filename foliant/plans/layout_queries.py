"""Queries on blocks, layout and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions.text import contains_any
from foliant.operators import layout, ocr_merge, sections, segments
from foliant.plans import sql as S
from foliant.plans.pipeline import page_sections_of
from foliant.sources import documents as files
from foliant.sources.blocks import COLUMNS, blocks_from_documents, blocks_from_pages

#: The demonstration lexicon: terms that the invented texts do hold.
DEMO_TERMS = ("inn", "eat", "area", "art", "tour")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_documents(read(spark, sf_dir, "documents"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_pages(read(spark, sf_dir, "pages"))


QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


ALL = ", ".join(COLUMNS)
query("blocks_from_documents", f"WITH {S.BLOCKS} SELECT {ALL} FROM blocks")(lambda s, d: blocks(s, d).select(*COLUMNS))
query("blocks_from_pages", f"WITH {S.PAGE_BLOCKS} SELECT {ALL} FROM blocks")(lambda s, d: page_blocks(s, d).select(*COLUMNS))


@query(
    "document_envelope",
    f"""WITH {S.BLOCKS}, e AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text_content, max(page_number) AS page_count
        FROM blocks GROUP BY doc_id)
        SELECT doc_id, text_content, length(text_content) AS content_length, trim(text_content) <> '' AS has_text, page_count FROM e""",
)
def document_envelope(s, d):
    return files.envelope(blocks(s, d))


@query("page_texts", f"WITH {S.BLOCKS} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY ALL")
def page_texts(s, d):
    return files.page_texts(blocks(s, d))


@query("validated_documents", f"WITH {S.BLOCKS} SELECT doc_id, max(length(trim(text))) > 0 AS is_valid FROM blocks GROUP BY doc_id")
def validated_documents(s, d):
    return files.validated(blocks(s, d))


@query("font_histogram", f"WITH {S.PAGE_BLOCKS} SELECT doc_id, round_even(font_size, 1) AS font_size, count(*) AS n FROM blocks GROUP BY ALL")
def font_histogram(s, d):
    return layout.font_histogram(page_blocks(s, d))


@query(
    "font_analysis",
    f"""WITH {S.PAGE_BLOCKS}, h AS (SELECT doc_id, font_size, count(*) AS n FROM blocks GROUP BY ALL)
        SELECT doc_id, arg_max(font_size, n * 1000 - font_size) AS most_common_size, max(font_size) AS largest_size, count(*) AS size_variety
        FROM h GROUP BY doc_id""",
)
def font_analysis(s, d):
    return layout.font_analysis(page_blocks(s, d)).select("doc_id", "most_common_size", "largest_size", "size_variety")


@query(
    "structure_stats",
    f"""WITH {S.BLOCKS} SELECT doc_id, count(*) AS total_blocks, count(DISTINCT page_number) AS pages_with_text,
        round(count(*) / count(DISTINCT page_number), 6) AS avg_blocks_per_page,
        round(count(DISTINCT page_number) / max(page_number), 6) AS text_coverage FROM blocks GROUP BY doc_id""",
)
def structure_stats(s, d):
    own = layout.structure_statistics(blocks(s, d))
    return own.withColumns({c: F.round(c, 6) for c in ("avg_blocks_per_page", "text_coverage")})


@query(
    "scanned_documents",
    f"""WITH {S.BLOCKS} SELECT doc_id, count(*) / max(page_number) < 5 OR avg((length(text) < 3)::INT) > 0.5 AS is_scanned FROM blocks GROUP BY doc_id""",
)
def scanned_documents(s, d):
    return layout.scanned_documents(blocks(s, d))


@query(
    "script_language",
    f"""WITH {S.BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS rn FROM blocks),
        c AS (SELECT doc_id, rn, CASE WHEN regexp_matches(text, '[぀-ヿ一-龯]') THEN 'ja' WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' END AS script
              FROM n WHERE rn <= 50 AND length(text) > 5)
        SELECT doc_id, coalesce(arg_min(script, rn) FILTER (script IS NOT NULL), 'en') AS language FROM c GROUP BY doc_id""",
)
def script_language(s, d):
    return layout.script_language(blocks(s, d))


@query("font_flags", f"""WITH {S.PAGE_BLOCKS} SELECT DISTINCT font_name,
    (CASE WHEN contains(font_name, 'bold') THEN 16 ELSE 0 END) | (CASE WHEN regexp_matches(font_name, 'italic|oblique') THEN 64 ELSE 0 END) AS flags
    FROM (SELECT unnest([font_name, font_name || '-Bold', font_name || '-BoldOblique', font_name || ' Italic']) AS raw, lower(raw) AS font_name FROM blocks)""")
def font_flags(s, d):
    names = F.explode(F.array("font_name", *[F.concat("font_name", F.lit(t)) for t in ("-Bold", "-BoldOblique", " Italic")]))
    own = page_blocks(s, d).select(names.alias("raw")).select(F.lower("raw").alias("font_name")).distinct()
    return own.select("font_name", layout.font_flags_of(F.col("font_name")).cast("int").alias("flags"))


@query("layout_groups", f"WITH {S.GROUPED} SELECT doc_id, block_no, CAST(group_no AS INTEGER) AS group_no, group_size FROM grouped")
def layout_groups(s, d):
    return layout.group_blocks(blocks(s, d)).select("doc_id", "block_no", "group_no", "group_size")


@query(
    "merged_blocks",
    f"""WITH {S.GROUPED}, sizes AS (SELECT doc_id, group_no, font_size, font_name, font_flags, count(*) AS k FROM grouped GROUP BY ALL),
        m AS (SELECT doc_id, group_no, arg_max(font_size, k * 1000 - font_size) AS font_size FROM
              (SELECT doc_id, group_no, font_size, sum(k) AS k FROM sizes GROUP BY ALL) GROUP BY ALL)
        SELECT g.doc_id, CAST(g.group_no AS INTEGER) AS group_no, string_agg(text, ' ' ORDER BY page_number, y, x, block_no) AS text, min(x) AS x, min(y) AS y,
          max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, any_value(m.font_size) AS font_size,
          arg_min(page_number, block_no) AS page_number, count(*) AS n_blocks
        FROM grouped g JOIN m ON m.doc_id = g.doc_id AND m.group_no = g.group_no GROUP BY g.doc_id, g.group_no""",
)
def merged_blocks(s, d):
    return layout.merge_groups(layout.group_blocks(blocks(s, d))).drop("font_name", "font_flags")


@query(
    "recipe_documents",
    f"WITH {S.BLOCKS} SELECT doc_id, avg({S.any_term('text', DEMO_TERMS)}::INT) >= 0.08 AS is_recipe FROM blocks GROUP BY doc_id",
)
def recipe_documents(s, d):
    return sections.recipe_documents(blocks(s, d), keywords=DEMO_TERMS)


_LOW = "regexp_replace(lower(text), '^:+|:+$', '', 'g')"


@query(
    "bold_heading_candidates",
    f"""WITH {S.BLOCKS} SELECT doc_id, block_no, text FROM blocks
        WHERE font_flags = 20 AND {S.n_words('text')} >= 2 AND length(text) >= 3
          AND NOT ({_LOW} IN ({", ".join(map(S.lit, C.TRIVIAL_HEADINGS))}) OR {S.rlike(_LOW, "^(" + "|".join(C.TRIVIAL_HEADINGS) + "):")})""",
)
def bold_heading_candidates(s, d):
    own = blocks(s, d)
    return own.where(sections.bold_heading(F.col("text"), F.col("font_flags"))).select("doc_id", "block_no", "text")


@query(
    "page_fallback_sections",
    f"WITH {S.SECTIONS} SELECT doc_ord AS doc_id, page_number, section_no, title, content FROM sections",
)
def page_fallback_sections(s, d):
    return page_sections_of(blocks(s, d)).select(F.col("doc_ord").alias("doc_id"), "page_number", "section_no", "title", "content")


query("standard_sections")(lambda s, d: sections.standard_sections(blocks(s, d)))
query("recipe_sections")(lambda s, d: sections.recipe_sections(blocks(s, d), ("the", "de", "der"), ("and", "que", "und")))


@query(
    "recipe_titles",
    f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents)
        SELECT doc_id, CASE {" ".join(f"WHEN contains(low, {S.lit(t)}) THEN {S.lit(t.title() + ' Recipe')}" for t in C.RECIPE_FOODS)}
          {" ".join(f"WHEN contains(low, {S.lit(t)}) THEN {S.lit(t.title() + ' Dish')}" for t in C.COOKING_METHODS)} ELSE 'Recipe ' || doc_id END AS title FROM t""",
)
def recipe_titles(s, d):
    return read(s, d, "documents").select("doc_id", sections.recipe_title(F.col("text"), F.col("doc_id")).alias("title"))


@query(
    "text_classifier",
    f"""WITH {S.BLOCKS}, c AS (SELECT doc_id, block_no, text, CASE WHEN length(text) < 5 THEN 1 WHEN {S.is_upper('text')} OR {S.is_title('text')} THEN 2
          WHEN regexp_matches(text, '[0-9]') AND regexp_matches(lower(text), 'table|figure') THEN 3 WHEN {S.n_words('text')} > 20 THEN 4 ELSE 5 END AS k FROM blocks)
        SELECT doc_id, block_no, ['other', 'heading', 'table', 'body', 'body'][k] AS label, [0.1, 0.8, 0.7, 0.9, 0.5][k]::DOUBLE AS confidence FROM c""",
)
def text_classifier(s, d):
    own = blocks(s, d).select("doc_id", "block_no", segments.block_class(F.col("text")).alias("c"))
    return own.select("doc_id", "block_no", "c.label", F.col("c.confidence").cast("double").alias("confidence"))


@query(
    "segments",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)),
            lambda t: {S.stripped('t')}), lambda t: t <> '') AS parts FROM documents),
        u AS (SELECT doc_id, unnest(range(len(parts))) AS position, unnest(parts) AS text FROM p)
        SELECT doc_id, position, text, CASE WHEN regexp_matches(text, '(?i)\\b(table|column|row)\\b') THEN 'table' WHEN regexp_matches(text, '(?s)```.*```') THEN 'code'
          WHEN regexp_matches(text, '(?i)\\b(figure|image|diagram)\\b') THEN 'figure' WHEN {S.n_words('text')} < 10 AND {S.is_upper('text')} THEN 'heading' ELSE 'paragraph' END AS type FROM u""",
)
def segments_query(s, d):
    own = read(s, d, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return segments.segments(own, "doc_id", "text")


_KINDS = {"english": ("the", "of", "and"), "french": ("les", "des", "que"), "spanish": ("los", "del", "que"), "german": ("der", "und", "die")}


@query(
    "document_kind_vote",
    f"""WITH {S.BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS rn FROM blocks),
        w AS (SELECT doc_id, string_agg(lower(text), ' ' ORDER BY block_no) AS whole FROM n WHERE rn <= 20 GROUP BY doc_id),
        v AS (SELECT doc_id, [{", ".join(S.hits('whole', t) for t in _KINDS.values())}] AS votes FROM w)
        SELECT doc_id, CASE WHEN list_max(votes) > 0 THEN [{", ".join(map(S.lit, _KINDS))}][list_position(votes, list_max(votes))] ELSE 'unknown' END AS kind,
          list_max(votes) AS votes FROM v""",
)
def document_kind_vote(s, d):
    return segments.document_kinds(blocks(s, d), kinds=_KINDS)


_TYPES = segments.DOCUMENT_KINDS


@query(
    "document_type_vote",
    f"""WITH {S.BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS rn FROM blocks),
        w AS (SELECT doc_id, string_agg(lower(text), ' ' ORDER BY block_no) AS whole FROM n WHERE rn <= 20 GROUP BY doc_id),
        v AS (SELECT doc_id, [{", ".join("(" + " + ".join(f"{S.rlike('whole', p)}::INT" for p in ps) + ")" for ps in _TYPES.values())}] AS votes FROM w)
        SELECT doc_id, CASE WHEN list_max(votes) > 0 THEN [{", ".join(map(S.lit, _TYPES))}][list_position(votes, list_max(votes))] ELSE 'unknown' END AS kind,
          list_max(votes) AS votes FROM v""",
)
def document_type_vote(s, d):
    return segments.document_kinds(blocks(s, d))


@query(
    "heading_intervals",
    f"""WITH {S.BLOCKS}, pages_ AS (SELECT doc_id, page_number - 1 AS page_idx, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY ALL),
        spots AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS position FROM blocks),
        h AS (SELECT doc_id, block_no AS heading_no, page_number - 1 AS page_idx, position, text FROM spots WHERE font_flags = 20),
        sp AS (SELECT *, lead(page_idx) OVER (PARTITION BY doc_id ORDER BY page_idx, position, heading_no) AS end_page,
               lead(position) OVER (PARTITION BY doc_id ORDER BY page_idx, position, heading_no) AS end_at FROM h),
        j AS (SELECT sp.doc_id, heading_no, p.page_idx, substr(p.text, CASE WHEN p.page_idx = sp.page_idx THEN position ELSE 0 END + 1,
               greatest(CASE WHEN p.page_idx = end_page THEN end_at ELSE length(p.text) END - CASE WHEN p.page_idx = sp.page_idx THEN position ELSE 0 END, 0)) AS part
              FROM sp JOIN pages_ p ON p.doc_id = sp.doc_id AND p.page_idx >= sp.page_idx AND (end_page IS NULL OR p.page_idx <= end_page)),
        c AS (SELECT doc_id, heading_no, string_agg(part, chr(10) ORDER BY page_idx) AS content FROM j GROUP BY ALL)
        SELECT sp.doc_id, sp.heading_no, sp.text AS heading, sp.page_idx AS start_page, end_page, coalesce(content, '') AS content
        FROM sp LEFT JOIN c ON c.doc_id = sp.doc_id AND c.heading_no = sp.heading_no""",
)
def heading_intervals(s, d):
    own = blocks(s, d)
    pages = files.page_texts(own).select("doc_id", (F.col("page_number") - 1).alias("page_idx"), "text")
    before = Window.partitionBy("doc_id", "page_number").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    heads = own.withColumn("position", at).where("font_flags = 20").select(
        "doc_id", F.col("block_no").alias("heading_no"), (F.col("page_number") - 1).alias("page_idx"), "position", "text"
    )
    return segments.texts_between_headings(pages, heads)


_TRI = lambda e: f"(CASE WHEN length({e}) >= 3 THEN list_distinct(list_transform(range(1, length({e}) - 1), lambda i: substr({e}, i, 3))) ELSE [] END)"


@query(
    "trigram_jaccard",
    f"""WITH p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, lower(regexp_replace(a.text, '\\s+', '', 'g')) AS x, lower(regexp_replace(b.text, '\\s+', '', 'g')) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
        t AS (SELECT a_id, b_id, {_TRI('x')} AS s, {_TRI('y')} AS u FROM p)
        SELECT a_id, b_id, round(len(list_intersect(s, u)) / len(list_distinct(list_concat(s, u))), 6) AS jaccard FROM t""",
)
def trigram_jaccard(s, d):
    own = read(s, d, "benchmark").select("item_id", F.col("text").alias("t"))
    pairs = own.select(F.col("item_id").alias("a_id"), F.col("t").alias("x")).join(
        own.select((F.col("item_id") - 1).alias("a_id"), F.col("item_id").alias("b_id"), F.col("t").alias("y")), "a_id"
    )
    return pairs.select("a_id", "b_id", F.round(ocr_merge.trigram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


_OCR = "SELECT doc_id, page_number, block_no, CASE WHEN block_no % 3 = 0 THEN replace(text, 'e', 'E') WHEN block_no % 3 = 1 THEN 'scan ' || block_no ELSE text END AS text, x + 4 AS x, y + CASE WHEN block_no % 5 = 0 THEN 200 ELSE 2 END AS y, width, height FROM blocks"
_BARE = "lower(regexp_replace(text, '\\s+', '', 'g'))"
_SHORT = "SELECT doc_id, page_number, block_no, text, x, y, width, height FROM blocks"


@query(
    "ocr_overlap_antijoin",
    f"""WITH {S.BLOCKS}, o AS (SELECT *, {_BARE} AS bare FROM ({_SHORT})), r AS (SELECT *, {_BARE} AS bare FROM ({_OCR})), m AS (SELECT DISTINCT r.doc_id, r.block_no FROM r JOIN o ON o.doc_id = r.doc_id AND o.page_number = r.page_number
          WHERE least(o.x + o.width, r.x + r.width) > greatest(o.x, r.x) AND least(o.y + o.height, r.y + r.height) > greatest(o.y, r.y)
            AND (least(o.x + o.width, r.x + r.width) - greatest(o.x, r.x)) * (least(o.y + o.height, r.y + r.height) - greatest(o.y, r.y)) / least(o.width * o.height, r.width * r.height) > 0.3
            AND o.bare <> '' AND r.bare <> '' AND CASE WHEN length(o.bare) < 3 AND length(r.bare) < 3 THEN 1.0
              ELSE len(list_intersect({_TRI('o.bare')}, {_TRI('r.bare')})) / len(list_distinct(list_concat({_TRI('o.bare')}, {_TRI('r.bare')}))) END > 0.6)
        SELECT doc_id, block_no, text, false AS from_ocr FROM o UNION ALL SELECT doc_id, block_no, text, true FROM r
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id AND m.block_no = r.block_no)""",
)
def ocr_overlap_antijoin(s, d):
    own = blocks(s, d).select("doc_id", "page_number", "block_no", "text", "x", "y", "width", "height")
    n = F.col("block_no") % 3
    scans = own.withColumns(
        {
            "text": F.when(n == 0, F.replace("text", F.lit("e"), F.lit("E"))).when(n == 1, F.concat(F.lit("scan "), F.col("block_no").cast("string"))).otherwise(F.col("text")),
            "x": F.col("x") + 4,
            "y": F.col("y") + F.when(F.col("block_no") % 5 == 0, 200).otherwise(2),
        }
    )
    merged = ocr_merge.merged_with_recognised(own, scans)
    return merged.select("doc_id", "block_no", "text", "from_ocr")


_DATES = ("D:20240115103000Z", "20231231", "D:2023", "", "D:19991301")


@query("pdf_dates", "SELECT raw, CASE WHEN length(regexp_replace(raw, '^D:', '')) >= 8 THEN substr(regexp_replace(raw, '^D:', ''), 1, 4) || '-' || substr(regexp_replace(raw, '^D:', ''), 5, 2) || '-' || substr(regexp_replace(raw, '^D:', ''), 7, 2) END AS date FROM (SELECT unnest([" + ", ".join(map(S.lit, _DATES)) + "]) AS raw)")
def pdf_dates(s, d):
    return s.createDataFrame([(x,) for x in _DATES], "raw string").select("raw", files.pdf_date(F.col("raw")).alias("date"))


@query(
    "metadata_clean",
    "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, 'lang=\"([a-z]*)\"', 1)), '') AS language FROM pages",
)
def metadata_clean(s, d):
    own = read(s, d, "pages")
    get = lambda pattern: files.clean_field(F.regexp_extract("html", pattern, 1))
    return own.select("page_id", get("<title>([^<]*)</title>").alias("title"), get('lang="([a-z]*)"').alias("language"))


@query("persona_terms", f"SELECT doc_id, {S.any_term('text', C.PERSONA_KEYWORDS)} AS has_keyword FROM documents")
def persona_terms(s, d):
    return read(s, d, "documents").select("doc_id", contains_any("text", C.PERSONA_KEYWORDS).alias("has_keyword"))


@query("file_hashes", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def file_hashes(s, d):
    return read(s, d, "pages").select("page_id", files.file_hash(F.encode("html", "UTF-8")).alias("sha256"))
