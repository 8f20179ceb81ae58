"""SQL (DuckDB) fragments from which the catalogue states its results a second time."""

from __future__ import annotations

import re


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_term(expr: str, terms) -> str:
    return f"regexp_matches(lower({expr}), {lit('|'.join(re.escape(t) for t in terms))})"


def hits(expr: str, terms) -> str:
    return "(" + " + ".join(f"contains(lower({expr}), {lit(t)})::INT" for t in terms) + ")"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


def n_words(expr: str) -> str:
    return f"len({words(expr)})"


def stripped(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def count_of(expr: str, chars: str) -> str:
    return f"(length({expr}) - length(translate({expr}, {lit(chars)}, '')))"


def is_upper(e: str) -> str:
    return f"(upper({e}) = {e} AND lower({e}) <> {e})"


def is_title(e: str) -> str:
    return (
        f"(regexp_matches({e}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({e}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}][\\p{{Lu}}\\p{{Lt}}]') "
        f"AND NOT regexp_matches({e}, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}'))"
    )


def rlike(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def cut(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n}) || '...' ELSE {e} END"


def step(e: str, *levels) -> str:
    return "CASE " + " ".join(f"WHEN {e} >= {n} THEN {v}" for n, v in levels) + " ELSE 0 END"


BLOCKS = f"""
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS block_no
  FROM documents
), own AS (SELECT doc_id, source, block_no, {stripped("line")} AS text FROM lines), blocks AS (
  SELECT doc_id, source, block_no, CAST(block_no // 8 + 1 AS INTEGER) AS page_number, text, 72.0::DOUBLE AS x,
         ((block_no % 8) * 24 + 72)::DOUBLE AS y, least(length(text) * 6, 468)::DOUBLE AS width, 12.0::DOUBLE AS height,
         CASE WHEN length(text) < 60 THEN 'Head' ELSE 'Body' END AS font_name,
         (CASE WHEN length(text) < 60 THEN 18 ELSE 11 END)::DOUBLE AS font_size,
         CASE WHEN length(text) < 60 THEN 20 ELSE 0 END AS font_flags
  FROM own WHERE text <> ''
)"""

PAGE_BLOCKS = f"""
bare AS (
  SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages
), found AS (
  SELECT page_id AS doc_id, unnest(regexp_extract_all(h, '<(h1|p|li)[^>]*>([^<]+)', 1)) AS tag,
         unnest(regexp_extract_all(h, '<(h1|p|li)[^>]*>([^<]+)', 2)) AS raw,
         unnest(range(len(regexp_extract_all(h, '<(h1|p|li)[^>]*>([^<]+)', 1)))) AS block_no
  FROM bare
), own AS (SELECT doc_id, block_no, tag, {stripped("raw")} AS text FROM found), blocks AS (
  SELECT doc_id, 'pages' AS source, block_no, CAST(block_no // 8 + 1 AS INTEGER) AS page_number, text, 72.0::DOUBLE AS x,
         ((block_no % 8) * 24 + 72)::DOUBLE AS y, least(length(text) * 6, 468)::DOUBLE AS width, 12.0::DOUBLE AS height,
         tag AS font_name, (CASE tag WHEN 'h1' THEN 24 WHEN 'p' THEN 12 ELSE 10 END)::DOUBLE AS font_size,
         CASE tag WHEN 'h1' THEN 20 ELSE 0 END AS font_flags
  FROM own WHERE text <> ''
)"""

GROUPED = BLOCKS + f""", lagged AS (
  SELECT *, lag(font_size) OVER w AS last_font, y - lag(y + height) OVER w AS gap
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, y, x, block_no)
), islands AS (
  SELECT *, sum(CASE WHEN last_font IS NULL OR font_size / last_font >= 1.5 OR font_flags >= 700 OR gap > 18
      OR (length(text) < 60 AND {is_title("text")} AND NOT ends_with(text, '.')) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY page_number, y, x, block_no) AS group_no
  FROM lagged
), sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, group_no) AS group_size FROM islands),
grouped AS (SELECT * FROM sized WHERE group_size >= 2)"""

SECTIONS = BLOCKS + f""", listed AS (
  SELECT doc_id, source, page_number, list(text ORDER BY y, block_no) AS texts FROM blocks WHERE length(text) > 10
  GROUP BY doc_id, source, page_number
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS importance_rank FROM listed
), sections AS (
  SELECT source AS collection, doc_id AS doc_ord, CAST(importance_rank - 1 AS INTEGER) AS section_no,
         'doc-' || doc_id AS document, page_number, {cut("texts[1]", 80)} AS title,
         {cut("coalesce(array_to_string(texts[2:5], ' '), '')", 400)} AS content
  FROM numbered WHERE importance_rank <= 5
)"""
