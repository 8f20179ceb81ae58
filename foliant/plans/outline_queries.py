"""Queries on headings, outlines and languages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant import runtime
from foliant.operators import fragments as FR
from foliant.operators import headings as H
from foliant.operators import language as L
from foliant.operators import outline as O
from foliant.operators import titles as T
from foliant.plans import sql as S
from foliant.plans.layout_queries import blocks, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _any(patterns, flags: str = "(?i)") -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


TEXT = S.stripped("text")
_STRICT = f"""length(text) BETWEEN 2 AND 150 AND NOT {S.rlike('text', _any(H.STRICT_NO_HEADING))} AND NOT {S.rlike('text', '^[0-9]+$')}
  AND NOT {S.rlike('text', '^[^0-9A-Za-z_]*$')} AND {S.n_words('text')} <= 20 AND font_size > 10 AND font_size < 72 AND y > 50 AND y < 742
  AND ({S.rlike('text', _any(H.STRICT_HEADING))} OR (length(text) BETWEEN 5 AND 80 AND {S.n_words('text')} BETWEEN 1 AND 12
    AND ({S.is_title('text')} OR ({S.is_upper('text')} AND length(text) > 3) OR {S.rlike('text', '^[0-9]+[.]')} OR {S.any_term('text', H.SECTION_WORDS)})))"""
_STRICT_LEVEL = f"""CASE WHEN ({S.rlike('text', '^[0-9]+[.][ ]+')}::INT + {S.any_term('text', ('application', 'form', 'overview', 'summary'))}::INT + (font_size >= 14)::INT + (y < 200)::INT) >= 2 THEN 'H1'
  WHEN {S.rlike('text', '^[a-z][.][ ]+')} OR {S.rlike('text', '^[ivx]+[.][ ]+')} OR {S.any_term('text', ('name', 'designation', 'date', 'address'))} OR (font_size >= 10 AND font_size < 14) THEN 'H2' ELSE 'H3' END"""


def strict(s, d):
    own = blocks(s, d)
    kept = own.where(H.strict_heading(F.col("text"), F.col("font_size"), F.col("y")))
    return kept.withColumn("level", H.strict_level(F.col("text"), F.col("font_size"), F.col("y")))


@query("strict_headings", f"WITH {S.BLOCKS} SELECT doc_id, block_no, text FROM blocks WHERE {_STRICT}")
def strict_headings(s, d):
    return strict(s, d).select("doc_id", "block_no", "text")


@query("strict_levels", f"WITH {S.BLOCKS} SELECT doc_id, block_no, {_STRICT_LEVEL} AS level FROM blocks")
def strict_levels(s, d):
    own = blocks(s, d)
    return own.select("doc_id", "block_no", H.strict_level(F.col("text"), F.col("font_size"), F.col("y")).alias("level"))


@query(
    "outline_validation",
    f"""WITH {S.BLOCKS}, h AS (SELECT *, {_STRICT_LEVEL} AS level FROM blocks WHERE {_STRICT}),
  a AS (SELECT doc_id, arg_min(text, block_no) AS title, count(*) AS heading_count, max((level = 'H1')::INT) AS has_h1,
     sum((length(text) < 5 OR {S.rlike('text', '(and|or|the|of|in)$')} OR {S.rlike('text', '^(and|or|the|of)')})::INT) AS fragments FROM h GROUP BY doc_id)
  SELECT doc_id, title, heading_count, length(title) AS title_length, round(fragments / heading_count, 6) AS fragmented_ratio,
    NOT (length(trim(title)) < 3 OR {S.rlike('title', _any(H.STRICT_NO_HEADING))} OR heading_count > 100 OR fragments > heading_count * 0.3 OR (has_h1 = 0 AND heading_count > 5)) AS is_valid FROM a""",
)
def outline_validation(s, d):
    own = H.outline_report(strict(s, d))
    return own.select("doc_id", "title", "heading_count", "title_length", F.round("fragmented_ratio", 6).alias("fragmented_ratio"), "is_valid")


@query("font_statistics", f"""WITH {S.BLOCKS}, l AS (SELECT doc_id, avg(font_size) AS mean, list(font_size ORDER BY font_size) AS s FROM blocks GROUP BY doc_id)
  SELECT doc_id, round(mean, 6) AS mean, s[len(s) // 2 + 1] AS median, s[-1] AS max, s[1] AS min, s[floor(len(s) * 0.75)::INT + 1] AS q75, s[floor(len(s) * 0.25)::INT + 1] AS q25 FROM l""")
def font_statistics(s, d):
    return H.font_statistics(blocks(s, d)).withColumn("mean", F.round("mean", 6))


_THRESHOLDS = """, lad AS (SELECT doc_id, coalesce(max(font_size) FILTER (page_number = 1), max(font_size)) * 0.85 AS title_font,
    list_sort(list_distinct(list(font_size)), 'DESC') AS ladder FROM blocks GROUP BY doc_id),
  th AS (SELECT doc_id, title_font, coalesce(ladder[1], 10) AS h1_font, coalesce(ladder[2], 10) AS h2_font, coalesce(ladder[3], 10) AS h3_font, title_font * 2 AS tolerance FROM lad)"""


@query(
    "adaptive_thresholds",
    f"WITH {S.BLOCKS}{_THRESHOLDS} SELECT doc_id, round(title_font, 6) AS title_font, h1_font, h2_font, h3_font, round(tolerance, 6) AS tolerance FROM th",
)
def adaptive_thresholds(s, d):
    return H.adaptive_thresholds(blocks(s, d)).withColumns({c: F.round(c, 6) for c in ("title_font", "tolerance")})


def shifted(own):
    """Blocks moved about, so that margins, neighbours and gaps differ."""
    k = F.col("block_no")
    return own.withColumns({"x": F.col("x") + (k % 4) * 60, "y": F.col("y") + (k % 3) * 9})


_SHIFTED = S.BLOCKS.replace("blocks AS (", "unmoved AS (") + ", blocks AS (SELECT * REPLACE (x + (block_no % 4) * 60 AS x, y + (block_no % 3) * 9 AS y) FROM unmoved)"
_GEOMETRY = f"""{_THRESHOLDS}, geo AS (SELECT b.*, th.* EXCLUDE (doc_id), min(x) OVER p AS lo, max(x) OVER p AS hi, lag(y) OVER o AS above, lead(y) OVER o AS below
    FROM blocks b JOIN th USING (doc_id) WINDOW p AS (PARTITION BY doc_id, page_number), o AS (PARTITION BY doc_id, page_number ORDER BY y DESC, block_no)),
  g AS (SELECT *, abs(x - lo) < 10 AS is_left, hi - lo > 100 AND abs(x - (lo + hi) / 2) < (hi - lo) * 0.3 AS is_centered,
    coalesce(above - y > tolerance OR y - below > tolerance, false) AS unusual_spacing FROM geo)"""


def geometry(own):
    return H.page_geometry(own.join(H.adaptive_thresholds(own), "doc_id"))


@query("page_alignment", f"WITH {_SHIFTED}{_GEOMETRY} SELECT doc_id, block_no, is_left, is_centered FROM g")
def page_alignment(s, d):
    return geometry(shifted(blocks(s, d))).select("doc_id", "block_no", "is_left", "is_centered")


@query("unusual_spacing", f"WITH {_SHIFTED}{_GEOMETRY} SELECT doc_id, block_no, unusual_spacing FROM g")
def unusual_spacing(s, d):
    return geometry(shifted(blocks(s, d))).select("doc_id", "block_no", "unusual_spacing")


_NEIGHBOURS = """, al AS (SELECT a.doc_id, a.block_no, count(*) AS n_aligned FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND abs(a.x - b.x) < 5 GROUP BY ALL),
  iso AS (SELECT a.doc_id, a.block_no, count(*) AS n_near, count(*) <= 1 AS is_isolated FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page_number = b.page_number
    AND abs(a.y - b.y) < a.font_size * 1.5 GROUP BY ALL)"""


@query("aligned_neighbours", f"WITH {_SHIFTED}{_NEIGHBOURS} SELECT * FROM al")
def aligned_neighbours(s, d):
    return H.aligned_neighbours(shifted(blocks(s, d)))


@query("isolated_blocks", f"WITH {_SHIFTED}{_NEIGHBOURS} SELECT * FROM iso")
def isolated_blocks(s, d):
    return H.isolated_blocks(shifted(blocks(s, d)))


_NO = [p.replace("\\w+", "[0-9A-Za-z_]+") for p in H.NO_HEADING]
_CANDIDATES = f"""{_GEOMETRY}{_NEIGHBOURS}, ok AS (SELECT g.*, al.n_aligned, iso.is_isolated, {S.rlike('text', _any(H.NUMBERED, ''))} AS num FROM g JOIN al USING (doc_id, block_no) JOIN iso USING (doc_id, block_no)
    WHERE length(text) BETWEEN 2 AND 150 AND NOT {S.rlike('text', _any(_NO))}),
  pts AS (SELECT *, CASE WHEN font_size >= title_font THEN 70 WHEN font_size >= h3_font THEN 40 ELSE 0 END + CASE WHEN font_flags & 1 <> 0 THEN 30 ELSE 0 END
      + CASE WHEN font_flags & 2 <> 0 THEN 10 ELSE 0 END + CASE WHEN is_left THEN 20 ELSE 0 END + CASE WHEN is_isolated THEN 30 ELSE 0 END AS pf,
    CASE WHEN is_centered THEN 50 ELSE 0 END + CASE WHEN n_aligned >= 2 THEN 30 ELSE 0 END + CASE WHEN unusual_spacing THEN 40 ELSE 0 END
      + CASE WHEN length(text) < 50 AND is_isolated THEN 30 ELSE 0 END AS pp,
    CASE WHEN num OR {S.rlike('text', _any(H.NAMED))} THEN 60 ELSE 0 END + CASE WHEN {S.any_term('text', H.STRUCTURE_WORDS)} THEN 40 ELSE 0 END
      + CASE WHEN length(text) BETWEEN 5 AND 80 THEN 20 WHEN length(text) > 150 THEN -50 ELSE 0 END AS pt FROM ok),
  cand AS (SELECT doc_id, block_no, page_number, x, y, font_size, text, 1 AS src_ord, 'font' AS pattern_type, pf AS confidence FROM pts WHERE pf >= 50
    UNION ALL SELECT doc_id, block_no, page_number, x, y, font_size, text, 2, CASE WHEN is_centered THEN 'centered' ELSE 'position' END, pp FROM pts WHERE pp >= 40
    UNION ALL SELECT doc_id, block_no, page_number, x, y, font_size, text, 3, 'pattern', pt FROM pts WHERE pt >= 40)"""
_ALNUM = "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))"
_SPECIAL = "(length(text) - length(regexp_replace(text, '[^\\p{L}\\p{N} .\\-]', '', 'g')))"
_DISTINCT = f"""{_CANDIDATES}, dist AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY src_ord, block_no) AS rn FROM cand) WHERE rn = 1
    AND confidence >= 40 AND NOT (length(text) > 3 AND {_ALNUM} < length(text) * 0.3) AND (length(text) >= 3 OR {S.any_term('text', ('name', 'date', 'page'))})
    AND NOT ({S.count_of('text', ' ')} > 10 AND ends_with(text, '.')) AND {_SPECIAL} <= length(text) * 0.6),
  ld AS (SELECT doc_id, list_sort(list_distinct(list(font_size)), 'DESC') AS lad2 FROM dist GROUP BY doc_id),
  lev AS (SELECT dist.*, CASE WHEN {S.rlike('text', '^[0-9]+[.][ ]')} OR {S.any_term('text', ('chapter', 'part', 'section'))} THEN 'H1' WHEN {S.rlike('text', '^[0-9]+[.][0-9]+')} THEN 'H2'
     WHEN len(lad2) < 2 OR font_size >= lad2[1] THEN 'H1' WHEN len(lad2) = 2 OR font_size >= lad2[2] THEN 'H2' ELSE 'H3' END AS level FROM dist JOIN ld USING (doc_id)),
  fin AS (SELECT * FROM lev WHERE (length(text) > 2 OR {S.rlike('text', '^[[:alpha:]]+$')}) AND {S.n_words('text')} <= 8 AND NOT {S.any_term('text', H.CONTENT_PHRASES)})"""


@query("heading_candidates", f"WITH {_SHIFTED}{_CANDIDATES} SELECT doc_id, block_no, src_ord, pattern_type, confidence FROM cand")
def heading_candidates(s, d):
    return H.heading_candidates(shifted(blocks(s, d))).select("doc_id", "block_no", "src_ord", "pattern_type", "confidence")


@query("heading_dedup", f"WITH {_SHIFTED}{_DISTINCT} SELECT doc_id, block_no, src_ord, text FROM dist")
def heading_dedup(s, d):
    return H.distinct_candidates(H.heading_candidates(shifted(blocks(s, d)))).select("doc_id", "block_no", "src_ord", "text")


def detected(s, d):
    return H.detected_headings(shifted(blocks(s, d)))


@query("heading_levels", f"WITH {_SHIFTED}{_DISTINCT} SELECT doc_id, block_no, text, level FROM fin")
def heading_levels(s, d):
    return detected(s, d).select("doc_id", "block_no", "text", "level")


def scattered(own):
    """Blocks as words of lines: six of a document on one line, side by side, in fonts of two sizes."""
    k, n = F.col("block_no"), F.length("text")
    return own.withColumns(
        {"x": (k % 6) * 40.0, "y": F.floor(k / 6) * 20.0, "width": F.lit(38.0), "font_size": F.when(k % 12 < 8, 16.0).otherwise(11.0),
         "text": F.when(k % 5 == 0, F.substring("text", 1, 1)).when(k % 5 < 3, F.substring("text", 1, 12)).otherwise(F.substring("text", 1, 40)), "page_number": F.lit(1)}
    )


_SCATTERED = S.BLOCKS.replace("blocks AS (", "unscattered AS (") + f""", blocks AS (SELECT * REPLACE ((block_no % 6) * 40.0::DOUBLE AS x, (block_no // 6) * 20.0::DOUBLE AS y, 38.0::DOUBLE AS width,
    CASE WHEN block_no % 12 < 8 THEN 16.0::DOUBLE ELSE 11.0::DOUBLE END AS font_size, 1 AS page_number,
    CASE WHEN block_no % 5 = 0 THEN substr(text, 1, 1) WHEN block_no % 5 < 3 THEN substr(text, 1, 12) ELSE substr(text, 1, 40) END AS text) FROM unscattered)"""


def _heading_text(t: str) -> str:
    own = S.stripped(t)
    listed = S.words(own)
    return f"""(length({own}) BETWEEN 5 AND 100 AND len({listed}) <= 8 AND (len(list_filter({listed}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= len({listed}) * 0.6
    OR ({S.is_upper(own)} AND len({listed}) <= 5) OR len(list_filter({listed}, lambda w: lower(w) IN ({", ".join(map(S.lit, FR.HEADING_WORDS))}))) > 0))"""


@query("fragment_heading_texts", f"WITH {_SCATTERED} SELECT doc_id, block_no, {_heading_text('text')} AS is_heading_text FROM blocks")
def fragment_heading_texts(s, d):
    return scattered(blocks(s, d)).select("doc_id", "block_no", FR.heading_text(F.col("text")).alias("is_heading_text"))


@query(
    "fragment_gaps",
    f"""WITH {_SCATTERED}, l AS (SELECT doc_id, page_number, round_even(y / 2, 0) * 2 AS line, abs(x - lag(x + width) OVER (PARTITION BY doc_id, page_number, round_even(y / 2, 0) ORDER BY x, block_no)) AS gap FROM blocks)
  SELECT doc_id, page_number, line, count(*) AS n_blocks, round(coalesce(avg(gap), 0), 6) AS mean_gap FROM l GROUP BY ALL""",
)
def fragment_gaps(s, d):
    return FR.line_gaps(scattered(blocks(s, d))).withColumn("mean_gap", F.round("mean_gap", 6))


def _sign(condition: str) -> str:
    return f"coalesce(({condition})::INT, 0)"


_A, _B = S.stripped("text"), S.stripped("next_text")
_STATEMENT = f"regexp_matches(a, '[!?:]$') AND regexp_matches(b, '^\\p{{Lu}}') AND {S.n_words('b')} > 3"
_PARTS = f"""(NOT (regexp_matches(b, '^\\p{{Lu}}') AND ends_with(a, '.')) AND NOT ({_STATEMENT}) AND (
  {_sign(f"({S.is_title('a')} OR {S.is_upper('a')}) AND ({S.is_title('b')} OR {S.is_upper('b')})")} + {_sign(" OR ".join(f"ends_with(a, {S.lit(e)})" for e in FR.OPEN_ENDS))}
  + {_sign(f"lower({S.words('b')}[1]) IN ({', '.join(map(S.lit, FR.CONTINUING_WORDS))})")} + {_sign(f"{S.n_words('a')} <= 4 AND {S.n_words('b')} <= 4")}
  + {_sign("NOT regexp_matches(a, '(?s)[.].') AND NOT regexp_matches(b, '(?s)[.].')")}) >= 2)"""


@query(
    "fragment_neighbours",
    f"""WITH {_SCATTERED}, n AS (SELECT *, lead(text) OVER o AS next_text, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(font_size) OVER o AS nf
    FROM blocks WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y DESC, x, block_no)),
  t AS (SELECT *, {_A} AS a, {_B} AS b FROM n)
  SELECT doc_id, block_no, coalesce(length(a) <= 100 AND length(b) <= 100 AND abs(font_size - nf) <= greatest(2, font_size * 0.15) AND
    CASE WHEN abs(y - ny) <= font_size * 0.3 THEN abs(nx - (x + length(a) * font_size * 0.6)) <= font_size * 1.5
      WHEN abs(y - ny) <= font_size * 2 THEN (abs(x - nx) <= font_size)::INT + (length(a) <= 50 AND length(b) <= 50)::INT + (font_size >= 12 AND nf >= 12)::INT + {_sign(_PARTS)} >= 2
      ELSE false END, false) AS merges FROM t""",
)
def fragment_neighbours(s, d):
    return FR.neighbour_merges(scattered(blocks(s, d)))


_PLACED = ("doc_id", "block_no", "page_number", "text", "n_merged")


_LETTERS = "regexp_matches(before, '^\\p{L}+$') AND regexp_matches(t, '^\\p{L}+$') AND (length(before) = 1 OR length(t) = 1)"
_CAPITAL = "regexp_matches(t, '^\\p{Lu}')"
_SPACED = f"""(x - edge > 2 OR (length(before) > 1 AND length(t) > 1 AND regexp_matches(before, '\\p{{L}}$') AND regexp_matches(t, '^\\p{{L}}'))
  OR (length(before) <= 2 AND length(t) = 1 AND {_CAPITAL}) OR (length(before) = 1 AND length(t) > 1 AND {_CAPITAL}))"""


@query(
    "reconstructed_lines",
    f"""WITH {_SCATTERED}, g AS (SELECT *, round_even(y / 2, 0) * 2 AS line, {S.stripped('text')} AS t, lag(x + width) OVER o AS edge, lag(font_size) OVER o AS font, lag({S.stripped('text')}) OVER o AS before
    FROM blocks WINDOW o AS (PARTITION BY doc_id, page_number, round_even(y / 2, 0) ORDER BY x, block_no)),
  b AS (SELECT *, edge IS NULL OR x - edge >= font * CASE WHEN font > 15 THEN 1.0 ELSE 0.8 END OR abs(font_size - font) >= 5 AS begins FROM g),
  r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, page_number, line ORDER BY x, block_no) AS run FROM b),
  m AS (SELECT doc_id, page_number, line, run, count(*) AS n, avg(font_size) AS mean_font, min(font_size) AS least_font, sum(length(t)) AS characters, sum((length(t) <= 3)::INT) AS short,
      coalesce(avg(abs(x - edge)) FILTER (NOT begins), 0) AS mean_gap, string_agg(t, ' ' ORDER BY x, block_no) AS joined, arg_min(block_no, x) AS first_no,
      string_agg(CASE WHEN begins OR (x - edge <= 1 AND {_LETTERS}) OR NOT {_SPACED} THEN '' ELSE ' ' END || t, '' ORDER BY x, block_no) AS whole FROM r GROUP BY ALL),
  f AS (SELECT *, n >= 2 AND mean_font >= CASE WHEN n <= 4 THEN 12 ELSE 15 END AND least_font >= 10 AND (CASE WHEN n <= 4 THEN characters BETWEEN 10 AND 80
      ELSE short >= n * 0.6 AND mean_gap <= mean_font * 0.7 END OR {_heading_text('joined')}) AS is_one FROM m)
  SELECT doc_id, first_no AS block_no, page_number, {S.stripped("regexp_replace(whole, '[ ]+', ' ', 'g')")} AS text, CAST(n AS INTEGER) AS n_merged FROM f WHERE is_one
  UNION ALL SELECT doc_id, block_no, page_number, text, 1 FROM r JOIN f USING (doc_id, page_number, line, run) WHERE NOT is_one""",
)
def reconstructed_lines(s, d):
    return FR.reconstructed_lines(scattered(blocks(s, d))).select(*_PLACED)


query("fragment_groups")(lambda s, d: FR.grouped_fragments(scattered(blocks(s, d))).select(*_PLACED))
query("strict_reconstruction")(lambda s, d: FR.reconstructed_text(blocks(s, d)).select(*_PLACED))


@query(
    "mended_texts",
    f"""WITH {S.BLOCKS}, m AS (SELECT doc_id, block_no, {S.stripped("regexp_replace(replace(replace(text, 'e', ' ,  '), 'a', '(  '), '[ ]+', ' ', 'g')")} AS t FROM blocks)
  SELECT doc_id, block_no, regexp_replace(regexp_replace(t, '\\s+([,.!?:;)\\]}}])', '\\1', 'g'), '([(\\[{{])\\s+', '\\1', 'g') AS text FROM m""",
)
def mended_texts(s, d):
    text = F.replace(F.replace("text", F.lit("e"), F.lit(" ,  ")), F.lit("a"), F.lit("(  "))
    return blocks(s, d).select("doc_id", "block_no", FR.mended_text(text).alias("text"))


@query(
    "heading_order",
    f"""WITH {_SHIFTED} SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y DESC, x, block_no) AS upwards,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, x, block_no) AS downwards FROM blocks""",
)
def heading_order(s, d):
    place = lambda up: F.row_number().over(Window.partitionBy("doc_id").orderBy(*FR.heading_order(up)))
    return shifted(blocks(s, d)).select("doc_id", "block_no", place(True).alias("upwards"), place(False).alias("downwards"))


@query(
    "headings_by_confidence",
    f"""WITH {_SHIFTED}{_DISTINCT} SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page_number, y, block_no) AS place FROM fin""",
)
def headings_by_confidence(s, d):
    return H.by_confidence(detected(s, d)).select("doc_id", "block_no", "place")


@query(
    "block_pages",
    f"WITH {S.BLOCKS} SELECT doc_id, block_no, coalesce(CASE WHEN block_no % 3 = 0 THEN NULL ELSE page_number END, CASE WHEN block_no % 2 = 0 THEN block_no END, 1) AS page FROM blocks",
)
def block_pages(s, d):
    k = F.col("block_no")
    own = blocks(s, d).withColumn("page_number", F.when(k % 3 != 0, F.col("page_number"))).withColumn("page", F.when(k % 2 == 0, k))
    return own.select("doc_id", "block_no", FR.page_of(own).alias("page"))


query("reconstructed_titles")(lambda s, d: T.reconstructed_titles(blocks(s, d)))


@query(
    "cache_eviction",
    """WITH u AS (SELECT source || '-' || (doc_id % 400) AS key, max(doc_id) AS used_at FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY used_at DESC, key) AS rn FROM u)
  SELECT key, used_at, rn <= 100 AS stays FROM r""",
)
def cache_eviction(s, d):
    uses = read(s, d, "documents").select(F.concat_ws("-", "source", (F.col("doc_id") % 400).cast("string")).alias("key"), F.col("doc_id").alias("used_at"))
    return runtime.evicted(uses, 100)


@query(
    "benchmark_status",
    """WITH t AS (SELECT source AS run, lang AS stage, sum(n_chars / 100000.0) AS seconds FROM documents GROUP BY ALL), r AS (SELECT *, sum(seconds) OVER (PARTITION BY run) AS total FROM t)
  SELECT run, stage, round(seconds, 6) AS seconds, round(CASE WHEN total > 0 THEN 100 * seconds / total ELSE 0 END, 6) AS percent, round(total, 6) AS total,
    CASE WHEN total <= 5 THEN 'pass' ELSE 'fail' END AS status FROM r""",
)
def benchmark_status(s, d):
    own = read(s, d, "documents").select(F.col("source").alias("run"), F.col("lang").alias("stage"), (F.col("n_chars") / F.lit(100000.0)).alias("seconds"))
    return runtime.stage_shares(own, 5.0).withColumns({c: F.round(c, 6) for c in ("seconds", "percent", "total")})


_LOWT = f"lower({TEXT})"
_TITLE_OK = f"""length(text) BETWEEN 5 AND 100 AND NOT {S.rlike('text', _any(O.NO_TITLE))} AND NOT {S.rlike('text', '^[-=_*+.]{3,}$')}
  AND NOT {S.any_term('text', O.INVITATIONS)} AND NOT lower(text) IN ({", ".join(map(S.lit, O.FIELD_NAMES))}) AND NOT {S.any_term('text', O.TITLE_CONTENT)}"""
_GOOD = f"({S.rlike('text', _any(O.GOOD_TITLE))} OR {S.rlike('text', O.TITLE_CASE_WORDS)})"
_MATCHES = S.hits("text", O.TITLE_KEYWORDS)
_LADDER = "CASE WHEN font_size >= 24 THEN {} WHEN font_size >= 20 THEN {} WHEN font_size >= 16 THEN {} WHEN font_size >= 14 THEN {} ELSE 0 END"
_SCORE = f"""(CASE WHEN length(text) BETWEEN 20 AND 60 AND {S.n_words('text')} >= 2 THEN 60 WHEN length(text) BETWEEN 15 AND 80 AND {S.n_words('text')} >= 2 THEN 40 WHEN length(text) BETWEEN 10 AND 100 THEN 20
   WHEN {S.n_words('text')} = 1 AND length(text) BETWEEN 5 AND 15 THEN 10 ELSE 0 END
  + CASE WHEN {_MATCHES} >= 3 THEN 120 WHEN {_MATCHES} = 2 THEN 100 WHEN {_MATCHES} = 1 THEN 60 ELSE 0 END + CASE WHEN {_GOOD} THEN 30 ELSE 0 END + CASE WHEN page_number = 1 THEN 30 ELSE 0 END
  + CASE WHEN {_MATCHES} > 0 OR {_GOOD} THEN {_LADDER.format(100, 80, 60, 40)} ELSE {_LADDER.format(30, 20, 10, 0)} END
  - CASE WHEN {S.any_term('text', O.SCORED_FIELDS)} THEN 100 ELSE 0 END - CASE WHEN ends_with(text, '.') AND length(text) < 50 THEN 50 ELSE 0 END
  + CASE pattern_type WHEN 'centered' THEN 40 WHEN 'font' THEN 20 ELSE 0 END)"""


@query("title_candidates", f"WITH {S.BLOCKS} SELECT doc_id, block_no, text FROM blocks WHERE {_TITLE_OK}")
def title_candidates(s, d):
    return blocks(s, d).where(O.title_candidate(F.col("text"))).select("doc_id", "block_no", "text")


@query("title_score", f"WITH {_SHIFTED}{_DISTINCT} SELECT doc_id, block_no, {_SCORE} AS score FROM fin")
def title_score(s, d):
    score = O.title_score(F.col("text"), F.col("page_number"), F.col("font_size"), F.col("pattern_type"))
    return detected(s, d).select("doc_id", "block_no", score.alias("score"))


_PICK = f""", tc AS (SELECT doc_id, block_no, text AS title, {_SCORE} AS score FROM fin WHERE page_number = 1 AND {_TITLE_OK}),
  pick AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_no) AS rn FROM tc) WHERE rn = 1 AND score >= 100)"""


@query("title_pick", f"WITH {_SHIFTED}{_DISTINCT}{_PICK} SELECT doc_id, title, score FROM pick")
def title_pick(s, d):
    return O.picked_titles(detected(s, d), 100)


@query("valid_titles", f"WITH {S.BLOCKS} SELECT doc_id, block_no, length(text) >= 5 AND NOT {S.rlike('text', _any(O.FINAL_NO_TITLE))} AS is_valid FROM blocks")
def valid_titles(s, d):
    return blocks(s, d).select("doc_id", "block_no", O.valid_title(F.col("text")).alias("is_valid"))


@query(
    "form_documents",
    f"""WITH {_SHIFTED}{_DISTINCT}{_PICK}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title || ' application form' ELSE title END AS title FROM pick),
  f AS (SELECT doc_id, count(*) AS n, sum(({S.any_term('text', O.FORM_FIELDS)} OR lower(text) IN ({", ".join(map(S.lit, O.FORM_FIELD_NAMES))}))::INT
     + (({S.n_words('text')} = 1 AND length(text) <= 4) OR {S.rlike('text', '^[0-9]+[.]$')} OR {S.rlike('text', '^[0-9]+[.][ ]*[0-9]+[.]$')})::INT) AS fields,
     sum({S.any_term('text', O.DECLARATIONS)}::INT) AS decl, sum((length(text) <= 5 OR {S.rlike('text', '^[0-9]+[.]?[ ]*$')})::INT) AS labels FROM fin GROUP BY doc_id)
  SELECT t.doc_id, {S.any_term('title', O.FORM_TITLES)} AND (n IS NULL OR fields > n * 0.4 OR decl > 0 OR (n <= 3 AND {S.any_term('title', O.STRONG_FORM_TITLES)}) OR labels > n * 0.6) AS is_form FROM t LEFT JOIN f USING (doc_id)""",
)
def form_documents(s, d):
    own = detected(s, d)
    titles = O.picked_titles(own, 100).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("title", F.lit(" application form"))).otherwise(F.col("title")).alias("title")
    )
    return O.form_documents(own, titles)


@query(
    "event_documents",
    f"""WITH {_SHIFTED}{_DISTINCT}, w AS (SELECT doc_id, string_agg(lower(text), ' ' ORDER BY page_number, y, block_no) AS whole FROM fin GROUP BY doc_id)
  SELECT doc_id, {S.hits('whole', O.EVENT_PHRASES)} AS n_phrases, {S.hits('whole', O.EVENT_PHRASES)} >= 3 AS is_event FROM w""",
)
def event_documents(s, d):
    return O.event_documents(detected(s, d))


_NAMED = f"""(lower(text) IN ({", ".join(map(S.lit, O.STANDARD_SECTIONS))}) OR (ends_with(text, ':') AND {S.n_words('text')} BETWEEN 2 AND 8) OR ({S.is_upper('text')} AND {S.n_words('text')} BETWEEN 2 AND 6)
  OR {S.rlike('text', '(?i)^(chapter|section|part|appendix)[ ]+[A-Z0-9]')} OR (ends_with(text, '?') AND {S.n_words('text')} BETWEEN 3 AND 12)
  OR ({S.n_words('text')} BETWEEN 1 AND 12 AND {S.rlike('text', '^[[:upper:]]').replace('[[:upper:]]', chr(92) + 'p{Lu}')} AND ({S.n_words('text')} > 1 OR length(text) >= 4)))"""
_PLAIN = f"""CASE WHEN {S.rlike('text', '^[0-9]+[.][ ]+[A-Za-z]|^[0-9]+[.][0-9]+[ ]+[A-Za-z]|^[0-9]+[.][0-9]+[.][0-9]+[ ]+[A-Za-z]')} THEN {S.n_words('text')} <= 15
  WHEN {S.n_words('text')} > 15 OR contains(text, '.') OR contains(text, '●') OR {S.count_of('text', ',')} > 2 THEN false ELSE {_NAMED} END"""
_EVENT = f"""CASE WHEN {S.rlike('lower(text)', _any(O.EVENT_LOGISTICS, ''))} THEN false WHEN {S.rlike('lower(text)', _any(O.EVENT_WELCOME, ''))} THEN true
  WHEN {S.n_words('text')} <= 2 AND NOT {S.rlike('text', '[:()]')} THEN false ELSE {_PLAIN} END"""


@query(
    "document_headings",
    f"WITH {S.BLOCKS} SELECT doc_id, block_no, CASE WHEN length(text) NOT BETWEEN 3 AND 120 THEN false WHEN doc_id % 2 = 0 THEN {_EVENT} ELSE {_PLAIN} END AS is_heading FROM blocks",
)
def document_headings(s, d):
    return blocks(s, d).select("doc_id", "block_no", O.document_heading(F.col("text"), F.col("doc_id") % 2 == 0).alias("is_heading"))


@query(
    "content_not_heading",
    f"""WITH {S.BLOCKS} SELECT doc_id, block_no, (length(text) <= 4 AND {S.n_words('text')} = 1) OR {S.n_words('text')} > 15 OR {S.any_term('text', O.LINKS)}
  OR length(text) - length(regexp_replace(text, '[.,;!?()\\[\\]{{}}]', '', 'g')) > 2 AS is_content FROM blocks""",
)
def content_not_heading(s, d):
    return blocks(s, d).select("doc_id", "block_no", O.content_not_heading(F.col("text")).alias("is_content"))


_OWN = S.words("lower(title)")


@query(
    "title_components",
    f"""WITH {_SHIFTED}{_DISTINCT}{_PICK}, p AS (SELECT f.doc_id, f.block_no, lower(f.text) AS low, {_OWN} AS own FROM fin f JOIN pick USING (doc_id)),
  c AS (SELECT *, flatten(list_transform(range(1, len(own) + 1), lambda i: list_transform(range(1, least(3, len(own) - i + 1) + 1), lambda n: array_to_string(own[i:i + n - 1], ' ')))) AS parts,
    list_distinct({S.words('low')}) AS mine FROM p)
  SELECT doc_id, block_no, len(list_filter(parts, lambda c: low = c OR (length(c) > 5 AND contains(low, c)) OR (length(low) > 5 AND contains(c, low)))) > 0
    OR (len(list_intersect(mine, own)) >= len(mine) * 0.9 AND length(low) > 10) AS is_component FROM c""",
)
def title_components(s, d):
    own = detected(s, d)
    titled = own.join(O.picked_titles(own, 100).select("doc_id", "title"), "doc_id")
    return titled.select("doc_id", "block_no", O.title_component(F.col("text"), F.col("title")).alias("is_component"))


_KW, _AW = f"list_distinct({S.words('k')})", f"list_distinct({S.words('o.a')})"
_NUMBERED_BOTH = "regexp_matches(k, '^[0-9]+[.]') AND regexp_matches(o.a, '^[0-9]+[.]')"
_SIMILAR = f"""len(list_filter(f.kept, lambda k: contains(k, o.a) OR contains(o.a, k) OR len(list_intersect({_KW}, {_AW})) / least(len({_KW}), len({_AW}))
  > CASE WHEN {_NUMBERED_BOTH} THEN 0.9 ELSE 0.8 END)) > 0"""


@query(
    "heading_near_dups",
    f"""WITH RECURSIVE {_SHIFTED}{_DISTINCT}, o AS (SELECT doc_id, block_no, text, array_to_string({S.words('lower(text)')}, ' ') AS a,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, block_no) AS n FROM fin WHERE length({TEXT}) BETWEEN 2 AND 150),
  f AS (SELECT doc_id, block_no, text, n, [a] AS kept, true AS stays FROM o WHERE n = 1
    UNION ALL SELECT o.doc_id, o.block_no, o.text, o.n, CASE WHEN {_SIMILAR} THEN f.kept ELSE list_append(f.kept, o.a) END, NOT ({_SIMILAR}) FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
  SELECT doc_id, block_no, text FROM f WHERE stays""",
)
def heading_near_dups(s, d):
    return O.distinct_headings(detected(s, d)).select("doc_id", "block_no", "text")


query("outline_split")(lambda s, d: O.split_headings(detected(s, d)).select("doc_id", "block_no", "part_no", "text"))


@query(
    "outline_numbering",
    f"""WITH {S.BLOCKS}, h AS (SELECT doc_id, block_no, CASE WHEN block_no % 5 = 0 THEN 'Introduction' WHEN block_no % 5 = 1 THEN '2. Overview' ELSE text END AS text FROM blocks WHERE font_flags = 20)
  SELECT doc_id, block_no, CASE WHEN (lower(text) IN ({", ".join(map(S.lit, O.MAIN_SECTIONS))}) OR {S.rlike('lower(text)', '(section|overview)$')} OR starts_with(lower(text), 'introduction')) AND NOT {S.rlike('text', '^[0-9]+[.]')}
    THEN '1. ' || text ELSE text END AS text FROM h""",
)
def outline_numbering(s, d):
    text = F.when(F.col("block_no") % 5 == 0, "Introduction").when(F.col("block_no") % 5 == 1, "2. Overview").otherwise(F.col("text"))
    own = blocks(s, d).where("font_flags = 20").select("doc_id", "block_no", text.alias("text"))
    return own.withColumn("text", O.numbered_text(F.col("text")))


_OUTLINE_LEVEL = f"""{_DISTINCT}, ol AS (SELECT doc_id, list_sort(list_distinct(list(font_size)), 'DESC') AS lad3 FROM fin GROUP BY doc_id),
  outl AS (SELECT fin.* EXCLUDE (level), CASE WHEN {S.rlike('text', '^[0-9]+[.][ ]+[A-Za-z]')} THEN 'H1' WHEN {S.rlike('text', '^[0-9]+[.][0-9]+[ ]+[A-Za-z]')} THEN 'H2' WHEN {S.rlike('text', '^[0-9]+[.][0-9]+[.][0-9]+[ ]+[A-Za-z]')} THEN 'H3'
    WHEN {S.rlike('lower(text)', O.TOP_SECTIONS)} OR {S.rlike('lower(text)', '^(introduction|overview)[ ]+to[ ]+')} OR {S.rlike('text', '(?i)^(chapter|part|section)[ ]+[0-9]+')} THEN 'H1'
    WHEN font_size >= lad3[1] * 0.95 THEN 'H1' WHEN lad3[2] IS NOT NULL AND font_size >= lad3[2] * 0.9 THEN 'H2' WHEN font_size >= 12 THEN 'H2' ELSE 'H3' END AS level FROM fin JOIN ol USING (doc_id))"""


@query("outline_levels", f"WITH {_SHIFTED}{_OUTLINE_LEVEL} SELECT doc_id, block_no, level FROM outl")
def outline_levels(s, d):
    return O.outline_levels(detected(s, d)).select("doc_id", "block_no", "level")


@query(
    "outline_entries",
    f"""WITH {_SHIFTED}{_OUTLINE_LEVEL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y, block_no) AS entry_no, level, text,
  CASE WHEN max(page_number) OVER (PARTITION BY doc_id) = 1 THEN 0 ELSE page_number END AS page FROM outl""",
)
def outline_entries(s, d):
    return O.outline_entries(O.outline_levels(detected(s, d)))


query("build_outline")(lambda s, d: O.build_outline(detected(s, d)))


@query(
    "repeated_words",
    f"""WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents)
  SELECT doc_id, array_to_string(list_filter(ws, lambda w, i: i = 1 OR lower(w) <> lower(ws[i - 1])), ' ') AS text FROM w""",
)
def repeated_words(s, d):
    return read(s, d, "documents").select("doc_id", O.without_repeated_words(F.col("text")).alias("text"))


_CODES = ", ".join(f"({S.lit(c)}, {S.lit(n)}, {S.lit(f)}, {r}, {x})" for c, n, f, r, x in L.LANGUAGES)


@query(
    "language_dimension",
    f"""SELECT DISTINCT code, coalesce(name, 'Unknown') AS name, coalesce(family, 'Unknown') AS family, coalesce(rtl, false) AS rtl, coalesce(complex_script, false) AS complex_script
  FROM (SELECT DISTINCT unnest([lang, 'ja', 'ar', 'xx']) AS code FROM documents) LEFT JOIN (VALUES {_CODES}) v(code, name, family, rtl, complex_script) USING (code)""",
)
def language_dimension(s, d):
    codes = read(s, d, "documents").select(F.explode(F.array("lang", F.lit("ja"), F.lit("ar"), F.lit("xx"))).alias("code")).distinct()
    return L.with_language_metadata(codes, "code")


def _frequent(code: str) -> str:
    return f"len(list_filter({S.words('lower(substr(text, 1, 1000))')}, lambda w: w IN ({', '.join(map(S.lit, L.FREQUENT[code]))})))"


_COUNTS = "[" + ", ".join(f"{{'n': {_frequent(c)}, 'o': {-i}, 'lang': {S.lit(c)}}}" for i, c in enumerate(L.FREQUENT)) + "]"
_PROBABLE = f"""c AS (SELECT *, list_reverse_sort({_COUNTS}) AS ordered FROM texts),
  w AS (SELECT *, list_transform(ordered, lambda x: exp((x.n - ordered[1].n) * {L.ODDS / 10})) AS weight FROM c),
  p AS (SELECT *, list_transform(range(1, len(ordered) + 1), lambda i: {{'lang': ordered[i].lang, 'prob': weight[i] / list_sum(weight)}}) AS probs FROM w)"""
_IDENTIFIED = f"CASE WHEN length({S.stripped('text')}) < 50 OR probs[1].prob < 0.8 THEN 'en' ELSE probs[1].lang END"


@query("language_vote", f"WITH texts AS (SELECT doc_id, text FROM documents), {_PROBABLE} SELECT doc_id, {_IDENTIFIED} AS language FROM p")
def language_vote(s, d):
    return read(s, d, "documents").select("doc_id", L.identified(F.col("text")).alias("language"))


@query(
    "language_shares",
    f"""WITH texts AS (SELECT doc_id, text FROM documents), {_PROBABLE}, k AS (SELECT doc_id, unnest(list_filter(probs, lambda x: x.prob >= 0.3)) AS x FROM p)
  SELECT doc_id, x.lang AS lang, round(x.prob, 6) AS prob FROM k UNION ALL SELECT doc_id, 'en', 1.0 FROM p WHERE len(list_filter(probs, lambda x: x.prob >= 0.3)) = 0""",
)
def language_shares(s, d):
    own = read(s, d, "documents").select("doc_id", F.explode(L.shares(F.col("text"))).alias("x"))
    return own.select("doc_id", "x.lang", F.round("x.prob", 6).alias("prob"))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


@query(
    "language_preprocess",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE lang END AS lang, '　Ａｂ１、 ' || text || '。 ' AS text FROM documents)
  SELECT doc_id, {S.stripped(f"CASE WHEN lang = 'ja' THEN translate(replace(replace(regexp_replace(text, '[ \\t\\n\\r　]+', ' ', 'g'), '。', '. '), '、', ', '), {S.lit(_WIDE)}, {S.lit(_NARROW)}) ELSE text END")} AS text FROM t""",
)
def language_preprocess(s, d):
    language = F.when(F.col("doc_id") % 2 == 0, "ja").otherwise(F.col("lang"))
    text = F.concat(F.lit("　Ａｂ１、 "), F.col("text"), F.lit("。 "))
    return read(s, d, "documents").select("doc_id", L.preprocessed(text, language).alias("text"))


query("language_composed")(lambda s, d: read(s, d, "documents").select("doc_id", L.composed(F.col("text")).alias("text")))


@query(
    "multilingual_documents",
    f"""WITH {S.BLOCKS}, n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n WHERE i % greatest(n // 10, 1) = 0 AND length(text) > 50),
  texts AS (SELECT doc_id, text FROM f WHERE k <= 10), {_PROBABLE},
  l AS (SELECT doc_id, count(DISTINCT {_IDENTIFIED}) AS m FROM p GROUP BY doc_id)
  SELECT doc_id, any_value(n) >= 5 AND coalesce(any_value(m), 0) > 1 AS is_multilingual FROM n LEFT JOIN l USING (doc_id) GROUP BY doc_id""",
)
def multilingual_documents(s, d):
    return L.multilingual_documents(blocks(s, d))
