"""Queries on ranking, passages, similarity and results."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant import config as C
from foliant.functions import score as scores
from foliant.functions.text import distinct_words
from foliant.operators import embed, output, passages, ranking
from foliant.operators.vectors import nearest
from foliant.plans import sql as S
from foliant.plans.layout_queries import DEMO_TERMS, blocks, read
from foliant.plans.pipeline import page_sections_of, run

PERSONA, JOB = "Travel Planner", "Plan a trip of 4 days for a group of 10 college friends."
COOK, MENU = "Food Contractor", "Prepare a vegetarian buffet-style dinner menu for a corporate gathering, including gluten-free items."
DEMO_TOPICS = {"stay": ("inn", "ist"), "dining": ("eat", "que"), "place": ("area", "ver"), "culture": ("art", "ment"), "activities": ("tour", "tion")}
DEMO = replace(C.DEFAULT, informative=DEMO_TERMS, topics=DEMO_TOPICS, value_terms=DEMO_TERMS, persona_keywords=("the", "des", "los"))
INGREDIENT_CUES, INSTRUCTION_CUES = ("heon", "eaux", "cion", "sch"), ("thst", "oier", "rrl", "ung")

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def page_sections(s, d):
    return page_sections_of(blocks(s, d))


KEYS = ("collection", "doc_ord", "section_no")
_KEYS = ", ".join(KEYS)


def _capped(job_terms: tuple[str, ...] | None) -> str:
    diet = f"WHERE NOT {S.any_term("title || ' ' || content", job_terms)}" if job_terms else ""
    return f""", c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY doc_ord, section_no) AS rn FROM sections) WHERE rn <= 200),
  c2 AS (SELECT * EXCLUDE (rn) FROM c1 {diet}),
  c3 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY doc_ord, section_no) AS rn FROM c2) WHERE rn <= 100),
  d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, lower({S.stripped('title')}) ORDER BY doc_ord, section_no) AS rn FROM c3) WHERE rn = 1)"""


def _embedded(source: str, text: str, name: str = "e") -> str:
    return f"""{name}0 AS (SELECT *, list_transform({S.words(f'lower(substr({text}, 1, 512))')}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS bk FROM {source}),
  {name} AS (SELECT * EXCLUDE (bk), list_transform(range(64), lambda i: len(list_filter(bk, lambda x: x = i))::DOUBLE) AS v FROM {name}0)"""


def _profiles(persona: str, job: str) -> str:
    role, task = ranking.profile_text("role", persona), ranking.profile_text("task", job)
    return f"""pt AS (SELECT 'p' AS who, {S.lit(role)} AS t UNION ALL SELECT 'j', {S.lit(task)}), {_embedded('pt', 't', 'pe')},
  prof AS (SELECT (SELECT v FROM pe WHERE who = 'p') AS pv, (SELECT v FROM pe WHERE who = 'j') AS jv)"""


def _cos(a: str, b: str) -> str:
    norm = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {norm} > 0 THEN list_dot_product({a}, {b}) / {norm} ELSE 0 END)"


_INFO = f"(({S.step(S.hits('content', DEMO_TERMS), (5, 0.3), (3, 0.2), (1, 0.1))}) + (CASE WHEN length(content) > 500 THEN 0.2 WHEN length(content) > 300 THEN 0.1 ELSE 0 END))::DOUBLE * 0.5"
_TOPICS = "(" + " + ".join(f"{S.any_term('content', t)}::INT" for t in DEMO_TOPICS.values()) + ")"
_DIVERSITY = f"({S.step(_TOPICS, (4, 0.4), (3, 0.3), (2, 0.2))})::DOUBLE * 0.2"
_QUALITY = f"""((CASE WHEN {S.any_term('title', C.GENERIC_TITLES)} THEN -0.3 ELSE 0 END) + (CASE WHEN length(content) < 200 THEN -0.1 ELSE 0 END)
  + (CASE WHEN {S.n_words('content')} < 30 THEN -0.2 ELSE 0 END))::DOUBLE + {_INFO} + {_DIVERSITY}"""
_PENALTY = f"(CASE WHEN {S.n_words('title')} < 3 OR {S.any_term('title', C.TRIVIAL_TITLES)} THEN -0.3 ELSE 0 END)::DOUBLE"
_BOOST = f"({S.hits("(title || chr(10) || content)", DEMO.persona_keywords)} * 0.2)::DOUBLE"


def _ranked(persona: str, job: str, terms=None) -> str:
    return (
        S.SECTIONS
        + _capped(terms)
        + f""", {_profiles(persona, job)}, {_embedded('d', "title || ' ' || content")},
  sc AS (SELECT e.*, {_cos('v', 'pv')} * 0.5 + {_cos('v', 'jv')} * 0.5 AS base_similarity, {_QUALITY} AS quality_score, {_PENALTY} AS penalty, {_BOOST} AS boost FROM e, prof),
  ss AS (SELECT *, round(base_similarity + quality_score + penalty + boost, 9) AS score FROM sc),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, doc_ord, section_no) AS importance_rank FROM ss)"""
    )


_RANK_OUT = f"{_KEYS}, title, importance_rank, round(score, 6) AS score"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("rank_sections", f"WITH {_ranked(PERSONA, JOB)} SELECT {_RANK_OUT} FROM ranked")
def rank_sections(s, d):
    own = ranking.ranked(page_sections(s, d), PERSONA, JOB, DEMO)
    return _rounded(own.select(*KEYS, "title", "importance_rank", "score"), "score")


@query("rank_sections_vegetarian", f"WITH {_ranked(COOK, MENU, C.NON_VEGETARIAN)} SELECT {_RANK_OUT} FROM ranked")
def rank_sections_vegetarian(s, d):
    own = ranking.ranked(page_sections(s, d), COOK, MENU, DEMO)
    return _rounded(own.select(*KEYS, "title", "importance_rank", "score"), "score")


@query(
    "relevance_minmax",
    f"""WITH {_ranked(PERSONA, JOB)}, b AS (SELECT *, round(base_similarity, 9) AS bs FROM ranked), m AS (SELECT *, min(bs) OVER w AS lo, max(bs) OVER w AS hi FROM b WINDOW w AS (PARTITION BY collection))
    SELECT {_KEYS}, round(CASE WHEN hi > lo THEN (bs - lo) / (hi - lo) WHEN bs > 0 THEN 1.0 ELSE 0.0 END, 6) AS relevance_score FROM m""",
)
def relevance_minmax(s, d):
    own = ranking.relevance(ranking.ranked(page_sections(s, d), PERSONA, JOB, DEMO), PERSONA, JOB, DEMO)
    return _rounded(own.select(*KEYS, "relevance_score"), "relevance_score")


@query("section_caps", f"WITH {S.SECTIONS}{_capped(None)} SELECT {_KEYS} FROM c3")
def section_caps(s, d):
    return ranking.capped(page_sections(s, d), PERSONA, JOB).select(*KEYS)


@query("collection_title_dedup", f"WITH {S.SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY collection, lower({S.stripped('title')}) ORDER BY doc_ord, section_no) AS rn FROM sections) SELECT {_KEYS}, title FROM k WHERE rn = 1")
def collection_title_dedup(s, d):
    return ranking.distinct_collection_titles(page_sections(s, d)).select(*KEYS, "title")


@query("section_title_dedup", f"""WITH {S.SECTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_ord, lower({S.stripped('title')}) ORDER BY section_no) AS rn FROM sections
    WHERE {S.n_words('content')} >= 30 AND NOT {S.any_term('title', C.TRIVIAL_HEADINGS)} AND {S.stripped('title')} <> '') SELECT doc_ord AS doc_id, section_no, title FROM k WHERE rn = 1""")
def section_title_dedup(s, d):
    from foliant.operators.sections import distinct_titles

    own = page_sections(s, d).withColumnRenamed("doc_ord", "doc_id")
    return distinct_titles(own).select("doc_id", "section_no", "title")


_ONE_TEXT = "title || ' ' || content"


@query("dietary_filter_rank", f"WITH {S.SECTIONS} SELECT {_KEYS} FROM sections WHERE NOT {S.any_term(_ONE_TEXT, C.NON_VEGETARIAN)}")
def dietary_filter_rank(s, d):
    return ranking.dietary_filter(page_sections(s, d), COOK, MENU).select(*KEYS)


@query(
    "dietary_filter_passage",
    f"WITH {S.SECTIONS} SELECT {_KEYS} FROM sections WHERE NOT ({S.any_term('title', C.NON_VEGETARIAN)} OR {S.any_term('content', C.NON_VEGETARIAN)})",
)
def dietary_filter_passage(s, d):
    return ranking.dietary_filter_passages(page_sections(s, d), MENU).select(*KEYS)


for _name, _sql, _column in (
    ("quality_score", _QUALITY, lambda: scores.section_quality(F.col("title"), F.col("content"), DEMO)),
    ("informativeness", _INFO, lambda: scores.informativeness(F.col("content"), DEMO)),
    ("diversity", _DIVERSITY, lambda: scores.diversity(F.col("content"), DEMO)),
    ("title_penalty_boost", f"{_PENALTY} + {_BOOST}", lambda: scores.title_penalty(F.col("title"), DEMO) + scores.keyword_boost(F.col("title"), F.col("content"), DEMO)),
):
    query(_name, f"WITH {S.SECTIONS} SELECT {_KEYS}, round({_sql}, 6) AS score FROM sections")(
        lambda s, d, column=_column: page_sections(s, d).select(*KEYS, F.round(column(), 6).alias("score"))
    )


@query(
    "cosine_topk",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
)
def cosine_topk(s, d):
    """Queries are the rows whose id is divisible by 100."""
    return nearest(read(s, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5)


@query(
    "persona_job_score",
    f"""WITH {S.SECTIONS}, {_profiles(PERSONA, JOB)}, {_embedded('sections', _ONE_TEXT)}
  SELECT {_KEYS}, round({_cos('v', 'pv')}, 6) AS persona_similarity, round({_cos('v', 'jv')}, 6) AS job_similarity FROM e, prof""",
)
def persona_job_score(s, d):
    own = page_sections(s, d).withColumn("b", embed.buckets(F.concat_ws(" ", "title", "content")))
    similar = lambda kind, text: F.round(embed.similarity(F.col("b"), ranking.profile_text(kind, text)), 6)
    return own.select(*KEYS, similar("role", PERSONA).alias("persona_similarity"), similar("task", JOB).alias("job_similarity"))


@query(
    "hashing_similarity",
    f"WITH {_embedded('documents', 'text')}, q AS (SELECT v AS qv FROM e WHERE doc_id = 0) SELECT doc_id, round({_cos('v', 'qv')}, 6) AS similarity FROM e, q",
)
def hashing_similarity(s, d):
    own = read(s, d, "documents").select("doc_id", embed.hashing(F.col("text")).alias("v"))
    first = F.broadcast(own.where("doc_id = 0").select(F.col("v").alias("qv")))  # one row
    return own.join(first).select("doc_id", F.round(scores.cosine(F.col("v"), F.col("qv")), 6).alias("similarity"))


_ASKED = "the of that and le la der die thing"


@query(
    "tfidf_similarity",
    f"""WITH tok AS (SELECT doc_id, unnest({S.words('lower(text)')}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL),
  df AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY token),
  w AS (SELECT doc_id, token, tf * idf AS w FROM tf JOIN df USING (token)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
  q AS (SELECT token, idf AS qw FROM df WHERE token IN ({", ".join(map(S.lit, _ASKED.split()))}))
  SELECT doc_id, round(sum(w * qw) / (any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS similarity FROM w JOIN q USING (token) JOIN n USING (doc_id) GROUP BY doc_id""",
)
def tfidf_similarity(s, d):
    return _rounded(embed.tfidf_similarity(read(s, d, "documents"), "doc_id", "text", _ASKED), "similarity")


def _pieces() -> str:
    flat = S.stripped("replace(replace(content, chr(10), ' '), '  ', ' ')")
    parts = f"[{flat}]"
    for delimiter in C.PASSAGE_DELIMITERS:
        mark = "chr(10) || chr(10)" if delimiter == "\n\n" else S.lit(delimiter)
        parts = f"flatten(list_transform({parts}, lambda p: string_split(p, {mark})))"
    return f"list_filter(list_transform({parts}, lambda p: {S.stripped('p')}), lambda p: p <> '')"


def _passages(a: tuple, b: tuple) -> str:
    """Recursive statement of the passage fold on ``sections`` (keyed by k)."""
    return f""", ks AS (SELECT *, row_number() OVER (ORDER BY collection, doc_ord, section_no) AS k FROM sections WHERE content <> ''),
  pl AS (SELECT k, {_pieces()} AS ps FROM ks), pc AS (SELECT k, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS i, len(ps) AS n FROM pl),
  cue AS (SELECT k, i, n, piece, {S.any_term('piece', a)} AS a, {S.any_term('piece', b)} AS b FROM pc),
  r AS (SELECT k, 0::BIGINT AS i, '' AS o, false AS a, false AS b, 0 AS done, NULL::VARCHAR AS cut FROM pl
    UNION ALL
    SELECT r.k, c.i, CASE WHEN (r.a OR c.a) AND (r.b OR c.b) THEN '' ELSE concat_ws(' ', nullif(r.o, ''), c.piece) END,
      (r.a OR c.a) AND NOT ((r.a OR c.a) AND (r.b OR c.b)), (r.b OR c.b) AND NOT ((r.a OR c.a) AND (r.b OR c.b)),
      r.done + ((r.a OR c.a) AND (r.b OR c.b))::INT,
      CASE WHEN (r.a OR c.a) AND (r.b OR c.b) THEN concat_ws(' ', nullif(r.o, ''), c.piece) END FROM r JOIN cue c ON c.k = r.k AND c.i = r.i + 1),
  ends AS (SELECT k, done - 1 AS passage_no, cut AS body FROM r WHERE cut IS NOT NULL
    UNION ALL SELECT r.k, done, o FROM r JOIN (SELECT k, len(ps) AS n FROM pl) USING (k) WHERE i = n AND o <> ''),
  passages AS (SELECT ks.*, CAST(passage_no AS INTEGER) AS passage_no, {S.stripped("CASE WHEN title <> '' THEN title || ': ' || body ELSE body END")} AS passage FROM ends JOIN ks USING (k))"""


_PK = f"{_KEYS}, passage_no"
_PASSAGES = f"WITH RECURSIVE {S.SECTIONS}{_passages(INGREDIENT_CUES, INSTRUCTION_CUES)}"


def demo_passages(s, d):
    split = passages.semantic_passages(F.col("title"), F.col("content"), INGREDIENT_CUES, INSTRUCTION_CUES)
    return page_sections(s, d).select(*KEYS, "title", F.posexplode(split).alias("passage_no", "passage"))


@query("semantic_passages", f"{_PASSAGES} SELECT {_PK}, passage FROM passages")
def semantic_passages(s, d):
    return demo_passages(s, d).select(*KEYS, "passage_no", "passage")


_SHAPED = f"length({S.stripped('passage')}) >= 100 AND len(list_distinct({S.words('lower(passage)')})) >= 8 AND {S.count_of('passage', '.!?')} >= 1"


@query("passage_shape_filter", f"{_PASSAGES} SELECT {_PK}, len(list_distinct({S.words('lower(passage)')})) AS n_distinct FROM passages WHERE {_SHAPED}")
def passage_shape_filter(s, d):
    return demo_passages(s, d).where(passages.well_shaped(F.col("passage"))).select(*KEYS, "passage_no", distinct_words("passage").alias("n_distinct"))


@query(
    "passage_quality",
    f"""{_PASSAGES} SELECT {_PK} FROM passages WHERE length(passage) >= 100 AND {S.count_of('passage', ',;:')} >= 2
  AND {S.any_term('passage', DEMO_TERMS)} AND NOT {S.any_term('passage', C.GENERIC_FRAGMENTS)}""",
)
def passage_quality(s, d):
    return demo_passages(s, d).where(passages.of_quality(F.col("passage"), config=DEMO)).select(*KEYS, "passage_no")


def _bonus(recipe: bool) -> str:
    if recipe:
        return f"""least((CASE WHEN {S.any_term('passage', C.BONUS_INGREDIENT_CUES)} AND {S.any_term('passage', C.BONUS_INSTRUCTION_CUES)} THEN 0.4 ELSE 0 END)
          + ({S.step(S.hits('passage', C.COOKING_DETAILS), (3, 0.3), (2, 0.2), (1, 0.1))}) + (CASE WHEN length(passage) > 250 THEN 0.2 ELSE 0 END), 1.0)::DOUBLE"""
    return f"""least((CASE WHEN length(passage) > 300 THEN 0.2 ELSE 0 END) + ({S.step(S.count_of('passage', ',;:('), (8, 0.3), (5, 0.2), (3, 0.1))})
          + ({S.step(S.hits('passage', C.ADVICE), (2, 0.2), (1, 0.1))}), 1.0)::DOUBLE"""


@query("passage_bonus", f"{_PASSAGES} SELECT {_PK}, round({_bonus(False)}, 6) AS bonus, round({_bonus(True)}, 6) AS recipe_bonus FROM passages")
def passage_bonus(s, d):
    bonus = lambda kind: F.round(scores.passage_bonus(F.col("passage"), kind), 6)
    return demo_passages(s, d).select(*KEYS, "passage_no", bonus(False).alias("bonus"), bonus(True).alias("recipe_bonus"))


@query(
    "persona_job_passage_filter",
    f"""{_PASSAGES} SELECT {_PK} FROM passages WHERE NOT {S.any_term('passage', C.NON_VEGETARIAN)}
  AND (NOT {S.any_term('passage', C.GLUTEN)} OR {S.any_term('passage', C.GLUTEN_FREE)}) AND NOT {S.any_term('passage', C.CORPORATE_INAPPROPRIATE)}""",
)
def persona_job_passage_filter(s, d):
    return demo_passages(s, d).where(ranking.passage_allowed(F.col("passage"), MENU)).select(*KEYS, "passage_no")


_SCORED = f""", {_profiles(PERSONA, JOB)}, {_embedded('passages', 'passage')},
  ps AS (SELECT e.*, round({_cos('v', 'pv')} * 0.4 + {_cos('v', 'jv')} * 0.6 + {_bonus(False)}, 9) AS score FROM e, prof),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, doc_ord, section_no ORDER BY score DESC, passage_no) AS rn FROM ps) WHERE rn <= 2)"""


def demo_scored(s, d):
    own = demo_passages(s, d)
    # Sections keep their own order here: its place stands for the importance rank.
    ranked = own.withColumn("importance_rank", F.concat_ws(":", F.lpad(F.col("doc_ord").cast("string"), 20, "0"), F.col("section_no").cast("string")))
    return passages.scored_passages(ranked, PERSONA, JOB)


@query("topk_per_section", f"{_PASSAGES}{_SCORED} SELECT {_PK}, round(score, 6) AS score FROM top")
def topk_per_section(s, d):
    own = demo_scored(s, d).withColumn("_s", F.concat_ws(":", "collection", "importance_rank"))
    return _rounded(ranking.first_per(own, "_s", (F.desc("score"), "passage_no"), 2).select(*KEYS, "passage_no", "score"), "score")


@query(
    "global_topk",
    f"""{_PASSAGES}{_SCORED}, g AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, doc_ord, section_no, passage_no) AS passage_rank FROM top)
  SELECT {_PK}, passage_rank, round(score, 6) AS score FROM g WHERE passage_rank <= 20""",
)
def global_topk(s, d):
    return _rounded(passages.best_passages(demo_scored(s, d)).select(*KEYS, "passage_no", "passage_rank", "score"), "score")


#: A section of the query below: a hundred consecutive rows of one label.
_PART = "CAST(floor(vec_id / 100) AS BIGINT)"


@query(
    "near_dup_passages",
    f"""WITH RECURSIVE e AS (SELECT vec_id, label, {_PART} AS part, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  o AS (SELECT *, row_number() OVER (PARTITION BY label, part ORDER BY vec_id) AS n FROM e),
  f AS (SELECT label, part, n, [v] AS kept, vec_id, true AS stays FROM o WHERE n = 1
    UNION ALL SELECT o.label, o.part, o.n, CASE WHEN len(list_filter(f.kept, lambda k: list_cosine_similarity(k, o.v) >= 0.3)) > 0 THEN f.kept ELSE list_append(f.kept, o.v) END,
      o.vec_id, len(list_filter(f.kept, lambda k: list_cosine_similarity(k, o.v) >= 0.3)) = 0 FROM f JOIN o ON o.label = f.label AND o.part = f.part AND o.n = f.n + 1)
  SELECT label, vec_id FROM f WHERE stays""",
)
def near_dup_passages(s, d):
    own = read(s, d, "embeddings").select("vec_id", "label", F.expr(_PART).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    return passages.without_near_duplicates(own, ["label", "part"], "vec_id", "v", 0.3).select("label", "vec_id")


_RECIPE_FLAT = S.stripped("replace(replace(content, chr(10), ' '), '  ', ' ')")


def _first(low: str, cues: tuple, shift: str = "0") -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN instr({low}, {S.lit(c)}) > 0 THEN instr({low}, {S.lit(c)}) + {shift} END" for c in cues) + ")"


@query(
    "recipe_passages",
    f"""WITH {S.SECTIONS}, f AS (SELECT *, {_RECIPE_FLAT} AS flat, {S.stripped("replace(replace(title, ' - Ingredients & Instructions', ''), ' Recipe', '')")} AS bare FROM sections),
  l AS (SELECT *, lower(flat) AS low, CASE WHEN lower(bare) IN ('recipe', 'ingredients', 'instructions') OR starts_with(bare, 'Recipe ') THEN '' ELSE bare END AS name FROM f),
  p AS (SELECT *, {_first('low', INGREDIENT_CUES)} AS a, {_first('low', INSTRUCTION_CUES)} AS b FROM l),
  t AS (SELECT *, coalesce({_first('substr(low, a + 1)', INSTRUCTION_CUES, 'a')}, length(flat) + 1) AS z FROM p),
  w AS (SELECT *, {S.stripped('substr(flat, a, z - a)')} AS ing, {S.stripped('substr(flat, b)')} AS ins FROM t),
  j AS (SELECT *, concat_ws(' ', CASE WHEN name <> '' THEN 'Recipe: ' || name END, ing, ins) AS whole FROM w)
  SELECT {_KEYS}, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND ing <> '' AND length(whole) >= 80 THEN {S.cut('whole', 500)} WHEN length(flat) >= 100 THEN flat END AS passage FROM j""",
)
def recipe_passages(s, d):
    whole = passages.recipe_passage(F.col("title"), F.col("content"), INGREDIENT_CUES, INSTRUCTION_CUES)
    return page_sections(s, d).select(*KEYS, whole.alias("passage"))


@query(
    "recipe_context",
    f"""WITH {S.SECTIONS} SELECT collection, (sum(len(list_filter({S.words('lower(content)')}, lambda w: regexp_matches(w, {S.lit('|'.join(DEMO_TERMS))})))) / sum({S.n_words('content')}) >= 0.08
  OR sum({S.any_term('title', C.RECIPE_SECTION_TITLES)}::INT) >= 2) AS is_recipe FROM sections GROUP BY collection""",
)
def recipe_context(s, d):
    return passages.recipe_context(page_sections(s, d), COOK, MENU, keywords=DEMO_TERMS)


query("sentence_split")(lambda s, d: passages.split_sentences(read(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "sentence_no", "sentence"))


_BEST_OF_SENTENCE = "[" + ", ".join(S.hits("t", t) for t in DEMO_TOPICS.values()) + "]"
_TURNS = "f.topic IS NOT NULL AND o.topic IS NOT NULL AND o.topic <> f.topic AND f.n > 200"
_ENDS = f"(f.n > 300 OR ({_TURNS}) OR f.n + length(o.t) > 600)"


@query(
    "sentence_groups",
    f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: t <> '') AS ts FROM documents),
  u AS (SELECT doc_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS k FROM l),
  o AS (SELECT *, CASE WHEN list_max({_BEST_OF_SENTENCE}) > 0 THEN [{", ".join(map(S.lit, DEMO_TOPICS))}][list_position({_BEST_OF_SENTENCE}, list_max({_BEST_OF_SENTENCE}))] END AS topic FROM u),
  f AS (SELECT doc_id, k, 0 AS passage_no, length(t) AS n, topic, t FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.k, f.passage_no + {_ENDS}::INT, CASE WHEN {_ENDS} THEN length(o.t) ELSE f.n + length(o.t) END,
      CASE WHEN {_ENDS} THEN o.topic ELSE coalesce(f.topic, o.topic) END, o.t FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
  SELECT doc_id, passage_no, string_agg(t, ' ' ORDER BY k) AS passage FROM f GROUP BY ALL""",
)
def sentence_groups(s, d):
    listed = F.filter(F.split("text", "\n"), lambda t: t != "")
    grouped = passages.grouped_sentences(listed, topics=DEMO_TOPICS)
    return read(s, d, "documents").select("doc_id", F.posexplode(grouped).alias("passage_no", "passage"))


_BEST = "[" + ", ".join(S.hits("text", t) for t in DEMO_TOPICS.values()) + "]"


@query(
    "topic_groups",
    f"""WITH {S.BLOCKS}, v AS (SELECT doc_id, block_no, {_BEST} AS n FROM blocks),
  t AS (SELECT doc_id, block_no, CASE WHEN list_max(n) > 0 THEN [{", ".join(map(S.lit, DEMO_TOPICS))}][list_position(n, list_max(n))] END AS topic FROM v),
  l AS (SELECT *, lag(topic) OVER (PARTITION BY doc_id ORDER BY block_no) AS before FROM t)
  SELECT doc_id, block_no, topic, CAST(sum((before IS NOT NULL AND topic IS DISTINCT FROM before)::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS INTEGER) AS topic_group FROM l""",
)
def topic_groups(s, d):
    return passages.topic_groups(blocks(s, d), "doc_id", "block_no", "text", DEMO_TOPICS).select("doc_id", "block_no", "topic", "topic_group")


@query(
    "narrative",
    f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  e AS (SELECT doc_id, list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN {S.stripped('parts[i]')} = '' OR regexp_matches({S.stripped('parts[i]')}, '[.!?]$') OR i = len(parts)
     THEN {S.stripped('parts[i]')} ELSE {S.stripped('parts[i]')} || '.' END) AS ends FROM p)
  SELECT doc_id, {S.stripped("replace(replace(replace(array_to_string(list_filter(ends, lambda x: x <> ''), ' '), '  ', ' '), ' .', '.'), ' ,', ',')")} AS text FROM e""",
)
def narrative(s, d):
    return read(s, d, "documents").select("doc_id", passages.narrative(F.split("text", "\n")).alias("text"))


def results(s, d):
    own = blocks(s, d)
    ranked = ranking.ranked(page_sections_of(own), PERSONA, JOB, DEMO).where("importance_rank <= 5")
    best = passages.best_passages(demo_scored(s, d).withColumn("document", F.concat(F.lit("doc-"), F.col("doc_ord").cast("string"))).withColumn("page_number", F.lit(1)))
    collections = own.groupBy(F.col("source").alias("collection")).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("input_documents"))
    # A collection without any result keeps its row.
    extra = s.createDataFrame([("nothing", [])], "collection string, input_documents array<string>")
    everything = collections.unionByName(extra).withColumns({"persona": F.lit(PERSONA), "job_to_be_done": F.lit(JOB)})
    return output.assembled(everything, ranked, best)


@query(
    "pipeline_output",
    f"WITH {_ranked(PERSONA, JOB)} SELECT collection, document, title AS section_title, CAST(importance_rank AS INTEGER) AS importance_rank, page_number FROM ranked WHERE importance_rank <= 5",
)
def pipeline_output(s, d):
    return results(s, d).select("collection", F.explode("extracted_sections").alias("x")).select("collection", "x.*")


@query("output_contract", "SELECT source AS collection, true AS is_valid, 5 AS n_sections FROM documents GROUP BY source UNION ALL SELECT 'nothing', true, 0")
def output_contract(s, d):
    return results(s, d).select("collection", output.fulfils_contract().alias("is_valid"), F.size("extracted_sections").alias("n_sections"))


@query("collection_fallback", "SELECT 'ok' AS status, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'empty', 1")
def collection_fallback(s, d):
    return output.run_summary(results(s, d))


query("full_run")(lambda s, d: run(blocks(s, d), COOK, MENU, DEMO).select("collection", "metadata", "extracted_sections", "subsection_analysis"))


@query("perf_shares", "SELECT source, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def perf_shares(s, d):
    sums = read(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sums.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))
